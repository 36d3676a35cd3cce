"""Sinks: the JSON contract, tab-separated dumps and Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions.symbols import hex_address


def function_record() -> Column:
    """The contract's record of a tiered function; addresses are lower-case hex text."""
    return F.struct(hex_address(F.col("fn_start")).alias("start"), hex_address(F.col("fn_end")).alias("end"), "size", "tier", "anchor_count", F.sort_array("anchor_files").alias("anchor_files"))


def contract_json(binaries: DataFrame, tiers: DataFrame, min_anchors: int = 2) -> DataFrame:
    """(binary_id, json): one document for each binary, functions by start; binaries without a function map have none.

    A document holds one binary's certain functions, so its size is that binary's.
    """
    record = F.struct(F.col("fn_start").alias("k"), function_record().alias("r"))
    listed = tiers.groupBy("binary_id").agg(F.transform(F.sort_array(F.collect_list(record)), lambda x: x["r"]).alias("functions"))
    empty = F.array().cast(listed.schema["functions"].dataType)
    full = binaries.join(listed, "binary_id", "left").withColumn("functions", F.coalesce("functions", empty))
    has_map = F.col("has_functions") if "has_functions" in binaries.columns else F.lit(True)
    body = F.to_json(F.struct(F.col("path").alias("binary"), "arch", F.lit(min_anchors).alias("min_anchors"), "functions"))
    return full.select("binary_id", F.when(has_map, body).otherwise(F.lit('{"binary": null, "functions": []}')).alias("json"))


def write_dump(rows: DataFrame, kind: str, path: str) -> None:
    """Tab-separated lines that begin with a record name and a hex address."""
    rest = [c for c in rows.columns if c != "fn_start"]
    shown = rows.select(F.lit(kind), hex_address(F.col("fn_start")), *[F.col(c).cast("string") for c in rest])
    shown.write.csv(path, sep="\t", header=False, quote="", escape="")


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose keys are not in the Parquet folder yet."""
    spark = rows.sparkSession
    rows.limit(0).write.mode("append").parquet(path)
    rows.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti").write.mode("append").parquet(path)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of a small report."""
    found = rows.limit(limit).collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in found]
    return "\n".join(lines)
