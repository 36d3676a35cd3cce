"""Line-based sources: dumps, symbol listings, JSON lines and lists. Order comes from a position column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line): each file is one row until it is cut into lines, so positions are true."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def parse_json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Columns of schema for each line; blank and malformed lines go."""
    rows = lines.where(F.trim("line") != "").withColumn("__r", F.from_json("line", f"{schema}, __bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    return rows.where("__r.__bad IS NULL").select(*[c for c in lines.columns if c != "line"], "__r.*").drop("__bad")


def last_by_key(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The row of each key with the greatest position."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), pos).alias("__r")).select(*keys, "__r.*")


def parse_symbol_lines(lines: DataFrame, first: bool, types: str | None, by: list[str] | None = None) -> DataFrame:
    """(by.., fn_start, type, name) from ``address type name`` lines (pos, line).

    Of equal addresses the first or the last line stays; types limits the type letters.
    """
    by = by or []
    p = r"^([0-9a-f]{16}) (\S) +(.+)$"
    parts = [F.regexp_extract("line", p, i) for i in (1, 2, 3)]
    rows = lines.where(F.col("line").rlike(p)).select(*by, "pos", F.conv(parts[0], 16, 10).cast("decimal(20,0)").alias("a"), parts[1].alias("type"), parts[2].alias("name"))
    rows = rows.where(F.col("a") < (1 << 63) - 1).select(*by, "pos", F.col("a").cast("long").alias("fn_start"), "type", "name")
    if types:
        rows = rows.where(F.col("type").isin(list(types)))
    pick = F.min_by if first else F.max_by
    return rows.groupBy(*by, "fn_start").agg(pick(F.struct("type", "name"), "pos").alias("r")).select(*by, "fn_start", "r.*")


def _fields(lines: DataFrame, kind: str) -> DataFrame:
    return lines.select("*", F.split("line", "\t").alias("f")).where(F.element_at("f", 1) == kind)


def _address(field: int):
    return F.conv(F.regexp_replace(F.element_at("f", field), "^0x", ""), 16, 10).cast("long").alias("fn_start")


def read_tier_dump(lines: DataFrame) -> DataFrame:
    """(fn_start, tier, anchor_count)."""
    return _fields(lines, "TIERDUMP").select(_address(2), F.element_at("f", 3).alias("tier"), F.element_at("f", 4).cast("long").alias("anchor_count"))


def read_dep_dump(lines: DataFrame) -> DataFrame:
    """Distinct dependency names with underscores."""
    return _fields(lines, "DEPCRATE").select(F.replace(F.element_at("f", 2), F.lit("-"), F.lit("_")).alias("crate")).distinct()


def read_address_dump(lines: DataFrame, kind: str = "ALLFNS") -> DataFrame:
    return _fields(lines, kind).select(_address(2))


def read_attribution_dump(lines: DataFrame) -> DataFrame:
    """(fn_start, bucket, label)."""
    return _fields(lines, "ATTRDUMP").select(_address(2), F.element_at("f", 3).alias("bucket"), F.element_at("f", 4).alias("label"))


def read_pair_dump(lines: DataFrame, kind: str = "EDGEDUMP") -> DataFrame:
    """(fn_start, pairs map) from ``kind address key=value..`` lines."""
    tail = F.array_join(F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))), "\t")
    return _fields(lines, kind).select(_address(2), F.str_to_map(tail, F.lit("\t"), F.lit("=")).alias("pairs"))


def read_corpus_list(lines: DataFrame) -> DataFrame:
    """(crate, url, binary) from ``crate``, ``crate:binary`` or ``crate:url:binary``; comments and blanks go."""
    text = F.trim(F.regexp_replace("line", "#.*$", ""))
    parts = F.split(text, ":(?!//)")
    n = F.size(parts)
    return lines.where(text != "").select(
        F.element_at(parts, 1).alias("crate"), F.when(n >= 3, F.element_at(parts, 2)).alias("url"), F.when(n >= 2, F.element_at(parts, -1)).otherwise(F.element_at(parts, 1)).alias("binary")
    )


def read_build_results(lines: DataFrame) -> DataFrame:
    """(file, status, profile) from ``STATUS=`` and ``PROFILE=`` lines."""
    def of(key: str):
        return F.max(F.nullif(F.regexp_extract("line", f"^{key}=(.*)$", 1), F.lit("")))

    return lines.groupBy("file").agg(of("STATUS").alias("status"), of("PROFILE").alias("profile"))


def report_figures(reports: DataFrame) -> DataFrame:
    """(file, name, value) of ``name: number`` lines of printed reports; figures proper are in tables."""
    p = r"^\s*([A-Za-z][A-Za-z -]*[A-Za-z])\s*:\s*([0-9]+(?:\.[0-9]+)?)\s*%?"
    return reports.where(F.col("line").rlike(p)).select("file", F.lower(F.regexp_extract("line", p, 1)).alias("name"), F.regexp_extract("line", p, 2).cast("double").alias("value"))
