"""Printed reports of one binary, made from result tables.

The tables are the interface; these texts are for people. What a report lists
is bounded by its limits, and counts are made in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.functions.symbols import hex_address
from provspark.operators.anchors import tally
from provspark.operators.truth import bucket_metrics, labelled, recall_placement


def _shown(value) -> str:
    return "-" if value is None else f"{100 * value:.1f}%" if isinstance(value, float) else str(value)


def _list(rows: DataFrame, limit: int | None, line) -> list[str]:
    """Lines for the first rows, and how many more there are."""
    first = rows.collect() if limit is None else rows.limit(limit).collect()
    out = [line(r) for r in first]
    more = 0 if limit is None or len(first) < limit else rows.count() - len(first)
    return [*out, f"  … {more} more"] if more else out


def sites_report(locations: DataFrame, limit: int = 10) -> str:
    """Location counts by origin, author sites by file, and the most frequent dependencies."""
    t = tally(locations.select("kind", F.col("origin.crate").alias("crate"))).first()
    own = locations.where("kind = 'user'").select("file", "line", "col").distinct()
    files = own.groupBy("file").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("line", "col"))).alias("s")).orderBy("file")
    deps = locations.where("kind = 'dep'").groupBy(F.concat_ws("@", "origin.crate", "origin.version").alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c")
    lines = [f"Locations: author {t['n_user']}, standard library {t['n_std']}, dependencies {t['n_dep']} ({t['n_dep_crates']} crates), unknown {t['n_unknown']}", "", "Author sites:"]
    lines += _list(files, None, lambda r: f"  {r['file']}: " + ", ".join(f"{x['line']}:{x['col']}" for x in r["s"]))
    lines += ["", "Dependencies by sites:", *_list(deps, limit, lambda r: f"  {r['c']}: {r['n']}")]
    return "\n".join(lines)


def functions_report(attributed: DataFrame, tiers: DataFrame, backtraced: DataFrame | None = None, limit: int | None = 20) -> str:
    """Counts by attribution, graded functions with their files, and the call closure; limit None lists all."""
    counts = {r["attribution"]: r["n"] for r in attributed.groupBy("attribution").agg(F.count("*").alias("n")).collect()}
    lines = ["Functions: " + ", ".join(f"{k} {counts.get(k, 0)}" for k in ("certain", "inferred", "indeterminate", "library"))]
    for tier in ("strong", "single"):
        rows = tiers.where(F.col("tier") == tier).orderBy("fn_start").withColumn("at", hex_address(F.col("fn_start")))
        lines += ["", f"{tier}:", *_list(rows, None, lambda r: f"  {r['at']} ({r['size']} bytes, {r['anchor_count']} anchors): {', '.join(r['anchor_files'])}")]
    closure = attributed.where("attribution IN ('inferred', 'indeterminate')").orderBy("fn_start").select(hex_address(F.col("fn_start")).alias("at"), "attribution")
    lines += ["", "Call closure:", *_list(closure, limit, lambda r: f"  {r['at']} {r['attribution']}")]
    if backtraced is not None:
        back = backtraced.orderBy("fn_start").select(hex_address(F.col("fn_start")).alias("at"), "depth")
        lines += ["", "Callers of certain functions:", *_list(back, limit, lambda r: f"  {r['at']} at {r['depth']}")]
    return "\n".join(lines)


def validation_report(attributed: DataFrame, truth: DataFrame) -> str:
    """Precision by bucket and where true author functions went."""
    lines = ["Bucket: predicted, right, wrong, unknown, precision"]
    for r in bucket_metrics(labelled(attributed, truth)).orderBy("attribution").collect():
        lines.append(f"  {r['attribution']}: {r['predicted']}, {r['tp']}, {r['fp']}, {r['unknown']}, {_shown(r['precision'])}")
    placed = recall_placement(attributed, truth).first()
    if placed:
        lines += ["", f"Author functions: {placed['n_truth']}; captured {placed['n_captured']} ({_shown(placed['recall'])})"]
    return "\n".join(lines)


def types_report(types: DataFrame) -> str:
    """Recovered types by tier and name."""
    rows = types.orderBy("tier", "struct_name", "fn_start").withColumn("at", hex_address(F.col("fn_start")))
    return "\n".join(["Types:", *_list(rows, None, lambda r: f"  [{r['tier']}] {r['struct_name']} {{ {', '.join(r['fields'])} }} at {r['at']}")])
