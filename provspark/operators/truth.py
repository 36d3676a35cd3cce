"""Scores of attributions against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = ("certain", "inferred", "indeterminate", "library")


def ratio(n: Column, total: Column) -> Column:
    """n / total, null if nothing is counted."""
    return F.try_divide(n.cast("double"), total)


def label(truth_kind: Column) -> Column:
    """TP for the author's code, FP for other, UNK without truth."""
    return F.when(truth_kind.isNull(), "UNK").when(truth_kind == "user", "TP").otherwise("FP")


def labelled(attributed: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    kinds = truth.select(*(by or []), "fn_start", F.col("kind").alias("truth_kind"))
    return attributed.join(kinds, [*(by or []), "fn_start"], "left").withColumn("label", label(F.col("truth_kind")))


def symbol_labelled(rows: DataFrame, classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows with the columns of classes (by.., fn_start, class) and a label; a row without a class is unknown."""
    label_of = F.when(F.col("class") == "user", "TP").when(F.col("class") == "nonuser", "FP").otherwise("UNK")
    return rows.join(classes, [*(by or []), "fn_start"], "left").withColumn("label", label_of)


def symbol_score(rows: DataFrame, by: list[str]) -> DataFrame:
    """TP, FP, unknown and precision over known labels, by group."""
    tp, fp, unk = (F.count_if(F.col("label") == x) for x in ("TP", "FP", "UNK"))
    return rows.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), unk.alias("unknown"), ratio(tp, tp + fp).alias("precision"))


def bucket_metrics(rows: DataFrame, bucket: str = "attribution", by: list[str] | None = None) -> DataFrame:
    """Predicted, TP, FP and unknown by bucket, precision over known ones and TP over all predicted."""
    tp, fp, unk = (F.count_if(F.col("label") == x) for x in ("TP", "FP", "UNK"))
    return rows.groupBy(*(by or []), bucket).agg(
        F.count("*").alias("predicted"),
        tp.alias("tp"),
        fp.alias("fp"),
        unk.alias("unknown"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, F.count("*")).alias("tp_over_predicted"),
    )


def recall_placement(attributed: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Where true author functions went, and how many were captured."""
    by = by or []
    own = truth.where("kind = 'user'").select(*by, "fn_start")
    placed = own.join(attributed.select(*by, "fn_start", "attribution"), [*by, "fn_start"], "left")
    at = F.coalesce("attribution", F.lit("library"))
    counts = [F.count_if(at == b).alias(f"n_{b}") for b in BUCKETS]
    captured = F.count_if(at.isin("certain", "inferred"))
    return placed.groupBy(*by).agg(F.count("*").alias("n_truth"), *counts, captured.alias("n_captured"), ratio(captured, F.count("*")).alias("recall"))


def ladder(rows: DataFrame, steps: tuple[int, ...] = (1, 2, 3), by: list[str] | None = None) -> DataFrame:
    """Precision and kept recall of certain functions with at least N anchors; rows (anchor_count, label)."""
    by = by or []
    stepped = rows.select("*", F.explode(F.array(*map(F.lit, steps))).alias("min_anchors"))
    on = F.col("anchor_count") >= F.col("min_anchors")
    tp, fp = F.count_if(on & (F.col("label") == "TP")), F.count_if(on & (F.col("label") == "FP"))
    base = F.count_if((F.col("anchor_count") >= 1) & (F.col("label") == "TP"))
    return stepped.groupBy(*by, "min_anchors").agg(
        tp.alias("tp"), fp.alias("fp"), ratio(tp, tp + fp).alias("precision"), ratio(tp, base).alias("recall_retained")
    )


def precision_rollup(rows: DataFrame, levels: list[str]) -> DataFrame:
    """TP, FP and precision for each group, each subtotal and all; `level` counts the columns summed over."""
    tp, fp = F.count_if(F.col("label") == "TP"), F.count_if(F.col("label") == "FP")
    return rows.rollup(*levels).agg(
        F.grouping_id().cast("long").alias("level"), tp.alias("tp"), fp.alias("fp"), ratio(tp, tp + fp).alias("precision")
    )


def user_fraction(n_user: Column, n_std: Column, n_dep: Column, n_unknown: Column) -> Column:
    return F.coalesce(ratio(n_user, n_user + n_std + n_dep + n_unknown), F.lit(0.0))


# The rules of the trade-off grid, in order.
RULES = [
    ("n_user>=1", "n_user", 1.0),
    ("n_user>n_lib", "majority", 0.0),
    ("uf>=0.5 (R3)", "uf", 0.5),
    ("n_user>=2", "n_user", 2.0),
    ("n_user>=3", "n_user", 3.0),
    ("uf>=0.3", "uf", 0.3),
    ("uf>=0.4", "uf", 0.4),
    ("uf>=0.5", "uf", 0.5),
    ("uf>=0.6", "uf", 0.6),
    ("uf>=0.7", "uf", 0.7),
    ("uf>=0.8", "uf", 0.8),
]


def rule_tradeoff(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What each acceptance rule rejects and loses; rows (n_user, n_lib, uf, category).

    Precision is given with call shims as true and as false positives.
    """
    by = by or []
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(k).alias("k"), F.lit(t).alias("t")) for n, k, t in RULES])
    x = rows.where("category <> 'unk'").withColumn("__r", F.explode(rules))
    kept = (
        F.when(F.col("__r.k") == "n_user", F.col("n_user") >= F.col("__r.t"))
        .when(F.col("__r.k") == "uf", F.col("uf") >= F.col("__r.t"))
        .otherwise(F.col("n_user") > F.col("n_lib"))
    )
    x = x.select("*", F.col("__r.rule").alias("rule"), kept.alias("__kept"))
    cat = F.col("category")
    bad = cat.isin("lib_generic", "core_other", "dep")
    kept_tp, kept_shim, kept_bad = (F.count_if(F.col("__kept") & c) for c in (cat == "tp", cat == "fnonce_shim", bad))
    every = kept_tp + kept_shim + kept_bad
    return x.groupBy(*by, "rule").agg(
        F.count_if(~F.col("__kept") & bad).alias("fp_rejected"),
        F.count_if(~F.col("__kept") & (cat == "fnonce_shim")).alias("shim_rejected"),
        F.count_if(~F.col("__kept") & (cat == "tp")).alias("tp_lost"),
        ratio(kept_tp + kept_shim, every).alias("precision_shim_tp"),
        ratio(kept_tp, every).alias("precision_shim_fp"),
    )


def distribution(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median, interpolated quartiles, least and greatest."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.median(value).alias("median"),
        F.percentile(value, 0.25).alias("p25"),
        F.percentile(value, 0.75).alias("p75"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def headroom(truth: DataFrame, certain: DataFrame, bare_ident: DataFrame, bare_path: DataFrame, by: list[str] | None = None) -> DataFrame:
    """True author functions: A certain, B missed but with a bare anchor (by kind), C neither."""
    by = by or []
    key = [*by, "fn_start"]

    def mark(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key).distinct().withColumn(name, F.lit(True))

    x = truth.where("kind = 'user'").select(*key).distinct()
    for df, name in ((certain, "a"), (bare_ident, "i"), (bare_path, "p")):
        x = x.join(mark(df, name), key, "left")
    a, i, p = (F.coalesce(c, F.lit(False)) for c in ("a", "i", "p"))
    total, missed = F.count("*"), F.count_if(~a & (i | p))
    return x.groupBy(*by).agg(
        total.alias("n_truth"),
        F.count_if(a).alias("a"),
        missed.alias("b"),
        F.count_if(~a & ~i & ~p).alias("c"),
        F.count_if(~a & i).alias("b_ident"),
        F.count_if(~a & ~i & p).alias("b_path"),
        ratio(missed, total).alias("b_ratio"),
    )


def upper_median(values: Column) -> Column:
    """Element n div 2 of the sorted values, which are the groups of a small report."""
    ordered = F.sort_array(F.collect_list(values))
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))
