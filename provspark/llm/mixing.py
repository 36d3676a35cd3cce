"""Operator 1: mixing sources to target weights (DataFrame functions only).

Efraimidis-Spirakis sampling: a document of weight w gets the exponential key
-ln(u) / w, where u comes from a digest of its id, so reruns agree. Within a
source, documents are ordered by key and their sizes are summed; the prefix
that fits the source's budget is the sample. A target of more than one source
size is served by complete epochs first and by a sample for what is left.

The prefix sums need no task that holds a whole source: sizes are summed by
(source, key bin), the bin in which the budget ends is split once more, and
only documents of that last bin are ordered one by one. Bins follow ln(key),
whose density is at most 1/e per unit whatever the weights are, so a bin of
either level holds about 1/1400 of its parent.

Edge cases: a null text has size 0; a null source is a source of its own, the
last; a null or non-positive weight orders a document behind all others; a
null id is ordered as the empty string; repeated rows are documents of their
own, ordered by key, id and size; an empty table gives an empty result. Other
columns of the input are ignored. The table of sources (one row each) is
ordered in one task, for a rank needs that; it must stay a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provspark.llm.common import materialize, native_word_count

BINS = 512
LAST_BIN = 1 << 30


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> plus weight and target.

    All sizes are shared by weight; a target stops at max_epochs times its
    source's size, and what is over goes to the others by weight until none is
    above. Sources ordered by size / weight are capped from the first on, so
    running sums give the final share without a loop.
    """
    every = W.partitionBy()
    ranked = sizes.withColumn("__rank", F.row_number().over(W.partitionBy().orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("__rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight)
    before = W.partitionBy().orderBy(F.col("source_size") / F.col("weight"), "__rank").rowsBetween(W.unboundedPreceding, -1)
    s = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("__all"),
        F.sum("weight").over(every).alias("__w"),
        F.coalesce(F.sum(F.col("source_size") * max_epochs).over(before), F.lit(0)).alias("__cb"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("__wb"),
    ).withColumn("__capped", F.col("source_size") * max_epochs * (F.col("__w") - F.col("__wb")) <= F.col("weight") * (F.col("__all") - F.col("__cb")))
    left = (F.col("__all") - F.coalesce(F.sum(F.when(F.col("__capped"), F.col("source_size") * max_epochs)).over(every), F.lit(0))).alias("__left")
    spare = (F.col("__w") - F.coalesce(F.sum(F.when(F.col("__capped"), F.col("weight"))).over(every), F.lit(0))).alias("__spare")
    s = s.select("*", left, spare)
    target = F.when(F.col("__capped"), (F.col("source_size") * max_epochs).cast("double")).otherwise(
        (F.col("__left") * F.col("weight")).cast("double") / F.col("__spare")
    )
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 0,
    quality: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: (doc_id, source, size, source_size, target, epochs, taken).

    taken is size times the number of times the mix takes the document.
    quality is a column of docs; by default it is derived from the text.
    """
    size = native_word_count(F.col(text_col))
    wide = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        size.alias("size"),
        F.length(text_col).alias("__chars") if quality is None else quality.cast("double").alias("__q"),
    )
    if quality is None:
        mean = F.col("__chars") / F.nullif(F.col("size"), F.lit(0))
        q = F.coalesce(F.greatest(F.lit(0.1), F.lit(1.0) / (F.lit(1.0) + F.abs(mean - 5.5) / 5.5)), F.lit(0.1))
    else:
        q = F.col("__q")
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    keyed = wide.select("doc_id", "source", "size", F.when(q > 0, -F.log(u) / q).alias("key"))
    level = F.log("key") * BINS
    keyed = keyed.withColumn("b1", F.coalesce(F.floor(level), F.lit(LAST_BIN)).cast("long")).withColumn(
        "b2", F.coalesce(F.floor((level - F.floor(level)) * BINS), F.lit(0)).cast("long")
    )
    keyed = materialize(keyed, "mix-keys")

    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, max_epochs)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    def crossing(bins: DataFrame, plan: DataFrame, by: str, start: Column, out: str) -> DataFrame:
        """The bin of each source in which its budget ends, and what lies before it."""
        w = W.partitionBy("source").orderBy(by)
        run = bins.withColumn("__end", F.sum("size").over(w)).join(plan.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
        run = run.withColumn("__end", F.col("__end") + start).withColumn("__at", F.col("__end") - F.col("size"))
        hit = run.where((F.col("__at") <= F.col("rest")) & (F.col("rest") < F.col("__end")))
        return hit.select(F.col("source").alias("__s"), F.col(by).alias(f"{out}"), F.col("__at").alias(f"{out}_at"))

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")

    plan = materialize(plan, "mix-plan")
    first = keyed.groupBy("source", "b1").agg(F.sum("size").alias("size"))
    plan = materialize(attach(plan, crossing(first, plan, "b1", F.lit(0), "c1")), "mix-plan")
    of_plan = plan.withColumnRenamed("source", "__s")
    near = keyed.join(of_plan.where("c1 is not null"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("b1") == F.col("c1"))).select("source", "b2", "size")
    second = near.groupBy("source", "b2").agg(F.sum("size").alias("size"))
    plan = materialize(attach(plan, crossing(second, plan, "b2", F.col("c1_at"), "c2")), "mix-plan")

    rows = attach(keyed, plan.withColumnRenamed("source", "__s"))
    last = F.col("c1").isNotNull() & (F.col("b1") == F.col("c1")) & F.col("c2").isNotNull() & (F.col("b2") == F.col("c2"))
    # one by one in the last bin: a document is in if at least half of it fits
    w = W.partitionBy("source").orderBy(F.asc_nulls_last("key"), "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    at = F.col("c2_at") + F.coalesce(F.sum("size").over(w), F.lit(0))
    exact = rows.where(last).withColumn("__in", at + F.col("size") / 2 <= F.col("rest"))
    whole = F.when(F.col("c1").isNull() | (F.col("b1") < F.col("c1")), F.lit(True)).when(F.col("b1") > F.col("c1"), F.lit(False))
    whole = whole.otherwise(F.col("c2").isNull() | (F.col("b2") < F.col("c2")))
    rest = rows.where(~last).withColumn("__in", whole)
    both = rest.unionByName(exact)
    taken = F.col("size") * (F.col("epochs") + F.when(F.col("__in") & (F.col("rest") > 0), 1).otherwise(0))
    return both.select("doc_id", "source", "size", "source_size", "target", "epochs", taken.cast("long").alias("taken"))


#: The same result in DuckDB: one window over each source instead of bins.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, length(text) AS chars,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (SELECT doc_id, source, size,
    -ln((CAST(('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':0')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)
    / coalesce(greatest(0.1, 1.0 / (1.0 + abs(CAST(chars AS DOUBLE) / nullif(size, 0) - 5.5) / 5.5)), 0.1) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
r AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM s),
b AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS a, CAST(sum(weight) OVER () AS BIGINT) AS w,
    CAST(coalesce(sum(3 * source_size) OVER q, 0) AS BIGINT) AS cb, CAST(coalesce(sum(weight) OVER q, 0) AS BIGINT) AS wb FROM r
    WINDOW q AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size * (w - wb) <= weight * (a - cb) AS capped FROM b),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE
    CAST((a - coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0)) * weight AS DOUBLE)
    / CAST(w - coalesce(sum(CASE WHEN capped THEN weight END) OVER (), 0) AS DOUBLE) END AS target FROM c),
p AS (SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS epochs FROM t),
j AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
    FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target, epochs,
    CAST(size * (epochs + CASE WHEN rest > 0 AND upto + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""
