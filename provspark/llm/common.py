"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.session import discard, materialize, shared_dir, stored

__all__ = ["discard", "materialize", "shared_dir", "stored", "in_parts", "table", "native_word_count", "connected_components"]

#: Rows and bytes that a worker takes up at once.
PART_ROWS, PART_BYTES = 512, 4 << 20
#: Edges for each task of a round of the component search.
ROUND_ROWS = 200_000

#: White space of the contracts: space and U+0009 to U+000D, which is what bytes.split() splits at.
SPACE = " \t\n\x0b\x0c\r"


def in_parts(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f over batches cut to at most PART_ROWS rows and, but for a single row, PART_BYTES bytes.

    What a worker makes of long texts at once is bounded by this, whatever the session's batch size.
    """

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if len(b) > 1 and (len(b) > PART_ROWS or b.nbytes > PART_BYTES):
            half = len(b) // 2
            yield from cut(b.slice(0, half))
            yield from cut(b.slice(half))
        else:
            yield b

    return lambda batches: f(part for b in batches for part in cut(b))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def native_word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in text as long, null as 0, inside the JVM."""
    lead = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \x09-\x0D]++", "")
    return F.length(F.regexp_replace(lead, r"[^ \x09-\x0D]++[ \x09-\x0D]*+", "w")).cast("long")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected edge list (a, b) as (node, component); nodes are of any type that has an order.

    component is the smallest node reachable. Alternates large-star and
    small-star steps (Kiveris et al., 2014); each step needs per-node minima
    only, so no neighbour list is gathered. A round is written to the shared
    folder and the one before it removed. The search ends when every node
    points to one root and no root points on, which is tested on all edges.
    Only nodes with an edge are returned.
    """
    spark = edges.sparkSession
    first = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    path, cur = stored(first, "cc")
    # neither step adds edges, so this many partitions do for every round
    parts = max(8, cur.count() // ROUND_ROWS)
    while True:
        ends = cur.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(cur.select("lo", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if ends.where("up > 1 or (up > 0 and root > 0)").isEmpty():
            return cur.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        # large star: every larger neighbour of u points to the smallest of u's neighbourhood
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(cur.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        small = small.union(least.select("hi", F.col("m").alias("lo"))).distinct()
        before = path
        path, cur = stored(small.coalesce(parts), "cc")
        discard(spark, before)
