"""Reachability over call graphs: breadth-first search with barriers and a depth limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.session import materialize


def bfs(
    edges: DataFrame,
    seeds: DataFrame,
    barrier: DataFrame | None = None,
    nodes: DataFrame | None = None,
    max_depth: int | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """(by.., node, depth) of all nodes reached, with their least depth; seeds have depth 0.

    edges (by.., src, dst), seeds, barrier and nodes (by.., node). Seeds are
    always expanded. A barrier node ends a path and is not returned. With
    nodes, only those are entered. Each level is written to the shared folder,
    so a level costs one join with the edges and one with what was seen.
    """
    by = by or []
    key = [*by, "node"]
    edges = edges.select(*by, "src", "dst").distinct()
    if nodes is not None:
        edges = edges.join(nodes.select(*by, F.col("node").alias("dst")).distinct(), [*by, "dst"], "left_semi")
        seeds = seeds.join(nodes.select(*key).distinct(), key, "left_semi")
    if barrier is not None:
        edges = edges.join(barrier.select(*by, F.col("node").alias("dst")).distinct(), [*by, "dst"], "left_anti")
    edges = materialize(edges, "bfs-edges")
    front = materialize(seeds.select(*key).distinct().withColumn("depth", F.lit(0)), "bfs")
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(edges, [F.col("node") == F.col("src"), *[front[c] == edges[c] for c in by]])
        step = step.select(*[edges[c] for c in by], F.col("dst").alias("node")).distinct()
        front = materialize(step.join(seen.select(*key), key, "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def reverse_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    rest = [c for c in edges.columns if c not in (src, dst)]
    return edges.select(*rest, F.col(dst).alias(src), F.col(src).alias(dst)).distinct()


def attribute(
    functions: DataFrame, certain: DataFrame, calls: DataFrame, dep_boundary: DataFrame, max_depth: int | None = None, by: list[str] | None = None
) -> DataFrame:
    """functions (by.., fn_start, fn_end) -> plus attribution.

    certain: has an author location. inferred: reached from certain ones by
    calls, not through a dependency boundary, and called only by certain or
    reached functions. indeterminate: reached, but also called from elsewhere.
    library: the rest.
    """
    by = by or []
    key = [*by, "fn_start"]

    def nodes(df: DataFrame) -> DataFrame:
        return df.select(*by, F.col("fn_start").alias("node"))

    edges = calls.select(*by, F.col("caller").alias("src"), F.col("callee").alias("dst"))
    reached = bfs(edges, nodes(certain), nodes(dep_boundary), nodes(functions), max_depth, by)
    state = reached.select(*by, F.col("node").alias("fn_start"), F.when(F.col("depth") == 0, "certain").otherwise("tentative").alias("state"))
    outside = edges.join(state.select(*by, F.col("fn_start").alias("src")), [*by, "src"], "left_anti")
    disputed = outside.select(*by, F.col("dst").alias("fn_start")).distinct().withColumn("__disputed", F.lit(True))
    out = functions.join(state, key, "left").join(disputed, key, "left")
    label = (
        F.when(F.col("state") == "certain", "certain")
        .when((F.col("state") == "tentative") & F.col("__disputed"), "indeterminate")
        .when(F.col("state") == "tentative", "inferred")
        .otherwise("library")
    )
    return out.select(*functions.columns, label.alias("attribution"))


def backtrace(
    functions: DataFrame, certain: DataFrame, calls: DataFrame, dep_boundary: DataFrame, depth: int | None, by: list[str] | None = None
) -> DataFrame:
    """(by.., fn_start, depth) of callers of certain functions within `depth` hops; none at depth 0, never the seeds."""
    by = by or []

    def nodes(df: DataFrame) -> DataFrame:
        return df.select(*by, F.col("fn_start").alias("node"))

    back = calls.select(*by, F.col("callee").alias("src"), F.col("caller").alias("dst"))
    found = bfs(back, nodes(certain), nodes(dep_boundary), nodes(functions), depth, by)
    return found.where("depth > 0").select(*by, F.col("node").alias("fn_start"), "depth")
