"""Range and as-of joins by equi-joins on buckets; no nested loops, no cross joins.

Every join takes `by`, the columns that keep binaries apart. Ranges are
half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _page(x: Column, bits: int) -> Column:
    return F.shiftright(x, bits)


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, by: list[str] | None = None, bits: int = 12, how: str = "inner") -> DataFrame:
    """Every (point, range) with start <= point < end; how may be inner or left_semi.

    A range is dealt out under each page of 2**bits that it touches, so a
    point meets all ranges over its page and no other.
    """
    by = by or []
    pages = F.sequence(_page(F.col(start), bits), _page(F.col(end) - 1, bits))
    dealt = ranges.where(F.col(end) > F.col(start)).withColumn("__page", F.explode(pages))
    left = points.withColumn("__page", _page(F.col(point), bits))
    if how == "left_semi":
        keys = [left[c].eqNullSafe(dealt[c]) for c in [*by, "__page"]]
        on = keys[0]
        for k in keys[1:]:
            on = on & k
        return left.join(dealt, on & (left[point] >= dealt[start]) & (left[point] < dealt[end]), "left_semi").drop("__page")
    out = left.join(dealt, [*by, "__page"])
    return out.where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("__page")


def point_in_bounds(points: DataFrame, bounds: DataFrame, point: str, start: str, size: str, by: list[str]) -> DataFrame:
    """Points inside a section of which each binary has one."""
    return points.join(bounds, by).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(start) + F.col(size)))


def asof_within(points: DataFrame, starts: DataFrame, point: str, start: str, size: int = 24, by: list[str] | None = None) -> DataFrame:
    """The greatest start at or before a point, if the point lies less than `size` behind it.

    Only the nearest start counts, also if an earlier one would reach the
    point. The bucket is the next power of two, so a start covers at most two.
    """
    by = by or []
    bits = max(size - 1, 1).bit_length()
    own = F.array_distinct(F.array(_page(F.col(start), bits), _page(F.col(start) + size - 1, bits)))
    dealt = starts.withColumn("__bucket", F.explode(own))
    left = points.withColumn("__bucket", _page(F.col(point), bits))
    near = left.join(dealt, [*by, "__bucket"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(start) + size))
    keep = [c for c in near.columns if c != "__bucket"]
    if size <= 1:
        return near.select(*keep)
    best = F.max_by(F.struct(*[F.col(c) for c in keep if c not in points.columns or c == start]), F.col(start)).alias("__best")
    rest = [c for c in points.columns]
    found = near.groupBy(*rest).agg(F.count("*").alias("__n"), F.count_distinct(start).alias("__d"), best)
    # rows that repeat a point stay repeated
    found = found.withColumn("__copies", F.explode(F.sequence(F.lit(1), (F.col("__n") / F.col("__d")).cast("int"))))
    return found.select(*rest, *[F.col(f"__best.{c}").alias(c) for c in keep if c not in rest])


def asof_containing(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, by: list[str] | None = None, bits: int = 12) -> DataFrame:
    """The range with the greatest start at or before a point, if the point is before its end.

    Not the same as range_join where ranges nest or overlap. Starts are unique
    within `by`. Within a page of 2**bits a window carries the last start on;
    what enters a page comes from a running maximum over pages, so one huge
    binary is not one task.
    """
    by = by or []
    page = F.shiftright(F.col("__at"), bits).alias("__page")
    rest = [c for c in points.columns if c not in (*by, point)]
    other = [c for c in ranges.columns if c not in (*by, start)]
    left = points.select(*by, F.col(point).alias("__at"), F.struct(*[F.col(c) for c in [point, *rest]]).alias("__row"), F.lit(None).cast("long").alias("__start"))
    right = ranges.select(*by, F.col(start).cast("long").alias("__at"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col(start).cast("long").alias("__start"))
    both = left.union(right).select("*", page)
    last = both.groupBy(*by, "__page").agg(F.max("__start").alias("__last"))
    before = W.partitionBy(*by).orderBy("__page").rowsBetween(W.unboundedPreceding, -1)
    entry = last.select(*by, "__page", F.max("__last").over(before).alias("__entry"))
    w = W.partitionBy(*by, "__page").orderBy("__at", F.col("__row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    carried = both.withColumn("__in", F.max("__start").over(w)).where("__row is not null")
    found = carried.join(entry, [*by, "__page"]).select(*by, "__row.*", F.coalesce("__in", "__entry").alias(start))
    return found.join(ranges.select(*by, start, *other), [*by, start]).where(F.col(point) < F.col(end))
