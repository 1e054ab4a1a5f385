"""Range, as-of and interval joins on one axis, time or length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.spatial import met, packed, unpacked


def range_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Points and the intervals [low, high) that hold them. Both sides meet in buckets of the given width, so the join has a key to
    shuffle by; an interval is repeated for each bucket it touches, which a width near the usual length keeps to two or so. Points of
    one place, and equal intervals, meet as lists, and pairs are made from pairs of lists."""
    on = on or []
    bucket = lambda c: F.floor(F.col(c) / width)
    some = intervals.filter(F.col(high) > F.col(low)).dropna(subset=on) if on else intervals.filter(F.col(high) > F.col(low))
    keys = lambda name: [F.col(f"{name}.{c}").alias(f"_{c}_on") for c in on]
    i = packed(some, [low, high, *on], "b").select("b", "_b", *keys("b"), F.explode(F.sequence(bucket(f"b.{low}"), bucket(f"b.{high}"))).alias("_bucket"))
    p = packed(points.dropna(subset=[at, *on]), [at, *on], "a").select("a", "_a", *keys("a"), bucket(f"a.{at}").alias("_bucket"))
    pairs = met(p, i, ["_bucket", *[f"_{c}_on" for c in on]]).filter((F.col(f"a.{at}") >= F.col(f"b.{low}")) & (F.col(f"a.{at}") < F.col(f"b.{high}")))
    both = unpacked(pairs, points.columns, intervals.columns, [at, *on], place_b=[low, high, *on])
    return both.select(*[F.col(f"a.{c}").alias(c) for c in [*on, *[c for c in points.columns if c not in on]]], *[F.col(f"b.{c}").alias(c) for c in intervals.columns if c not in on])


def asof(left: DataFrame, right: DataFrame, key: str, at: str, take: dict[str, str]) -> DataFrame:
    """Each left row with columns of the last right row of its key that is not later (of equal times, the greatest values). One
    sort of the union by key and time; no pair of rows is ever built."""
    names = list(take)
    r = right.select(key, at, F.struct(*names).alias("_right")).withColumn("_side", F.lit(0))
    l = left.withColumn("_side", F.lit(1))
    both = l.unionByName(r, allowMissingColumns=True)
    last = F.last("_right", ignorenulls=True).over(Window.partitionBy(key).orderBy(at, "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("_last", last).filter("_side = 1").select(*left.columns, *[F.col(f"_last.{n}").alias(new) for n, new in take.items()])


def disjoint(a0: str, a1: str, b0: str, b1: str) -> Column:
    """Whether two closed periods do not meet."""
    return (F.col(a1) < F.col(b0)) | (F.col(b1) < F.col(a0))
