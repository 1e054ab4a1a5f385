"""Street widths along an axis, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def half_width(hit: str, cap: str, least: str, by: list[str], order: str, k: int = 4) -> Column:
    """Half width at a sample: the moving median over k samples either way of hit or cap, where half of the side's samples hit
    something; else the cap. Never under the least."""
    side = Window.partitionBy(*by)
    near = side.orderBy(order).rowsBetween(-k, k)
    bounded = F.avg(F.col(hit).isNotNull().cast("int")).over(side) >= 0.5
    return F.greatest(F.when(bounded, F.percentile(F.coalesce(hit, cap), 0.5).over(near)).otherwise(F.col(cap)), F.col(least))


def reach(width: Column, is_road: Column) -> Column:
    """How far rays look to the side of a way."""
    return F.least(1.5 * width + F.when(is_road, 8).otherwise(4), F.lit(25.0))


def way_width(kind: Column, lanes: Column, per_direction: Column, oneway: Column, table: dict[str, float], lane: float = 3.25) -> Column:
    """Width of a way: by its lanes, else by lanes per direction, else by its class."""
    by_class = F.lit(None).cast("double")
    for name, metres in table.items():
        by_class = F.when(kind == name, F.lit(metres)).otherwise(by_class)
    return F.coalesce(lanes * lane, per_direction * lane * F.when(oneway, 1).otherwise(2), by_class)


def arm_cut(widest_other: Column, width: Column, length: Column, n: Column) -> Column:
    """Sample at which an arm ends before a junction: clear of the widest other arm and of its own half, at most half way and 25 m."""
    far = F.least(F.greatest(widest_other / 2 + 1, width / 2 + 3), length / 2, F.lit(25.0))
    return F.greatest(F.lit(1), F.least(F.round(far * n / length), F.greatest(F.floor(n / 2), F.lit(1)))).cast("long")


def junction_shape(gaps: Column, nodes: Column, on_ring: Column) -> Column:
    """Class of an intersection by the angles between neighbouring arms, in order."""
    n, wide = F.size(gaps), lambda i, least: F.get(gaps, F.lit(i)) + F.get(gaps, F.lit(i + 1)) >= least
    return F.when(on_ring, "roundabout").when(nodes > 1, "dogleg").when(n == 3, F.when(F.array_max(gaps) >= 160, "T").otherwise("Y")).when((n == 4) & wide(0, 150) & wide(1, 150), "cross").otherwise("multi")
