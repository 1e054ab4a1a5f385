"""Lanes that lead into one another: along a section by number and touch, where two lists of lanes meet in their order across the
road, at a junction's arm by road and touch, through a turn by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators import spatial

#: Metres that two lanes' outlines must share, and how far a turn's end may lie from its lane.
TOUCH = 0.5
TURN_REACH = 1.5


def _directed(pairs: DataFrame, onward: Column) -> DataFrame:
    """lane, next of pairs (a, b): from a to b where the lane runs onward, else from b to a."""
    return pairs.select(F.when(onward, F.col("a")).otherwise(F.col("b")).alias("lane"), F.when(onward, F.col("b")).otherwise(F.col("a")).alias("next"))


def joint_links(parts: DataFrame) -> DataFrame:
    """lane, next: lane parts (part, section, k, direction, lane, t0, t1) of neighbouring subsections k and k + 1 with one direction and
    number (nulls are equal) that share at least TOUCH metres of the cut between them; t0 and t1 are offsets from the section's axis.
    A lane that runs backward leads from k + 1 to k."""
    side = lambda name, k: parts.select(F.col("section"), k.alias("at"), "direction", "lane", F.struct("part", "t0", "t1").alias(name))
    a, b = side("one", F.col("k")).alias("a"), side("two", F.col("k") - 1).alias("b")
    same = (F.col("a.section") == F.col("b.section")) & (F.col("a.at") == F.col("b.at"))
    for c in ("direction", "lane"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    shared = F.least("one.t1", "two.t1") - F.greatest("one.t0", "two.t0")
    met = a.join(b, same).filter(shared >= TOUCH).select(F.col("one.part").alias("a"), F.col("two.part").alias("b"), F.col("a.direction").alias("direction"))
    return _directed(met, ~F.col("direction").eqNullSafe("backward"))


def arm_links(ends: DataFrame, inner: DataFrame, touching: DataFrame) -> DataFrame:
    """lane, next: lane parts at a section's end (part, junction, road, direction, end: 0 first, 1 last) and lane parts inside the junction
    there (part, junction, road) of one road (nulls are equal) that share at least TOUCH metres; touching: (a, b, length), a at the end."""
    e = ends.select(F.col("part").alias("a"), "junction", F.col("road").alias("own"), "direction", "end")
    i = inner.select(F.col("part").alias("b"), "junction", F.col("road").alias("other"))
    met = touching.filter(F.col("length") >= TOUCH).select("a", "b").join(e, "a").join(i, ["b", "junction"]).filter(F.col("own").eqNullSafe(F.col("other")))
    return _directed(met, (F.col("end") == 1) == ~F.col("direction").eqNullSafe("backward"))


def turn_links(turns: DataFrame, places: DataFrame, reach: float = TURN_REACH) -> DataFrame:
    """lane, next: the lanes nearest to the begin and the end of each turn (turn, x0, y0, x1, y1), both within reach and not the same.
    places: points (lane, x, y) along the lanes, of ties the lane with the least number."""
    at = places.select(F.col("lane").alias("id"), "x", "y")
    ends = turns.select(F.explode(F.array(*[F.struct(F.struct("turn", F.lit(k).alias("end")).alias("id"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1)])).alias("e")).select("e.*")
    near = spatial.nearest(ends, at, reach).filter(F.col("d") <= reach)
    both = near.groupBy("id.turn").agg(*[F.max(F.when(F.col("id.end") == k, F.col("near_id"))).alias(c) for k, c in ((0, "lane"), (1, "next"))])
    return both.filter("lane <> next").select("lane", "next").distinct()


def _aligned(incoming: Column, outgoing: Column, miss: int) -> Column:
    """cost, alone, pairs of the best alignment of two lists (lane, t in millimetres) that are sorted by t: a table over their
    beginnings, one row for each incoming lane, of which only the last is kept. Neither list is empty."""
    pair = "struct<from_lane: bigint, to_lane: bigint>"

    def cell(cost: Column, alone: Column, pairs: Column) -> Column:
        return F.struct(cost.cast("long").alias("cost"), alone.cast("long").alias("alone"), pairs.cast(f"array<{pair}>").alias("pairs"))

    def skipped(c: Column) -> Column:
        return cell(c["cost"] + miss, c["alone"] + 1, c["pairs"])

    def row(before: Column, a: Column) -> Column:
        def add(now: Column, j: Column) -> Column:
            b, across = outgoing[j - 1], before[j - 1]
            paired = cell(across["cost"] + F.abs(a["t"] - b["t"]), across["alone"], F.concat(across["pairs"], F.array(F.struct(a["lane"].alias("from_lane"), b["lane"].alias("to_lane")))))
            return F.concat(now, F.array(F.least(skipped(before[j]), skipped(now[j - 1]), paired)))

        return F.aggregate(F.sequence(F.lit(1), F.size(outgoing)), F.array(skipped(before[0])), add)

    first = F.transform(F.sequence(F.lit(0), F.size(outgoing)), lambda j: cell(j * miss, j, F.array()))
    return F.element_at(F.aggregate(incoming, first, row), -1)


def order_links(incoming: DataFrame, outgoing: DataFrame, node: str, miss: float) -> DataFrame:
    """node, from_lane, to_lane: lanes (node, lane, t: metres across the road, to a millimetre) that arrive at a node and leave it, paired in
    their order, so no two links of a node cross. What pairs are apart and `miss` metres for each lane without a partner are least
    together; of ties, fewest lanes without a partner, then least numbers from the left. Lanes without a place take no part.

    A node's lanes lie side by side across one road: their two lists are one row."""
    lane = F.struct(F.round(F.col("t") * 1000).cast("long").alias("t"), F.col("lane").cast("long").alias("lane"))
    lists = lambda df, name: df.filter("t IS NOT NULL AND lane IS NOT NULL").groupBy(node).agg(F.array_sort(F.collect_list(lane)).alias(name))
    both = lists(incoming, "_in").join(lists(outgoing, "_out"), node)
    best = both.select(node, _aligned(F.col("_in"), F.col("_out"), round(miss * 1000)).alias("_best"))
    return best.select(node, F.explode("_best.pairs").alias("_p")).select(node, "_p.*")


def neighbours(links: DataFrame) -> DataFrame:
    """lane, before, after: each lane of the links (lane, next) with the lanes that lead to it and those it leads to, in order, once each."""
    ways = links.select("lane", F.col("next").alias("after"), F.lit(None).cast(links.schema["lane"].dataType).alias("before"))
    back = links.select(F.col("next").alias("lane"), F.lit(None).cast(links.schema["next"].dataType).alias("after"), F.col("lane").alias("before"))
    return ways.unionByName(back).groupBy("lane").agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in ("before", "after")])
