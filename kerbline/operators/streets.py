"""Street-level operators: opposite carriageways, walks, lane orders, rules of several tables, simple outlines and curves."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import shapes as g
from kerbline.operators import spatial
from kerbline.operators.store import cut


def opposite_halves(ways: DataFrame, radius: float, least_angle: float) -> DataFrame:
    """one, two, d: ways (id, name, heading, x, y) of one name that run against each other within the radius."""
    against = F.abs(g.turn(F.col("a.heading"), F.col("b.heading"))) >= least_angle
    near = spatial.distance_join(ways, ways, radius, ("name",), ("heading",), against).filter("a.id < b.id")
    return near.select(F.col("a.id").alias("one"), F.col("b.id").alias("two"), "d")


def walks(starts: DataFrame, steps: DataFrame, most: float, hops: int) -> DataFrame:
    """start, reached, s: how far a walk gets along steps (a, b, len), one out of each node, within a length and a number of hops.
    All walks take a step together; those that cannot go on stay."""
    now = starts.select("start", F.col("start").alias("node"), F.lit(0.0).alias("s"), F.lit(True).alias("open"))
    # By sort and merge: a broadcast of all steps would go through the driver at each hop.
    steps = cut(steps.repartition("a")).hint("merge")
    for k in range(hops):
        ahead = now.join(steps, F.col("node") == F.col("a"), "left")
        go = F.col("open") & F.col("b").isNotNull() & (F.col("s") + F.col("len") <= most)
        now = ahead.select("start", F.when(go, F.col("b")).otherwise(F.col("node")).alias("node"), F.when(go, F.col("s") + F.col("len")).otherwise(F.col("s")).alias("s"), F.coalesce(go, F.lit(False)).alias("open")).persist()
        if now.filter("open").isEmpty():
            break
    return now.select("start", F.col("node").alias("reached"), "s")


def in_order(incoming: DataFrame, outgoing: DataFrame, node: str, offset: str) -> DataFrame:
    """The k-th incoming lane at a node, left to right, beside the k-th outgoing one: node, in_lane, out_lane."""
    k = F.row_number().over(Window.partitionBy(node).orderBy(offset))
    i, o = incoming.select(node, F.col("lane").alias("in_lane"), k.alias("_k")), outgoing.select(node, F.col("lane").alias("out_lane"), k.alias("_k"))
    return i.join(o, [node, "_k"]).drop("_k")


def last_table_wins(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several tables of one shape, one per key: that of the last table that has the key."""
    whole = None
    for k, t in enumerate(tables):
        t = t.withColumn("_rank", F.lit(k))
        whole = t if whole is None else whole.unionByName(t)
    values = [c for c in tables[0].columns if c not in keys]
    return whole.groupBy(*keys).agg(F.max_by(F.struct(*values), "_rank").alias("_v")).select(*keys, *[f"_v.{c}" for c in values])


def hulls(points: DataFrame, by: str) -> DataFrame:
    """by, hull: the convex hull of each group's points (p), closed, counter-clockwise. Points inside a group's box of extremes are
    few in practice; a group is one intersection or one building."""

    def half(some: list) -> list:
        out: list = []
        for q in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    def hulls_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Very many small groups: a batch of them at a time."""
        for batch in batches:
            lists, flat, ends = batch.column(1), batch.column(1).flatten(), [0]
            x, y = flat.field("x").to_pylist(), flat.field("y").to_pylist()
            out: list = []
            start = 0
            for n in lists.value_lengths().to_pylist():
                pts = sorted(set(zip(x[start : start + n], y[start : start + n], strict=True)))
                start += n
                out += half(pts)[:-1] + half(pts[::-1])
                ends.append(len(out))
            both = [pa.array([p[k] for p in out], pa.float64()) for k in (0, 1)]
            ring = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(both, ["x", "y"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), ring], [by, "hull"])

    kind = points.schema[by].dataType.simpleString()
    return points.groupBy(by).agg(F.collect_list("p").alias("p")).filter(F.size("p") > 0).mapInArrow(hulls_of, f"{by} {kind}, hull array<{g.POINT}>")


def straight(line: Column, tolerance: float) -> Column:
    """The chord of a line that stays within the tolerance of it, else the line."""
    chord = F.array(g.start(line), g.end(line))
    off = F.array_max(F.transform(line, lambda p: g.distance_to(chord, p)))
    return F.when(off <= tolerance, chord).otherwise(line)


def quadratic(a: Column, bend: Column, b: Column, n: int) -> Column:
    """n points of the curve from a to b that leaves and arrives along the lines to the bend."""

    def at(k: Column) -> Column:
        t = k / (n - 1)
        mix = lambda c: (1 - t) * (1 - t) * a[c] + 2 * (1 - t) * t * bend[c] + t * t * b[c]
        return g.point(mix("x"), mix("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def followed(lanes: DataFrame, links: DataFrame, hops: int = 20) -> DataFrame:
    """start, reached: where a lane (lane, junction: whether it ends at one) leads, along links (lane, next) as long as it has one
    next lane, and no junction lies between."""
    single = links.groupBy("lane").agg(F.count("*").alias("n"), F.first("next").alias("b")).filter("n = 1")
    steps = single.join(lanes.filter("NOT junction").select("lane"), "lane").select(F.col("lane").alias("a"), "b", F.lit(0.0).alias("len"))
    return walks(lanes.select(F.col("lane").alias("start")), steps, most=0.0, hops=hops).select("start", "reached")


def divided_pairs(stations: DataFrame, within: float, share: float) -> DataFrame:
    """one, two: runs of one name most of whose stations (run, name, x, y) lie within a distance of the other's, either way."""
    n = stations.groupBy("run").agg(F.count("*").alias("n"))
    # Stations of one run, name and place are near to the same runs: they are paired once, and counted.
    s = stations.groupBy("run", "name", "x", "y").agg(F.count("*").alias("k"))
    near = spatial.distance_join(s, s.drop("k"), within, ("name",), ("run",), F.col("a.run") != F.col("b.run"))
    near = near.select("a.run", F.col("b.run").alias("other"), "a.name", "a.x", "a.y", "a.k").distinct()
    held = near.groupBy("run", "other").agg(F.sum("k").alias("held"))
    good = held.join(n, "run").filter(F.col("held") >= share * F.col("n")).select("run", "other")
    both = good.join(good.select(F.col("other").alias("run"), F.col("run").alias("other")), ["run", "other"], "left_semi")
    return both.filter("run < other").select(F.col("run").alias("one"), F.col("other").alias("two"))
