"""Junctions as groups of nodes: the network between them, groups cut back to a roundabout's ring, and what the two halves of a
divided road share."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import shapes as g
from kerbline.operators import graph, spatial

#: Directions are told apart in this many sectors of a circle before pairs are made.
SECTORS = 90


def contracted(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """edge, a, b, link: edges (edge, source, target) between groups (node, junction) of nodes; a node of no group is one by itself,
    called by its negative number less one. a <= b are the two groups, null a and b where an edge lies within one, and link, its
    least edge, calls all edges between the same two groups: the edges that it stands for are its rows."""
    of = lambda end, name: groups.select(F.col("node").alias(end), F.col("junction").alias(name))
    both = edges.select("edge", "source", "target").join(of("source", "_s"), "source", "left").join(of("target", "_t"), "target", "left")
    s, t = F.coalesce("_s", -F.col("source") - 1), F.coalesce("_t", -F.col("target") - 1)
    ends = both.select("edge", F.when(s != t, F.least(s, t)).alias("a"), F.when(s != t, F.greatest(s, t)).alias("b"))
    links = ends.filter("a IS NOT NULL").groupBy("a", "b").agg(F.min("edge").alias("link"))
    # Between two groups there may be very many edges; the join can be split, as its other side is one row.
    return ends.join(links, ["a", "b"], "left").select("edge", "a", "b", "link")


def rings(edges: DataFrame) -> DataFrame:
    """edge, ring: which of some edges (edge, source, target) close to rings: connected parts all of whose nodes have two ends, called
    by their least node."""
    part = graph.components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    whole = graph.degree(edges).join(part, "node").groupBy("root").agg(F.bool_and(F.col("degree") == 2).alias("ring")).filter("ring").select("root")
    return edges.join(part.withColumnRenamed("node", "source"), "source").join(whole, "root", "left_semi").select("edge", F.col("root").alias("ring"))


def split_around_rings(groups: DataFrame, nodes: DataFrame, edges: DataFrame, ring_edges: DataFrame, away: float) -> DataFrame:
    """node, junction, was: groups (node, junction) with a node on a ring (ring_edges: edge) keep what lies within `away` of their
    ring. Farther nodes, as far as edges between them lead, are junctions of their own, called by minus their least node less one,
    if one of them has three edges or more; else they stay."""
    place = lambda end, p: nodes.select(F.col("node").alias(end), g.point(F.col("x"), F.col("y")).alias(p))
    of_ring = edges.join(ring_edges.select("edge"), "edge", "left_semi").join(place("source", "p"), "source").join(place("target", "q"), "target")
    ends = F.explode(F.array("source", "target")).alias("node")
    at = of_ring.select("edge", "p", "q", ends).join(groups, "node")
    held = at.select("junction").distinct()
    on_ring = at.select("node", "junction").distinct()
    box = lambda c, f, by: f(F.col(f"p.{c}"), F.col(f"q.{c}")) + by
    arms = at.select("junction", "edge", "p", "q").distinct()
    arms = arms.withColumns({"x0": box("x", F.least, -away), "y0": box("y", F.least, -away), "x1": box("x", F.greatest, away), "y1": box("y", F.greatest, away)})
    inside = groups.join(held, "junction", "left_semi").join(nodes, "node")
    points = inside.select("node", "junction", g.point(F.col("x"), F.col("y")).alias("at"), *[F.col(c).alias(f"{c}{k}") for k in (0, 1) for c in "xy"])
    near = spatial.box_join(points, arms, max(away, 1e-9) * 2).filter("a.junction = b.junction")
    near = near.filter(g.distance_to(F.array("b.p", "b.q"), F.col("a.at")) <= away).select("a.node", "a.junction").distinct()
    off = inside.select("node", "junction").join(near, ["node", "junction"], "left_anti").join(on_ring, ["node", "junction"], "left_anti")
    end = lambda name, j: off.select(F.col("node").alias(name), F.col("junction").alias(j))
    between = edges.join(end("source", "_s"), "source").join(end("target", "_t"), "target").filter("_s = _t")
    part = graph.components(between.select(F.col("source").alias("a"), F.col("target").alias("b")))
    named = off.join(part, "node", "left").withColumn("root", F.coalesce("root", "node")).join(graph.degree(edges), "node", "left")
    real = named.groupBy("junction", "root").agg(F.max("degree").alias("most")).filter("most >= 3").select("junction", "root")
    new = named.join(real, ["junction", "root"], "left_semi").select("node", "junction", (-F.col("root") - 1).alias("own"))
    return groups.join(new, ["node", "junction"], "left").select("node", F.coalesce("own", "junction").alias("junction"), F.col("junction").alias("was"))


def divided_crossings(groups: DataFrame, edges: DataFrame, travel: DataFrame, longest: float, never: DataFrame) -> DataFrame:
    """node, junction: groups (node, junction) joined where one road crosses both halves of a divided road: by an edge (edge, source,
    target, length) shorter than `longest` at whose two ends one-way edges (travel: node, edge, heading in degrees) run opposite
    ways, within what a cosine of -0.8 allows. Groups of `never` (junction) stay as they are."""
    of = lambda end, name: groups.select(F.col("node").alias(end), F.col("junction").alias(name))
    links = edges.filter(F.col("length") < longest).join(of("source", "_s"), "source").join(of("target", "_t"), "target").filter("_s <> _t")
    for name in ("_s", "_t"):
        links = links.join(never.select(F.col("junction").alias(name)), name, "left_anti")
    sector = F.floor(F.pmod("heading", F.lit(360.0)) * SECTORS / 360.0)
    at = travel.withColumn("heading", F.pmod("heading", F.lit(360.0))).withColumn("sector", sector)
    # Of a sector's headings the two outermost tell enough; the link's own heading is left out by counting it apart.
    width = 180.0 - math.degrees(math.acos(-0.8))

    def seen(end: str, name: str) -> DataFrame:
        own = links.select("edge", F.col(end).alias("node")).join(at.withColumnRenamed("edge", "other"), "node").filter("edge <> other")
        return own.groupBy("edge", "sector").agg(F.min("heading").alias(f"{name}0"), F.max("heading").alias(f"{name}1")).drop("sector")

    both = seen("source", "a").join(seen("target", "b"), "edge")
    apart = lambda x, y: F.abs(F.pmod(F.col(x) - F.col(y), F.lit(360.0)) - 180.0)
    near = F.least(*[apart(x, y) for x in ("a0", "a1") for y in ("b0", "b1")]) < width
    # Headings between the outermost of both are closer than the sectors are wide, and so within the bound.
    joins = links.join(both.filter(near).select("edge").distinct(), "edge", "left_semi")
    root = graph.components(joins.select(F.col("_s").alias("a"), F.col("_t").alias("b"))).select(F.col("node").alias("junction"), "root")
    return groups.join(root, "junction", "left").select("node", F.coalesce("root", "junction").alias("junction"))


def forced_junctions(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, widest: float) -> DataFrame:
    """node, other, forced: for each half (pairs one, two of edges) of a divided road, a junction node at its end and the nearest end
    of the other half, not farther than `widest`; forced where that end is no junction by itself. Nothing is asked of a half whose
    way (edges: edge, source, target, way) reaches the node itself."""
    degree = graph.degree(edges)
    both = pairs.select("one", "two").unionAll(pairs.select(F.col("two").alias("one"), F.col("one").alias("two")))
    spread = lambda e, n: edges.select(F.col("edge").alias(e), F.col("way").alias(f"{e}_way"), F.explode(F.array("source", "target")).alias(n))
    place = lambda n: nodes.select(F.col("node").alias(n), F.col("x").alias(f"{n}_x"), F.col("y").alias(f"{n}_y"))
    junction = degree.filter("degree >= 3").select(F.col("node").alias("node"))
    u = both.join(spread("one", "node"), "one").join(junction, "node", "left_semi").join(place("node"), "node")
    reached = spread("two", "node").select("node", "two_way").distinct()
    ends = u.join(spread("two", "other"), "two").join(reached, ["node", "two_way"], "left_anti").join(place("other"), "other")
    d = F.hypot(F.col("node_x") - F.col("other_x"), F.col("node_y") - F.col("other_y"))
    best = ends.groupBy("one", "two", "node").agg(F.min(F.struct(d.alias("d"), F.col("other"))).alias("m")).filter(F.col("m.d") <= widest)
    found = best.select("node", F.col("m.other").alias("other")).distinct().join(degree.withColumnRenamed("node", "other"), "other")
    return found.select("node", "other", (F.col("degree") < 3).alias("forced"))


def same_ends(chains: DataFrame, edges: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """edge, section: chains (edge, street) of which two that a pair of halves connects end at the same junctions are one section. A
    chain is a line, so it has two ends at most."""
    ends = graph.ends(edges).join(groups, "node").join(chains, "edge").select("street", "junction").distinct()
    of = ends.groupBy("street").agg(F.array_sort(F.collect_set("junction")).alias("ends"))
    all_ = chains.select("street").distinct().join(of, "street", "left").withColumn("ends", F.coalesce("ends", F.array().cast("array<bigint>")))
    name = lambda e, s: chains.select(F.col("edge").alias(e), F.col("street").alias(s))
    met = pairs.join(name("one", "a"), "one").join(name("two", "b"), "two").select("a", "b").filter("a <> b").distinct()
    met = met.join(all_.toDF("a", "a_ends"), "a").join(all_.toDF("b", "b_ends"), "b").filter("a_ends = b_ends")
    root = graph.components(met.select("a", "b")).select(F.col("node").alias("street"), "root")
    return chains.join(root, "street", "left").select("edge", F.coalesce("root", "street").alias("section"))
