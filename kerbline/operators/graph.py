"""Networks as edge tables (edge, source, target): degrees, components, chains, distances, trees.

Iterations end their lineage with checkpoint(), in the folder that the cluster names in spark.checkpoint.dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.store import cut


def ends(edges: DataFrame) -> DataFrame:
    """One row per end of an edge: node, edge."""
    return edges.select(F.explode(F.array("source", "target")).alias("node"), "edge")


def degree(edges: DataFrame) -> DataFrame:
    """node, degree; a loop counts twice."""
    return ends(edges).groupBy("node").agg(F.count("*").alias("degree"))


def components(links: DataFrame) -> DataFrame:
    """node, root of links (a, b): the least node that can be reached. Large stars and small stars in turn: each round is minima
    and joins on node, so a hub is never gathered, and the rounds grow with the logarithm of the longest chain."""
    now = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        now = cut(large.join(low, "a").select(F.inline(pairs)).filter("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def streets(edges: DataFrame, by: list[str], joints: DataFrame | None = None) -> DataFrame:
    """edge, street: edges of one group (such as level and name) that share a node belong to one street, called by its least edge.
    With joints (node), only those nodes join edges: sections between junctions."""
    e = ends(edges) if joints is None else ends(edges).join(joints.select("node"), "node", "left_semi")
    own = e.join(edges.select("edge", *by), "edge").filter(" AND ".join(f"{c} IS NOT NULL" for c in by))
    # Each edge at a node is linked to the least edge of its group there: as many links as ends.
    least = F.min("edge").over(Window.partitionBy("node", *by))
    linked = components(own.select(F.col("edge").alias("a"), least.alias("b")))
    return edges.select("edge").join(linked.withColumnRenamed("node", "edge"), "edge", "left").select("edge", F.coalesce("root", "edge").alias("street"))


def distances(edges: DataFrame, sources: DataFrame, length: str, most: float | None = None) -> DataFrame:
    """node, d: the shortest way from any source over undirected edges, by rounds of relaxation; only nodes that came nearer go on."""
    both = edges.select("source", "target", length).unionAll(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), length))
    both = cut(both.groupBy("source", "target").agg(F.min(length).alias("w")))
    best = cut(sources.select("node").distinct().withColumn("d", F.lit(0.0)))
    fresh = best
    while not fresh.isEmpty():
        reach = fresh.join(both, fresh["node"] == both["source"]).groupBy(F.col("target").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("n"))
        if most is not None:
            reach = reach.filter(F.col("n") <= most)
        j = cut(best.join(reach, "node", "full_outer").withColumn("nearer", F.col("n").isNotNull() & (F.col("d").isNull() | (F.col("n") < F.col("d")))))
        best = j.select("node", F.when(F.col("nearer"), F.col("n")).otherwise(F.col("d")).alias("d"))
        fresh = j.filter("nearer").select("node", F.col("n").alias("d"))
    return best


def continuations(ends_: DataFrame, least_angle: float = 135.0) -> DataFrame:
    """node, a, b: pairs of ends (node, edge, heading) that each are the other's most opposite one at their node, within 45 degrees of straight.

    Ends are told apart by their headings: of a node's ends with one heading only the two least edges can be another's choice, and all
    look for theirs at once. So pairs grow with a node's different headings and not with its ends."""
    some = ends_.filter("node IS NOT NULL AND edge IS NOT NULL AND heading IS NOT NULL").select("node", "edge", "heading")
    low = some.groupBy("node", "heading").agg(F.min("edge").alias("low"))
    more = some.join(low, ["node", "heading"]).filter(F.col("edge") > F.col("low")).groupBy("node", "heading").agg(F.min("edge").alias("more"))
    at = cut(low.join(more, ["node", "heading"], "left").select("node", "heading", F.filter(F.array("low", "more"), lambda e: e.isNotNull()).alias("edges")))
    a, b = at.select("node", "heading").alias("a"), at.hint("merge").alias("b")
    turn = F.abs(F.pmod(F.col("a.heading") - F.col("b.heading") + 180.0, F.lit(360.0)) - 180.0)
    pairs = a.join(b, F.col("a.node") == F.col("b.node")).filter(turn >= least_angle).select("a.node", "a.heading", turn.alias("turn"), F.explode("b.edges").alias("b"))
    offered = cut(pairs.groupBy("node", "heading", "b").agg(F.max("turn").alias("turn")).select("node", "heading", F.struct((-F.col("turn")).alias("turn"), "b").alias("m")))
    one = offered.groupBy("node", "heading").agg(F.min("m").alias("one"))
    # An end whose own edge is the best of its heading takes the second best.
    two = offered.join(one, ["node", "heading"]).filter(F.col("m.b") != F.col("one.b")).groupBy("node", "heading").agg(F.min("m").alias("two"))
    own = some.join(one.join(two, ["node", "heading"], "left").hint("merge"), ["node", "heading"])
    choice = F.when(F.col("one.b") != F.col("edge"), F.col("one")).otherwise(F.col("two"))
    best = own.groupBy("node", F.col("edge").alias("a")).agg(F.min(choice).alias("m")).select("node", "a", F.col("m.b").alias("b")).filter("b IS NOT NULL")
    back = best.select("node", F.col("b").alias("a"), F.col("a").alias("b"))
    return best.select("node", "a", "b").join(back, ["node", "a", "b"], "left_semi").filter("a < b")


def tree_paths(nodes: DataFrame, most_ranks: int = 7) -> DataFrame:
    """id, root, rank of a strict tree (id, parent): parents are followed for all nodes at once, doubling the step each round."""
    now = nodes.select("id", F.coalesce("parent", "id").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("steps"))
    for _ in range(max(1, (most_ranks - 1).bit_length())):
        up = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        now = cut(now.join(up, "up", "left").select("id", F.coalesce("next", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    return now.select("id", F.col("up").alias("root"), F.col("steps").cast("long").alias("rank"))


def spread(flags: DataFrame, links: DataFrame, rounds: int = 5) -> DataFrame:
    """id, level: a level passes from known ids over links (id, next) to ids without one, the highest winning, for some rounds at most."""
    now = flags
    for _ in range(rounds):
        offered = now.filter("level IS NOT NULL").join(links, "id").groupBy(F.col("next").alias("id")).agg(F.max("level").alias("offered"))
        j = cut(now.join(offered, "id", "left"))
        if j.filter("level IS NULL AND offered IS NOT NULL").isEmpty():
            break
        now = j.select("id", F.coalesce("level", "offered").alias("level"))
    return now


def chains(edges: DataFrame) -> DataFrame:
    """edge, chain, k, forward: edges joined at nodes of degree two are one line; k is an edge's place in it, forward whether it runs
    along it. A line is called by its least edge, and begins at the end that has the lesser edge; a ring begins at its least edge.
    Pointers to the next edge are doubled each round, in both directions at once, so rounds grow with the logarithm of the longest line."""
    two = degree(edges).filter("degree = 2").select("node")
    named = streets(edges.withColumn("_all", F.lit(1)), ["_all"], two).withColumnRenamed("street", "chain")
    e = edges.select("edge", "source", "target").join(named, "edge")
    # Each edge is run through along (d = 1) and against (d = -1): from node a to node b.
    run = e.select("edge", "chain", F.inline(F.array(F.struct(F.lit(1).alias("d"), F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.lit(-1).alias("d"), F.col("target").alias("a"), F.col("source").alias("b")))))
    x, y = run.join(two.withColumnRenamed("node", "b"), "b", "left_semi").alias("x"), run.alias("y")
    step = x.join(y, (F.col("x.b") == F.col("y.a")) & (F.col("x.edge") != F.col("y.edge")))
    # A ring is cut before its least edge, in both directions; in an open line the same cut is taken back below, as nothing comes before it there.
    ring = ends(e).join(two, "node", "left_semi").groupBy("edge").agg(F.count("*").alias("n")).join(named, "edge").groupBy("chain").agg(F.sum("n").alias("n"))
    ring = ring.join(named.groupBy("chain").agg(F.count("*").alias("m")), "chain").filter("n = 2 * m").select(F.col("chain").alias("_ring"))
    into = (F.col("y.edge") == F.col("y.chain")) & (F.col("y.d") == 1)
    out = (F.col("x.edge") == F.col("x.chain")) & (F.col("x.d") == -1)
    kept = step.join(ring, F.col("x.chain") == F.col("_ring"), "left").filter(F.col("_ring").isNull() | ~(into | out))
    follows = kept.select(F.col("x.edge").alias("edge"), F.col("x.d").alias("d"), F.struct(F.col("y.edge").alias("edge"), F.col("y.d").alias("d")).alias("next"))
    now = cut(run.select("edge", "d").join(follows, ["edge", "d"], "left").select(F.struct("edge", "d").alias("at"), "next", F.coalesce("next.edge", "edge").alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).alias("steps")))
    while not now.filter("next IS NOT NULL").isEmpty():
        ahead = now.select(F.col("at").alias("next"), F.col("next").alias("then"), F.col("last").alias("far"), F.col("steps").alias("more"))
        now = cut(now.join(ahead, "next", "left").select("at", F.col("then").alias("next"), F.coalesce("far", "last").alias("last"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    found = now.select("at.edge", "at.d", "last", "steps").groupBy("edge").agg(*[F.max(F.when(F.col("d") == d, F.struct("last", "steps"))).alias(n) for d, n in ((1, "on"), (-1, "back"))])
    along = F.col("back.last") <= F.col("on.last")
    return named.join(found, "edge").select("edge", "chain", F.when(along, F.col("back.steps")).otherwise(F.col("on.steps")).cast("long").alias("k"), along.alias("forward"))
