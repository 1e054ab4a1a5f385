"""Graph operators (GRF) over a network derived from the parts: part k leads to part (7k + 3) mod n, streets by brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import graph
from kerbline.plans.registry import query, table

N = "(SELECT count(*) FROM part)"
EDGES = f"edges AS (SELECT p_partkey AS edge, p_partkey % 97 AS source, (p_partkey * 7 + 3) % 89 AS target, p_brand AS name, CAST(p_size AS DOUBLE) AS len FROM part)"
REACH = "RECURSIVE"


def edges(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    return p.select(k.alias("edge"), (k % 97).alias("source"), ((k * 7 + 3) % 89).alias("target"), F.col("p_brand").alias("name"), F.col("p_size").cast("double").alias("len"))


@query("grf01_degree", f"WITH {EDGES}, e AS (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) SELECT node, CAST(count(*) AS BIGINT) AS degree FROM e GROUP BY 1")
def degree(spark, sf):
    return graph.degree(edges(spark, sf))


@query("grf01_junctions", f"WITH {EDGES}, e AS (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges), d AS (SELECT node, count(*) AS degree FROM e GROUP BY 1) SELECT CASE WHEN degree = 1 THEN 'dead end' WHEN degree >= 3 THEN 'junction' ELSE 'joint' END AS kind, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY 1")
def junctions(spark, sf):
    d = graph.degree(edges(spark, sf))
    return d.groupBy(F.when(F.col("degree") == 1, "dead end").when(F.col("degree") >= 3, "junction").otherwise("joint").alias("kind")).agg(F.count("*").alias("n"))


@query("grf03_components", f"WITH {REACH} {EDGES}, l AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), r(node, seen) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen) SELECT node, min(seen) AS root FROM r GROUP BY 1")
def components(spark, sf):
    e = edges(spark, sf)
    c = graph.components(e.select(F.col("source").alias("a"), F.col("target").alias("b")))
    alone = graph.ends(e).select("node").distinct().join(c, "node", "left_anti").select("node", F.col("node").alias("root"))
    return c.unionByName(alone)


@query("grf03_streets", f"WITH {REACH} {EDGES}, e AS (SELECT source AS node, edge, name FROM edges UNION ALL SELECT target, edge, name FROM edges), l AS (SELECT DISTINCT x.edge AS a, y.edge AS b FROM e x JOIN e y USING (node, name)), r(edge, seen) AS (SELECT a, a FROM l UNION SELECT r.edge, l.b FROM r JOIN l ON l.a = r.seen) SELECT edge, min(seen) AS street FROM r GROUP BY 1")
def streets(spark, sf):
    return graph.streets(edges(spark, sf), ["name"])


@query("grf04_sections", f"WITH {REACH} {EDGES}, e AS (SELECT source AS node, edge, name FROM edges UNION ALL SELECT target, edge, name FROM edges), d AS (SELECT node FROM e GROUP BY 1 HAVING count(*) = 2), j AS (SELECT * FROM e WHERE node IN (SELECT node FROM d)), l AS (SELECT DISTINCT x.edge AS a, y.edge AS b FROM j x JOIN j y USING (node) UNION SELECT edge, edge FROM edges), r(edge, seen) AS (SELECT a, a FROM l UNION SELECT r.edge, l.b FROM r JOIN l ON l.a = r.seen) SELECT edge, min(seen) AS street FROM r GROUP BY 1")
def sections(spark, sf):
    e = edges(spark, sf).withColumn("all", F.lit(1))
    return graph.streets(e, ["all"], graph.degree(e).filter("degree = 2"))


@query("grf08_least_label", f"WITH {EDGES} SELECT name, min(edge) AS label, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY 1")
def least_label(spark, sf):
    return edges(spark, sf).groupBy("name").agg(F.min("edge").alias("label"), F.count("*").alias("n"))


@query("grf11_continuations", f"WITH {EDGES}, e AS (SELECT source AS node, edge, CAST(edge * 37 % 360 AS DOUBLE) AS heading FROM edges UNION ALL SELECT target, edge + 100000, CAST(edge * 53 % 360 AS DOUBLE) FROM edges), p AS (SELECT x.node, x.edge AS a, y.edge AS b, abs(((CAST(x.heading - y.heading + 180 AS BIGINT) % 360) + 360) % 360 - 180) AS turn FROM e x JOIN e y ON x.node = y.node AND x.edge <> y.edge), m AS (SELECT node, a, arg_max(b, (turn, -b)) AS b, max(turn) AS turn FROM p GROUP BY 1, 2), g AS (SELECT * FROM m WHERE turn >= 135) SELECT x.node, x.a, x.b FROM g x JOIN g y ON x.node = y.node AND x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def continuations(spark, sf):
    e = edges(spark, sf)
    s = e.select(F.col("source").alias("node"), "edge", (F.col("edge") * 37 % 360).cast("double").alias("heading"))
    t = e.select(F.col("target").alias("node"), (F.col("edge") + 100000).alias("edge"), (F.col("edge") * 53 % 360).cast("double").alias("heading"))
    return graph.continuations(s.unionByName(t))


@query("grf15_distances", f"WITH {REACH} {EDGES}, l AS (SELECT source AS a, target AS b, len FROM edges UNION ALL SELECT target, source, len FROM edges), w AS (SELECT a, b, min(len) AS len FROM l GROUP BY 1, 2), r(node, d, hops) AS (SELECT DISTINCT source, 0.0::DOUBLE, 0 FROM edges WHERE source IN (1, 50) UNION SELECT w.b, min(r.d + w.len), r.hops + 1 FROM r JOIN w ON w.a = r.node WHERE r.hops < 12 GROUP BY w.b, r.hops) SELECT node, min(d) AS d FROM r GROUP BY 1 HAVING min(d) <= 30")
def distances(spark, sf):
    e = edges(spark, sf)
    return graph.distances(e, e.filter("source IN (1, 50)").select(F.col("source").alias("node")), "len", most=30.0)


@query("grf17_tree", "WITH t AS (SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier) SELECT a.id, coalesce(c.id, b.id, a.id) AS root, CAST((b.id IS NOT NULL)::INT + (c.id IS NOT NULL)::INT AS BIGINT) AS rank FROM t a LEFT JOIN t b ON a.parent = b.id LEFT JOIN t c ON b.parent = c.id")
def tree(spark, sf):
    return graph.tree_paths(rank_tree(spark, sf))


def rank_tree(spark, sf):
    r, n, s = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    i = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return r.select(i("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent")).unionByName(n.select(i("n", "n_nationkey").alias("id"), i("r", "n_regionkey").alias("parent"))).unionByName(s.select(i("s", "s_suppkey").alias("id"), i("n", "s_nationkey").alias("parent")))


@query("grf20_spread", f"WITH {REACH} {EDGES}, l AS (SELECT DISTINCT source AS id, target AS nxt FROM edges), k AS (SELECT DISTINCT source AS id FROM edges UNION SELECT target FROM edges), r(id, hops) AS (SELECT id, 0 FROM k WHERE id < 3 UNION SELECT nxt, hops + 1 FROM r JOIN l ON l.id = r.id WHERE hops < 5) SELECT k.id, CASE WHEN r.id IS NOT NULL THEN 1 END AS level FROM k LEFT JOIN (SELECT DISTINCT id FROM r) r ON k.id = r.id")
def spread(spark, sf):
    e = edges(spark, sf)
    nodes = graph.ends(e).select(F.col("node").alias("id")).distinct().withColumn("level", F.when(F.col("id") < 3, 1))
    return graph.spread(nodes, e.select(F.col("source").alias("id"), F.col("target").alias("next")).distinct())
