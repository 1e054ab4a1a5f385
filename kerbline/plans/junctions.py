"""Junction groups (GRF07, GRF10) of the customers' lattice (see blocks): groups of nodes are squares of it, rings its unit squares in
the corner of each four by four, halves of divided roads its edges to the right in neighbouring rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import graph, junctions
from kerbline.plans.blocks import NETWORK, W, lattice
from kerbline.plans.registry import query

AWAY, LONGEST, WIDEST = 60.0, 95.0, 105.0
PLACED = f"{NETWORK}, pt AS MATERIALIZED (SELECT n.*, c_nationkey AS nation, node % {W} AS i, node // {W} AS j FROM node n JOIN customer ON c_custkey = node)"
LINE = f"""{PLACED}, line AS MATERIALIZED (SELECT e.edge, e.source, e.target, e.street AS way, a.i, a.j, a.nation, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1
    FROM edge e JOIN pt a ON a.node = source JOIN pt b ON b.node = target),
  ends AS MATERIALIZED (SELECT source AS node, edge FROM line UNION ALL SELECT target, edge FROM line),
  deg AS MATERIALIZED (SELECT node, count(*) AS degree FROM ends GROUP BY 1)"""
SMALL = "small AS MATERIALIZED (SELECT node, i // 2 + 1000 * (j // 2) AS junction FROM pt WHERE nation % 3 > 0)"
LARGE = "large AS MATERIALIZED (SELECT node, i // 4 + 1000 * (j // 4) AS junction FROM pt)"
SQUARE = "square AS MATERIALIZED (SELECT *, i // 4 + 1000 * (j // 4) AS sq FROM line WHERE edge % 3 = 0 AND i % 4 = 0 AND j % 4 < 2 OR edge % 3 = 1 AND j % 4 = 0 AND i % 4 < 2)"
RING = f"{SQUARE}, ring AS MATERIALIZED (SELECT *, min(least(source, target)) OVER (PARTITION BY sq) AS ring FROM square QUALIFY count(*) OVER (PARTITION BY sq) = 4)"
PAIRS = f"pair AS MATERIALIZED (SELECT a.edge AS one, b.edge AS two FROM line a JOIN line b ON b.source = a.source + {W} AND a.edge % 3 = 0 AND b.edge % 3 = 0 AND a.j % 3 = 0)"


def network(spark, sf):
    """Nodes (node, x, y, nation, i, j) and edges (edge, source, target, way, i, j, length) that have both ends."""
    nodes, edges = lattice(spark, sf)
    nodes = nodes.withColumns({"i": F.col("node") % W, "j": F.floor(F.col("node") / W)})
    place = lambda end: nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in "xy"])
    e = edges.withColumnRenamed("street", "way").join(place("source"), "source").join(place("target"), "target")
    e = e.withColumns({"i": F.col("source") % W, "j": F.floor(F.col("source") / W), "length": F.hypot(F.col("source_x") - F.col("target_x"), F.col("source_y") - F.col("target_y"))})
    return nodes, e


def small(nodes):
    return nodes.filter("nation % 3 > 0").select("node", (F.floor(F.col("i") / 2) + 1000 * F.floor(F.col("j") / 2)).alias("junction"))


def large(nodes):
    return nodes.select("node", (F.floor(F.col("i") / 4) + 1000 * F.floor(F.col("j") / 4)).alias("junction"))


def squares(edges):
    return edges.filter("edge % 3 = 0 AND i % 4 = 0 AND j % 4 < 2 OR edge % 3 = 1 AND j % 4 = 0 AND i % 4 < 2").select("edge", "source", "target")


def halves(edges):
    right = edges.filter("edge % 3 = 0")
    one = right.filter("j % 3 = 0").select(F.col("edge").alias("one"), (F.col("source") + W).alias("source"))
    return one.join(right.select(F.col("edge").alias("two"), "source"), "source").select("one", "two")


@query("grf10_contracted", f"WITH {LINE}, {SMALL}, n AS (SELECT edge, coalesce(s.junction, -source - 1) AS s, coalesce(t.junction, -target - 1) AS t FROM line LEFT JOIN small s ON s.node = source LEFT JOIN small t ON t.node = target) SELECT edge, CASE WHEN s <> t THEN least(s, t) END AS a, CASE WHEN s <> t THEN greatest(s, t) END AS b, CASE WHEN s <> t THEN min(edge) OVER (PARTITION BY least(s, t), greatest(s, t)) END AS link FROM n")
def contracted(spark, sf):
    nodes, edges = network(spark, sf)
    return junctions.contracted(edges, small(nodes))


@query("grf10_rings", f"WITH {LINE}, {RING} SELECT edge, ring FROM ring")
def rings(spark, sf):
    return junctions.rings(squares(network(spark, sf)[1]))


@query("grf10_split", f"""WITH RECURSIVE {LINE}, {RING}, {LARGE}, arm AS MATERIALIZED (SELECT DISTINCT junction, edge, x0, y0, x1, y1 FROM ring JOIN large ON node IN (source, target)),
  away AS (SELECT node, junction, min(sqrt((x - x0 - f * (x1 - x0)) ** 2 + (y - y0 - f * (y1 - y0)) ** 2)) AS d FROM (
    SELECT l.node, l.junction, x, y, a.*, least(1, greatest(0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS f
    FROM large l JOIN pt USING (node) JOIN arm a USING (junction)) GROUP BY 1, 2),
  off AS MATERIALIZED (SELECT node, junction FROM away WHERE d > {AWAY}),
  hop AS MATERIALIZED (SELECT s.node AS a, t.node AS b FROM line JOIN off s ON s.node = source JOIN off t ON t.node = target AND t.junction = s.junction),
  both_ AS MATERIALIZED (SELECT a, b FROM hop UNION SELECT b, a FROM hop), go(node, seen) AS (SELECT node, node FROM off UNION SELECT g.node, b FROM go g JOIN both_ ON a = seen),
  part AS MATERIALIZED (SELECT node, min(seen) AS root FROM go GROUP BY 1), real_ AS (SELECT root FROM part LEFT JOIN deg USING (node) GROUP BY 1 HAVING max(degree) >= 3)
  SELECT l.node, CASE WHEN p.root IN (SELECT root FROM real_) THEN -p.root - 1 ELSE l.junction END AS junction, l.junction AS was FROM large l LEFT JOIN part p USING (node)""")
def split(spark, sf):
    nodes, edges = network(spark, sf)
    return junctions.split_around_rings(large(nodes), nodes, edges, junctions.rings(squares(edges)), AWAY)


@query("grf10_divided", f"""WITH RECURSIVE {LINE}, {SMALL}, way AS MATERIALIZED (SELECT edge, unnest([source, target]) AS node, atan2(y1 - y0, x1 - x0) + CASE j % 2 WHEN 0 THEN 0 ELSE pi() END AS h FROM line WHERE edge % 3 = 0),
  link AS (SELECT edge, source, target, s.junction AS a, t.junction AS b FROM line JOIN small s ON s.node = source JOIN small t ON t.node = target AND s.junction <> t.junction
    WHERE sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) < {LONGEST} AND s.junction % 7 > 0 AND t.junction % 7 > 0),
  met AS MATERIALIZED (SELECT DISTINCT a, b FROM link l JOIN way p ON p.node = source AND p.edge <> l.edge JOIN way q ON q.node = target AND q.edge <> l.edge WHERE cos(p.h - q.h) < -0.8),
  both_ AS MATERIALIZED (SELECT a, b FROM met UNION SELECT b, a FROM met), go(junction, seen) AS (SELECT DISTINCT junction, junction FROM small UNION SELECT g.junction, b FROM go g JOIN both_ ON a = seen)
  SELECT node, root AS junction FROM small JOIN (SELECT junction, min(seen) AS root FROM go GROUP BY 1) USING (junction)""")
def divided(spark, sf):
    nodes, edges = network(spark, sf)
    groups = small(nodes)
    heading = F.degrees(F.atan2(F.col("target_y") - F.col("source_y"), F.col("target_x") - F.col("source_x"))) + F.when(F.col("j") % 2 == 0, 0.0).otherwise(180.0)
    travel = edges.filter("edge % 3 = 0").select("edge", heading.alias("heading"), F.explode(F.array("source", "target")).alias("node"))
    return junctions.divided_crossings(groups, edges, travel, LONGEST, groups.filter("junction % 7 = 0").select("junction").distinct())


@query("grf07_forced", f"""WITH {LINE}, {PAIRS}, two_way AS (SELECT one, two FROM pair UNION ALL SELECT two, one FROM pair),
  u AS (SELECT one, two, e.node FROM two_way JOIN ends e ON e.edge = one JOIN deg d ON d.node = e.node AND degree >= 3),
  v AS (SELECT u.*, o.node AS other, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS d FROM u JOIN ends o ON o.edge = two JOIN line l ON l.edge = two JOIN pt p ON p.node = u.node JOIN pt q ON q.node = o.node
    WHERE NOT EXISTS (SELECT 1 FROM line w WHERE w.way = l.way AND u.node IN (w.source, w.target))),
  best AS (SELECT DISTINCT node, other FROM (SELECT node, arg_min(other, (d, other)) AS other, min(d) AS d FROM v GROUP BY one, two, node) WHERE d <= {WIDEST})
  SELECT b.node, other, degree < 3 AS forced FROM best b JOIN deg ON deg.node = other""")
def forced(spark, sf):
    nodes, edges = network(spark, sf)
    return junctions.forced_junctions(halves(edges), edges.select("edge", "source", "target", "way"), nodes, WIDEST)


@query("grf07_same_ends", f"""WITH RECURSIVE {LINE}, {PAIRS}, jn AS (SELECT node, i // 2 + 1000 * (j // 3) AS junction FROM pt JOIN deg USING (node) WHERE degree >= 3),
  x AS MATERIALIZED (SELECT a.edge AS a, b.edge AS b FROM ends a JOIN ends b USING (node) JOIN deg USING (node) WHERE degree = 2), go(edge, seen) AS (SELECT edge, edge FROM line UNION SELECT g.edge, x.b FROM go g JOIN x ON x.a = seen),
  chain AS MATERIALIZED (SELECT edge, min(seen) AS street FROM go GROUP BY 1),
  es AS MATERIALIZED (SELECT street, coalesce(list_sort(list(DISTINCT junction) FILTER (junction IS NOT NULL)), []) AS js FROM chain JOIN ends USING (edge) LEFT JOIN jn USING (node) GROUP BY 1),
  met AS MATERIALIZED (SELECT c.street AS a, d.street AS b FROM pair JOIN chain c ON c.edge = one JOIN chain d ON d.edge = two JOIN es e ON e.street = c.street JOIN es f ON f.street = d.street WHERE e.js = f.js AND c.street <> d.street),
  both_ AS MATERIALIZED (SELECT a, b FROM met UNION SELECT b, a FROM met), up(street, seen) AS (SELECT DISTINCT street, street FROM chain UNION SELECT u.street, b FROM up u JOIN both_ ON a = seen)
  SELECT edge, section FROM chain JOIN (SELECT street, min(seen) AS section FROM up GROUP BY 1) USING (street)""")
def same_ends(spark, sf):
    nodes, edges = network(spark, sf)
    plain, degree = edges.select("edge", "source", "target"), graph.degree(edges)
    chains = graph.streets(plain.withColumn("one", F.lit(1)), ["one"], degree.filter("degree = 2").select("node"))
    groups = nodes.join(degree.filter("degree >= 3"), "node").select("node", (F.floor(F.col("i") / 2) + 1000 * F.floor(F.col("j") / 3)).alias("junction"))
    return junctions.same_ends(chains, plain, groups, halves(edges))
