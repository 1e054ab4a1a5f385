"""Lane links (STP13, GRF18): lanes derived from the lines of orders, an order being a section or a node."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import lanes
from kerbline.plans.joins import PART_POINT, SUPPLIER_POINT, columns
from kerbline.plans.registry import query, table

MISS = 9.0
PARTS = """part AS (SELECT l_orderkey * 100 + l_linenumber * 10 + lane AS part, l_orderkey AS section, l_linenumber AS k, lane,
  CASE l_returnflag WHEN 'A' THEN 'backward' WHEN 'N' THEN 'forward' END AS direction,
  (lane - 1) * 3.0 + l_discount * 20 AS t0, (lane - 1) * 3.0 + l_discount * 20 + 2.0 + l_tax * 10 AS t1
  FROM (SELECT *, unnest(range(1, 2 + CAST(l_quantity AS BIGINT) % 3)) AS lane FROM lineitem))"""
LINKS = f"""{PARTS}, link AS (SELECT CASE WHEN a.direction IS NOT DISTINCT FROM 'backward' THEN b.part ELSE a.part END AS lane,
  CASE WHEN a.direction IS NOT DISTINCT FROM 'backward' THEN a.part ELSE b.part END AS next
  FROM part a JOIN part b ON a.section = b.section AND b.k = a.k + 1 AND a.lane = b.lane AND a.direction IS NOT DISTINCT FROM b.direction
  WHERE least(a.t1, b.t1) - greatest(a.t0, b.t0) >= 0.5)"""


def parts(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("lane", F.explode(F.sequence(F.lit(1), 1 + F.col("l_quantity").cast("long") % 3)))
    at = (F.col("lane") - 1) * 3.0 + F.col("l_discount") * 20
    direction = F.when(F.col("l_returnflag") == "A", "backward").when(F.col("l_returnflag") == "N", "forward")
    return l.select((F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("lane")).alias("part"), F.col("l_orderkey").alias("section"), F.col("l_linenumber").alias("k"), "lane", direction.alias("direction"), at.alias("t0"), (at + 2.0 + F.col("l_tax") * 10).alias("t1"))


@query("grf18_joint_links", f"WITH {LINKS} SELECT lane, next FROM link")
def joint_links(spark, sf):
    return lanes.joint_links(parts(spark, sf))


@query("grf18_neighbours", f"""WITH {LINKS}, way AS (SELECT lane, NULL AS before, next AS after FROM link UNION ALL SELECT next, lane, NULL FROM link)
  SELECT lane, coalesce(array_to_string(list_sort(list(DISTINCT before) FILTER (before IS NOT NULL)), ','), '') AS before,
    coalesce(array_to_string(list_sort(list(DISTINCT after) FILTER (after IS NOT NULL)), ','), '') AS after FROM way GROUP BY 1""")
def neighbours(spark, sf):
    n = lanes.neighbours(lanes.joint_links(parts(spark, sf)))
    return n.select("lane", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query("grf18_turn_links", f"""WITH t AS (SELECT p_partkey AS turn, {PART_POINT} FROM part), e AS (SELECT turn, 0 AS k, x, y FROM t UNION ALL SELECT turn, 1, x + 40, y + 25 FROM t),
  p AS (SELECT s_suppkey AS lane, {SUPPLIER_POINT} FROM supplier), near AS (SELECT turn, k, arg_min(lane, (d, lane)) AS lane, min(d) AS d FROM
    (SELECT turn, k, lane, sqrt((e.x - p.x) * (e.x - p.x) + (e.y - p.y) * (e.y - p.y)) AS d FROM e, p) GROUP BY 1, 2)
  SELECT DISTINCT a.lane, b.lane AS next FROM near a JOIN near b USING (turn) WHERE a.k = 0 AND b.k = 1 AND a.d <= 60 AND b.d <= 60 AND a.lane <> b.lane""")
def turn_links(spark, sf):
    t = table(spark, sf, "part").selectExpr("p_partkey AS turn", *columns(PART_POINT))
    t = t.select("turn", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 40).alias("x1"), (F.col("y") + 25).alias("y1"))
    return lanes.turn_links(t, table(spark, sf, "supplier").selectExpr("s_suppkey AS lane", *columns(SUPPLIER_POINT)), reach=60.0)


@query("stp13_lane_order", f"""WITH RECURSIVE l AS (SELECT l_orderkey AS node, l_linenumber AS lane, CAST(round(l_extendedprice) AS BIGINT) AS t, l_returnflag = 'N' AS goes FROM lineitem),
  i AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY t, lane) AS k FROM l WHERE NOT goes), o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY t, lane) AS k FROM l WHERE goes),
  size AS (SELECT node, (SELECT count(*) FROM i WHERE i.node = n.node) + (SELECT count(*) FROM o WHERE o.node = n.node) AS n FROM (SELECT DISTINCT node FROM l) n),
  way(node, i, j, cost, n, pairs) AS (SELECT node, 0, 0, n * {round(MISS * 1000)}, 0, CAST([] AS STRUCT(f BIGINT, t BIGINT)[]) FROM size UNION ALL
    SELECT w.node, i.k, o.k, cost + abs(i.t - o.t) - {2 * round(MISS * 1000)}, w.n + 1, list_append(pairs, {{'f': i.lane, 't': o.lane}}) FROM way w JOIN i ON i.node = w.node AND i.k > w.i JOIN o ON o.node = w.node AND o.k > w.j),
  best AS (SELECT node, pairs FROM way QUALIFY row_number() OVER (PARTITION BY node ORDER BY cost, n DESC, pairs) = 1)
  SELECT node, p.f AS from_lane, p.t AS to_lane FROM (SELECT node, unnest(pairs) AS p FROM best)""")
def lane_order(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("lane"), (F.round("l_extendedprice") / 1000).alias("t"), "l_returnflag")
    return lanes.order_links(l.filter("l_returnflag <> 'N'"), l.filter("l_returnflag = 'N'"), "node", MISS)
