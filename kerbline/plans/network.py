"""More network and street operators (GRF, GEO, MAT, API) over shapes and links derived from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline.functions import shapes as g
from kerbline.operators import facets, filters, series, spatial, streets
from kerbline.plans.geometry import BOX, lines, rings
from kerbline.plans.joins import PART_POINT, SUPPLIER_POINT, columns
from kerbline.plans.registry import query, table


@query("grf06_carriageway_pairs", f"WITH p AS (SELECT p_partkey AS id, p_size % 5 AS name, CAST(p_partkey * 37 % 360 AS DOUBLE) AS heading, {PART_POINT} FROM part) SELECT a.id AS one, b.id AS two FROM p a JOIN p b ON a.id < b.id AND a.name = b.name AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600 AND abs(((CAST(a.heading - b.heading + 180 AS BIGINT) % 360) + 360) % 360 - 180) >= 135")
def carriageway_pairs(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_size % 5 AS name", "CAST(p_partkey * 37 % 360 AS DOUBLE) AS heading", *columns(PART_POINT))
    return streets.opposite_halves(p, radius=40.0, least_angle=135.0).select("one", "two")


@query("grf16_walks", "WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + 1 + p_size % 3 AS b, CAST(p_size AS DOUBLE) AS len FROM part), w(start, node, s, hops) AS (SELECT a, a, 0.0::DOUBLE, 0 FROM e UNION ALL SELECT w.start, e.b, w.s + e.len, hops + 1 FROM w JOIN e ON e.a = w.node WHERE w.s + e.len <= 80 AND hops < 20) SELECT start, arg_max(node, hops) AS reached, max(s) AS s FROM w GROUP BY 1")
def walks(spark, sf):
    p = table(spark, sf, "part")
    e = p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1 + F.col("p_size") % 3).alias("b"), F.col("p_size").cast("double").alias("len"))
    return streets.walks(e.select(F.col("a").alias("start")), e, most=80.0, hops=20)


@query("grf19_merge_order", "WITH i AS (SELECT l_orderkey AS node, l_linenumber AS lane, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey) AS k FROM lineitem WHERE l_returnflag = 'N'), o AS (SELECT l_orderkey AS node, l_linenumber AS lane, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey) AS k FROM lineitem WHERE l_returnflag <> 'N') SELECT i.node, i.lane AS from_lane, o.lane AS to_lane FROM i JOIN o ON i.node = o.node AND i.k = o.k")
def merge_order(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("lane"), F.struct("l_extendedprice", "l_linenumber", "l_partkey").alias("offset"), "l_returnflag")
    return streets.in_order(l.filter("l_returnflag = 'N'"), l.filter("l_returnflag <> 'N'"), "node", "offset").select("node", F.col("in_lane").alias("from_lane"), F.col("out_lane").alias("to_lane"))


@query("grf25_later_rule_wins", "WITH r AS (SELECT l_orderkey AS k, 1 AS t, min(l_discount) AS rule FROM lineitem WHERE l_discount > 0.05 GROUP BY 1 UNION ALL SELECT o_orderkey, 2, 1.0 FROM orders WHERE o_orderstatus = 'F'), w AS (SELECT k, arg_max(rule, t) AS rule FROM r GROUP BY 1) SELECT o_orderkey, rule FROM orders LEFT JOIN w ON k = o_orderkey")
def later_rule_wins(spark, sf):
    one = table(spark, sf, "lineitem").filter("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_discount").alias("rule"))
    two = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.lit(1.0).alias("rule"))
    return table(spark, sf, "orders").select("o_orderkey").join(streets.last_table_wins([one, two], ["o_orderkey"]), "o_orderkey", "left")


@query("geo29_convex_hull", f"{BOX} SELECT id, (x1 - x0) * (y1 - y0) AS area, CAST(5 AS BIGINT) AS n FROM b")
def convex_hull(spark, sf):
    pts = rings(spark, sf).select("id", F.explode(F.concat("ring", F.array(g.point((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)))).alias("p"))
    hull = streets.hulls(pts, "id")
    return hull.select("id", F.abs(g.signed_area(F.col("hull"))).alias("area"), F.size("hull").cast("long").alias("n"))


@query("geo30_straightened", f"{BOX} SELECT id, CASE WHEN least(x1 - x0, y1 - y0) / sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) * greatest(x1 - x0, y1 - y0) <= 2 THEN 2 ELSE 3 END AS n FROM b")
def straightened(spark, sf):
    return lines(spark, sf).select("id", F.size(streets.straight(F.col("line"), 2.0)).alias("n"))


@query("geo34_turn_curve", f"{BOX} SELECT id, k, round((1 - k / 12.0) * (1 - k / 12.0) * x0 + 2 * (1 - k / 12.0) * (k / 12.0) * x1 + (k / 12.0) * (k / 12.0) * x1, 6) AS x, round((1 - k / 12.0) * (1 - k / 12.0) * y0 + 2 * (1 - k / 12.0) * (k / 12.0) * y0 + (k / 12.0) * (k / 12.0) * y1, 6) AS y FROM b, (SELECT unnest(range(0, 13)) AS k)")
def turn_curve(spark, sf):
    c = lines(spark, sf).select("id", F.posexplode(streets.quadratic(F.col("line")[0], F.col("line")[1], F.col("line")[2], 13)).alias("k", "p"))
    return c.select("id", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("geo47_dashes", f"{BOX}, l AS (SELECT *, x1 - x0 + y1 - y0 AS len FROM b) SELECT id, CAST(k AS BIGINT) AS k, k * 4.0 AS s0, least(k * 4.0 + 2, len) AS s1 FROM (SELECT *, unnest(range(0, CAST(ceil(len / 4) AS BIGINT))) AS k FROM l)")
def dashes(spark, sf):
    l = lines(spark, sf).select("id", g.length(F.col("line")).alias("len"))
    at = l.select("id", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("len") / 4) - 1)).alias("k"))
    return at.select("id", "k", (F.col("k") * 4.0).alias("s0"), F.least(F.col("k") * 4.0 + 2, F.col("len")).alias("s1"))


@query("win06_median_of_three", "SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS m3 FROM events")
def median_of_three(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(series.moving_median("value", ["user_id"], ["ts", "event_id"], 1), 6).alias("m3"))


@query("mat05_storefronts", f"WITH p AS (SELECT p_partkey AS id, {PART_POINT} FROM part), s AS (SELECT s_suppkey AS sid, {SUPPLIER_POINT} FROM supplier) SELECT sid, arg_min(id, (sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)), id)) AS building FROM s JOIN p ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 100 GROUP BY 1")
def storefronts(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey AS id", *columns(PART_POINT))
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", *columns(SUPPLIER_POINT))
    return spatial.nearest_within(s, p, 10.0).select(F.col("id").alias("sid"), F.col("near_id").alias("building"))


@query("api01_meta", "SELECT 'c_acctbal' AS field, 'number' AS kind, NULL AS value, CAST(NULL AS BIGINT) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer UNION ALL SELECT 'c_mktsegment', 'choice', c_mktsegment, CAST(count(*) AS BIGINT), NULL, NULL FROM customer GROUP BY c_mktsegment")
def meta(spark, sf):
    return facets.profile(table(spark, sf, "customer"), ["c_acctbal", "c_mktsegment"])


@query("api08_run_sql", "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1")
def run_sql(spark, sf):
    return filters.run_sql(spark, "WITH a AS (SELECT n_regionkey FROM nation) SELECT n_regionkey, count(*) AS n FROM a GROUP BY 1", {"nation": table(spark, sf, "nation")})


@query("chk_roadway_step", "SELECT l_orderkey, l_linenumber FROM (SELECT *, lead(l_quantity) OVER w AS nxt, lead(l_linenumber) OVER w AS k FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) WHERE k = l_linenumber + 1 AND abs(nxt - l_quantity) > 45")
def roadway_step(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    return l.withColumns({"nxt": F.lead("q").over(w), "k": F.lead("l_linenumber").over(w)}).filter((F.col("k") == F.col("l_linenumber") + 1) & (F.abs(F.col("nxt") - F.col("q")) > 45)).select("l_orderkey", "l_linenumber")
