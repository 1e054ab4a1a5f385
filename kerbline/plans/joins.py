"""Joins (JON)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from kerbline.operators import matching, spatial, temporal
from kerbline.plans.registry import query, table

#: Points and boxes of the parts and suppliers, from their keys.
PART_POINT = "CAST((p_partkey * 7919) % 1000 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 1000 AS DOUBLE) AS y"
SUPPLIER_POINT = "CAST((s_suppkey * 6151) % 1000 AS DOUBLE) AS x, CAST((s_suppkey * 3571) % 1000 AS DOUBLE) AS y"
PART_BOX = "CAST((p_partkey * 7919) % 1000 AS DOUBLE) AS x0, CAST((p_partkey * 104729) % 1000 AS DOUBLE) AS y0, CAST((p_partkey * 7919) % 1000 + 1 + p_partkey % 9 AS DOUBLE) AS x1, CAST((p_partkey * 104729) % 1000 + 1 + p_partkey % 7 AS DOUBLE) AS y1"


def points(spark, sf, name, key, point):
    return table(spark, sf, name).selectExpr(f"{key} AS id", *columns(point))


def columns(text):
    """The single expressions of a select list of casts."""
    return re.split(r", (?=CAST)", text)


@query("jon01_using", "SELECT o_orderkey, l_linenumber, l_quantity FROM (SELECT *, l_orderkey AS o_orderkey FROM lineitem) JOIN orders USING (o_orderkey) WHERE o_orderstatus = 'F'")
def using(spark, sf):
    l = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return table(spark, sf, "orders").filter("o_orderstatus = 'F'").join(l, ["o_orderkey"]).select("o_orderkey", "l_linenumber", "l_quantity")


@query("jon02_left_chain", "SELECT c_custkey, n_name, r_name, n_orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_chain(spark, sf):
    c, n, r, o = (table(spark, sf, t) for t in ("customer", "nation", "region", "orders"))
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").join(per, c.c_custkey == per.o_custkey, "left").select("c_custkey", "n_name", "r_name", "n_orders")


@query("jon03_self_pairs", "SELECT a.l_orderkey, a.l_linenumber AS one, b.l_linenumber AS two FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_suppkey <> b.l_suppkey WHERE a.l_returnflag = b.l_returnflag")
def self_pairs(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    a, b = l.alias("a"), l.alias("b")
    on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")) & (F.col("a.l_suppkey") != F.col("b.l_suppkey")) & (F.col("a.l_returnflag") == F.col("b.l_returnflag"))
    return a.join(b, on).select("a.l_orderkey", F.col("a.l_linenumber").alias("one"), F.col("b.l_linenumber").alias("two"))


@query("jon04_range", "SELECT e.event_id, p.p_partkey FROM events e JOIN part p ON p.p_retailprice >= e.value * 10 AND p.p_retailprice < e.value * 10 + 5 WHERE e.event_type = 'purchase'")
def range_join(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'purchase'").select("event_id", (F.col("value") * 10).alias("low"), (F.col("value") * 10 + 5).alias("high"))
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return temporal.range_join(p, e, "p_retailprice", "low", "high", 50.0).select("event_id", "p_partkey")


@query("jon05_levels", "SELECT r_name, v.side FROM region, (VALUES ('left'), ('right')) v(side)")
def levels(spark, sf):
    return table(spark, sf, "region").select("r_name", F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"))


@query("jon06_spatial_intersects", f"WITH b AS (SELECT p_partkey AS id, {PART_BOX} FROM part) SELECT a.id AS one, b.id AS two FROM b a JOIN b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def spatial_intersects(spark, sf):
    b = points(spark, sf, "part", "p_partkey", PART_BOX)
    return spatial.box_join(b, b, cell=16.0).filter("a.id < b.id").select(F.col("a.id").alias("one"), F.col("b.id").alias("two"))


@query("jon07_within_distance", f"WITH p AS (SELECT p_partkey AS id, {PART_POINT} FROM part), s AS (SELECT s_suppkey AS sid, {SUPPLIER_POINT} FROM supplier) SELECT p.id, sid, round(sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)), 6) AS d FROM p JOIN s ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 900")
def within_distance(spark, sf):
    p, s = points(spark, sf, "part", "p_partkey", PART_POINT), points(spark, sf, "supplier", "s_suppkey", SUPPLIER_POINT)
    return spatial.distance_join(p, s, 30.0).select(F.col("a.id").alias("id"), F.col("b.id").alias("sid"), F.round("d", 6).alias("d"))


NEAREST = f"WITH p AS (SELECT p_partkey AS id, {PART_POINT} FROM part), s AS (SELECT s_suppkey AS sid, {SUPPLIER_POINT} FROM supplier), d AS (SELECT p.id, sid, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS d FROM p, s)"


@query("jon08_nearest", f"{NEAREST} SELECT id, sid, round(d, 6) AS d FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, sid) = 1")
def nearest(spark, sf):
    p, s = points(spark, sf, "part", "p_partkey", PART_POINT), points(spark, sf, "supplier", "s_suppkey", SUPPLIER_POINT)
    return spatial.nearest(p, s, cell=32.0).select("id", F.col("near_id").alias("sid"), F.round("d", 6).alias("d"))


@query("geo27_nearest_split", f"WITH b AS (SELECT p_partkey AS box, {PART_BOX} FROM part), s AS (SELECT s_suppkey AS sid, {SUPPLIER_POINT} FROM supplier), c AS (SELECT box, i, unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT))) AS j FROM (SELECT *, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT))) AS i FROM b)), o AS (SELECT i, j, arg_min(sid, (sqrt((x - i - 0.5) * (x - i - 0.5) + (y - j - 0.5) * (y - j - 0.5)), sid)) AS site FROM (SELECT DISTINCT i, j FROM c), s GROUP BY 1, 2) SELECT box, site, CAST(count(*) AS BIGINT) AS cells FROM c JOIN o USING (i, j) GROUP BY 1, 2")
def nearest_split(spark, sf):
    boxes, sites = points(spark, sf, "part", "p_partkey", PART_BOX), points(spark, sf, "supplier", "s_suppkey", SUPPLIER_POINT)
    return spatial.split_by_nearest(boxes, sites, 1.0, 32.0)


@query("jon09_arg_min_within", f"{NEAREST} SELECT id, arg_min(sid, (d, sid)) AS sid, round(min(d), 6) AS d FROM d WHERE d <= 60 GROUP BY id")
def arg_min_within(spark, sf):
    p, s = points(spark, sf, "part", "p_partkey", PART_POINT), points(spark, sf, "supplier", "s_suppkey", SUPPLIER_POINT)
    return spatial.nearest_within(p, s, 60.0).select("id", F.col("near_id").alias("sid"), F.round("d", 6).alias("d"))


@query("jon10_ranked_match", f"WITH p AS (SELECT p_partkey AS id, p_size % 25 AS name, {PART_POINT} FROM part), s AS (SELECT s_suppkey AS sid, s_nationkey AS name, {SUPPLIER_POINT} FROM supplier), d AS (SELECT p.id, sid, p.name = s.name AS same, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS d FROM p, s) SELECT id, sid, same FROM d WHERE d <= CASE WHEN same THEN 200 ELSE 50 END QUALIFY row_number() OVER (PARTITION BY id ORDER BY same DESC, d, sid) = 1")
def ranked_match(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_size % 25 AS name", *columns(PART_POINT))
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS name", *columns(SUPPLIER_POINT))
    return matching.name_then_distance(p, s, named_radius=200.0, radius=50.0).select("id", F.col("match_id").alias("sid"), "same")


@query("jon11_points_in_boxes", f"WITH b AS (SELECT p_partkey AS id, {PART_BOX} FROM part), s AS (SELECT s_suppkey AS sid, {SUPPLIER_POINT} FROM supplier) SELECT sid, id FROM s JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def points_in_boxes(spark, sf):
    s = points(spark, sf, "supplier", "s_suppkey", SUPPLIER_POINT).select("id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return spatial.box_join(s, points(spark, sf, "part", "p_partkey", PART_BOX), cell=16.0).select(F.col("a.id").alias("sid"), F.col("b.id").alias("id"))


@query("jon12_along_axis", "WITH c AS (SELECT user_id, event_id, value, CAST(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS s0 FROM events), q AS (SELECT DISTINCT user_id, unnest([100.0, 500.0, 1000.0]) AS s FROM events) SELECT q.user_id, CAST(q.s AS DOUBLE) AS s, c.event_id FROM q JOIN c ON q.user_id = c.user_id AND q.s >= c.s0 AND q.s < c.s0 + c.value")
def along_axis(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    before = F.coalesce(F.sum("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sections = e.select("user_id", "event_id", before.alias("s0"), (before + F.col("value")).alias("s1"))
    at = e.select("user_id").distinct().select("user_id", F.explode(F.array(F.lit(100.0), F.lit(500.0), F.lit(1000.0))).alias("s"))
    return temporal.range_join(at, sections, "s", "s0", "s1", 500.0, on=["user_id"]).select("user_id", "s", "event_id")


@query("jon13_asof", "SELECT p.event_id, v.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts")
def asof(spark, sf):
    e = table(spark, sf, "events")
    left, right = e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'")
    return temporal.asof(left, right, "user_id", "ts", {"event_id": "last_view"}).select("event_id", "last_view")


@query("jon13_disjoint_periods", """WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, min(ts) AS t0, max(ts) AS t1 FROM events GROUP BY 1, 2, 3)
  SELECT a.user_id, strftime(a.day, '%Y-%m-%d') AS day, a.event_type AS one, b.event_type AS two FROM p a JOIN p b
    ON a.user_id = b.user_id AND a.day = b.day AND a.event_type < b.event_type AND (a.t1 < b.t0 OR b.t1 < a.t0)""")
def disjoint_periods(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    p = e.groupBy("user_id", "day", "event_type").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    a, b = p.alias("a"), p.alias("b")
    same = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.day") == F.col("b.day")) & (F.col("a.event_type") < F.col("b.event_type"))
    apart = same & temporal.disjoint("a.t0", "a.t1", "b.t0", "b.t1")
    return a.join(b, apart).select("a.user_id", "a.day", F.col("a.event_type").alias("one"), F.col("b.event_type").alias("two"))


@query("jon14_ray_hits", f"WITH s AS (SELECT s_suppkey AS id, {SUPPLIER_POINT} FROM supplier), b AS (SELECT p_partkey AS pid, {PART_BOX} FROM part) SELECT id, min(x0 - x) AS d FROM s JOIN b ON y BETWEEN y0 AND y1 AND x0 >= x AND x0 - x <= 100 GROUP BY id")
def ray_hits(spark, sf):
    s = points(spark, sf, "supplier", "s_suppkey", SUPPLIER_POINT)
    return spatial.ray_hits(s, points(spark, sf, "part", "p_partkey", PART_BOX), reach=100.0).select("id", "d")


@query("jon15_semi_keys", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 15)")
def semi_keys(spark, sf):
    keys = table(spark, sf, "part").filter("p_size = 15").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").join(keys, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("jon16_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti(spark, sf):
    large = table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(large, "c_custkey", "left_anti")


@query("jon17_update_from", "SELECT p_partkey, coalesce(u.price, p_retailprice) AS p_retailprice FROM part LEFT JOIN (SELECT l_partkey, round(max(l_extendedprice / l_quantity), 6) AS price FROM lineitem WHERE l_discount > 0.08 GROUP BY 1) u ON l_partkey = p_partkey")
def update_from(spark, sf):
    new = table(spark, sf, "lineitem").filter("l_discount > 0.08").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.max(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("p_retailprice"))
    return matching.update(table(spark, sf, "part").select("p_partkey", "p_retailprice"), new, ["p_partkey"])


@query("jon18_correlated_scalar", "SELECT n_nationkey, (SELECT CAST(count(*) AS BIGINT) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey) AS most FROM nation")
def correlated_scalar(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_acctbal").alias("most"))
    return table(spark, sf, "nation").select("n_nationkey").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_nationkey", F.coalesce("customers", F.lit(0)).alias("customers"), "most")


@query("jon20_sized_broadcast", "SELECT r_name, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def sized_broadcast(spark, sf):
    l, s, n, r = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation", "region"))
    # Counted before the dimensions are joined: one row per supplier goes on.
    per = l.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return per.join(s, per.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.sum("n").alias("n"))
