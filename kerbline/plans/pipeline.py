"""Relations of the street pipeline (PIP, STP) over shapes and series derived from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline.operators import filters, overlay, partition, spatial
from kerbline.plans.joins import PART_BOX, points
from kerbline.plans.registry import query, table

CELL = 16.0  # of the stretches that borders are looked at in
BOX = f"b AS (SELECT p_partkey AS id, p_size % 4 AS rank, p_brand, {PART_BOX} FROM part)"
CELLS = "c AS (SELECT id, rank, p_brand, cx, unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT))) AS cy FROM (SELECT *, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT))) AS cx FROM b))"
OWNED = f"{BOX}, {CELLS}, o AS (SELECT cx, cy, arg_min(id, (rank, id)) AS id FROM c GROUP BY 1, 2)"


def boxes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("s"), "p_brand")
    return points(spark, sf, "part", "p_partkey", PART_BOX).join(p.select(F.col("p_partkey").alias("id"), (F.col("s") % 4).alias("rank"), "p_brand"), "id")


def owned(spark, sf):
    return overlay.owned(boxes(spark, sf))


@query("agg10_union_area", f"WITH {BOX}, {CELLS} SELECT p_brand, CAST(count(*) AS BIGINT) AS area FROM (SELECT DISTINCT p_brand, cx, cy FROM c) GROUP BY 1")
def union_area(spark, sf):
    return overlay.union_area(boxes(spark, sf), ["p_brand"]).withColumn("area", F.col("area").cast("long"))


#: The union of boxes with any coordinates: slabs between neighbouring x, and the merged y of what crosses them.
UNION = """edge AS (SELECT DISTINCT g, x FROM (SELECT g, x0 AS x FROM b UNION ALL SELECT g, x1 FROM b)),
  slab AS (SELECT g, x AS a, lead(x) OVER (PARTITION BY g ORDER BY x) AS z FROM edge),
  over_ AS (SELECT s.g, a, z, y0, y1, max(y1) OVER (PARTITION BY s.g, a ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
    FROM slab s JOIN b ON b.g = s.g AND b.x0 <= a AND b.x1 >= z)"""
PRICED = """b AS (SELECT o_orderpriority AS g, o_orderkey % 701 / 7.0 AS x0, o_custkey % 997 / 11.0 AS y0,
  o_orderkey % 701 / 7.0 + o_totalprice / 3e5 AS x1, o_custkey % 997 / 11.0 + 0.3 + o_custkey % 13 / 10.0 AS y1 FROM orders)"""


@query("agg10_union_real", f"WITH {PRICED}, {UNION} SELECT g, round(sum((z - a) * greatest(0, y1 - greatest(y0, coalesce(seen, y0)))), 3) AS area FROM over_ GROUP BY 1")
def union_of_real_boxes(spark, sf):
    o, x, y = table(spark, sf, "orders"), F.col("o_orderkey") % 701 / 7.0, F.col("o_custkey") % 997 / 11.0
    far = [(x + F.col("o_totalprice") / 3e5).alias("x1"), (y + 0.3 + F.col("o_custkey") % 13 / 10.0).alias("y1")]
    b = o.select(F.col("o_orderpriority").alias("g"), x.alias("x0"), y.alias("y0"), *far)
    return overlay.union_area(b, ["g"]).withColumn("area", F.round("area", 3))


@query("pip09_levels", "SELECT p_partkey, unnest(range(p_size % 4 - 2, p_size % 6 - 1)) AS level FROM part")
def building_levels(spark, sf):
    lo, hi = (F.col("p_size") % 4 - 2).cast("long"), (F.col("p_size") % 6 - 2).cast("long")
    steps = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    return table(spark, sf, "part").select("p_partkey", F.explode(steps).alias("level"))


@query("pip10_reach", "SELECT p_partkey, round(least(1.5 * p_size / 2 + CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 4 END, 25), 6) AS reach FROM part")
def reach(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(partition.reach(F.col("p_size") / 2, F.col("p_partkey") % 2 == 0), 6).alias("reach"))


@query("pip13_half_width", "WITH s AS (SELECT event_id, user_id, event_type AS side, ts, CASE WHEN event_id % 3 > 0 THEN value END AS hit, 25.0::DOUBLE AS cap, 5.0::DOUBLE AS least FROM events), m AS (SELECT *, median(coalesce(hit, cap)) OVER (PARTITION BY user_id, side ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS med, avg(CAST(hit IS NOT NULL AS INT)) OVER (PARTITION BY user_id, side) AS share FROM s) SELECT event_id, round(greatest(CASE WHEN share >= 0.5 THEN med ELSE cap END, least), 6) AS half FROM m")
def half_width(spark, sf):
    e = table(spark, sf, "events").withColumns({"hit": F.when(F.col("event_id") % 3 > 0, F.col("value")), "cap": F.lit(25.0), "least": F.lit(5.0)})
    return e.select("event_id", F.round(partition.half_width("hit", "cap", "least", ["user_id", "event_type"], "event_id"), 6).alias("half"))


@query("pip15_arm_cut", "SELECT p_partkey, CAST(greatest(1, least(round(least(greatest(w / 2 + 1, p_size / 2.0 + 3), len / 2, 25) * 20 / len), 10)) AS BIGINT) AS k FROM (SELECT *, (p_partkey % 30)::DOUBLE AS w, (10 + p_partkey % 90)::DOUBLE AS len FROM part)")
def arm_cut(spark, sf):
    w, length = (F.col("p_partkey") % 30).cast("double"), (10 + F.col("p_partkey") % 90).cast("double")
    return table(spark, sf, "part").select("p_partkey", partition.arm_cut(w, F.col("p_size").cast("double"), length, F.lit(20)).alias("k"))


@query("pip18_shapes", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'roundabout' WHEN p_size % 7 = 0 THEN 'dogleg' WHEN a + b > 270 OR greatest(a, b, 360 - a - b) >= 160 THEN 'T' ELSE 'Y' END AS shape FROM (SELECT *, 60 + p_partkey % 90 AS a, 70 + p_partkey % 50 AS b FROM part)")
def shapes(spark, sf):
    a, b = 60 + F.col("p_partkey") % 90, 70 + F.col("p_partkey") % 50
    gaps = F.array(a, b, 360 - a - b)
    return table(spark, sf, "part").select("p_partkey", partition.junction_shape(gaps, F.when(F.col("p_size") % 7 == 0, 2).otherwise(1), F.col("p_size") % 10 == 0).alias("shape"))


@query("pip21_reassign", f"WITH {BOX}, p AS (SELECT a.id, x.id AS region, (least(a.x1, x.x1) - greatest(a.x0, x.x0)) * (least(a.y1, x.y1) - greatest(a.y0, x.y0)) AS shared FROM b a JOIN b x ON a.id <> x.id AND a.x0 <= x.x1 AND x.x0 <= a.x1 AND a.y0 <= x.y1 AND x.y0 <= a.y1) SELECT id, arg_max(region, (shared, -region)) AS region FROM p GROUP BY 1")
def reassign(spark, sf):
    b = points(spark, sf, "part", "p_partkey", PART_BOX)
    return spatial.largest_overlap(b, 16.0).select("id", F.col("other").alias("region"))


@query("pip24_overlap_priority", f"WITH {OWNED} SELECT b.id, CAST(coalesce(n, 0) AS BIGINT) AS area FROM b LEFT JOIN (SELECT id, count(*) AS n FROM o GROUP BY 1) USING (id)")
def overlap_priority(spark, sf):
    return overlay.claimed(boxes(spark, sf)).withColumn("area", F.col("area").cast("long"))


@query("pip27_rollup", "SELECT n_regionkey AS street, CAST(count(DISTINCT c_custkey) AS BIGINT) AS n, arg_max(c_mktsegment, (k, -ascii(c_mktsegment))) AS common FROM (SELECT *, count(*) OVER (PARTITION BY n_regionkey, c_mktsegment) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1")
def street_rollup(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = c.groupBy("n_regionkey", "c_mktsegment").agg(F.count("*").alias("k"))
    return k.groupBy(F.col("n_regionkey").alias("street")).agg(F.sum("k").alias("n"), F.max_by("c_mktsegment", F.struct("k", -F.ascii("c_mktsegment"))).alias("common"))


@query("pip30_objects", "SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'pole' WHEN p_type LIKE '%BRASS%' AND p_size < 20 THEN 'sign' WHEN p_size % 7 = 0 THEN 'lamp' ELSE 'unknown' END AS class, greatest(least(p_size - 25, 5), -5) AS level FROM part")
def objects(spark, sf):
    rules = [("pole", F.col("p_type").contains("STEEL")), ("sign", F.col("p_type").contains("BRASS") & (F.col("p_size") < 20)), ("lamp", F.col("p_size") % 7 == 0)]
    return table(spark, sf, "part").select("p_partkey", filters.first_rule(rules, "unknown").alias("class"), F.greatest(F.least(F.col("p_size") - 25, F.lit(5)), F.lit(-5)).alias("level"))


@query("stp03_building_use", "WITH v AS (SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN 'residential' WHEN l_returnflag = 'A' THEN 'commercial' END AS use FROM lineitem) SELECT l_partkey, CASE WHEN count(DISTINCT use) > 1 THEN 'mixed' ELSE coalesce(max(use), 'unknown') END AS use FROM v GROUP BY 1")
def building_use(spark, sf):
    use = F.when(F.col("l_returnflag") == "R", "residential").when(F.col("l_returnflag") == "A", "commercial")
    g = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set(use)).alias("u"))
    return g.select("l_partkey", F.when(F.size("u") > 1, "mixed").otherwise(F.coalesce(F.get("u", F.lit(0)), F.lit("unknown"))).alias("use"))


@query("stp14_ground_borders", f"WITH {OWNED}, e AS (SELECT least(a.id, b.id) AS one, greatest(a.id, b.id) AS two FROM o a JOIN o b ON (a.cx + 1 = b.cx AND a.cy = b.cy OR a.cx = b.cx AND a.cy + 1 = b.cy) AND a.id <> b.id) SELECT one, two, CAST(count(*) AS BIGINT) AS edge FROM e GROUP BY 1, 2")
def ground_borders(spark, sf):
    return overlay.neighbours(owned(spark, sf), CELL).withColumn("edge", F.col("edge").cast("long"))


@query("stp14_slivers", f"WITH {OWNED}, s AS (SELECT id FROM o GROUP BY 1 HAVING count(*) < 6), e AS (SELECT a.id AS id, b.id AS other, count(*) AS edge FROM o a JOIN o b ON abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1 AND a.cx BETWEEN b.cx - 1 AND b.cx + 1 AND a.id <> b.id WHERE a.id IN (SELECT id FROM s) GROUP BY 1, 2) SELECT id, arg_max(other, (edge, -other)) AS \"into\" FROM e GROUP BY 1")
def slivers(spark, sf):
    return overlay.slivers_joined(owned(spark, sf), 6.0, CELL)


@query("stp23_stop_times", "WITH h AS (SELECT user_id AS stop, hour(ts) AS h, count(*) AS n, count(DISTINCT event_type) AS routes FROM events WHERE isodow(ts) = 3 GROUP BY 1, 2) SELECT stop, CAST(sum(n) AS BIGINT) AS departures, CAST(max(n) AS BIGINT) AS peak, CAST(arg_max(h, (n, -h)) AS BIGINT) AS peak_hour FROM h GROUP BY 1")
def stop_times(spark, sf):
    from kerbline.operators import facets

    e = table(spark, sf, "events").filter(F.dayofweek("ts") == 4).withColumnRenamed("user_id", "stop")
    return facets.peak_hour(e, "stop", "ts").select("stop", "departures", "peak", "peak_hour")


@query("sem_way_width", "SELECT p_partkey, round(coalesce(CASE WHEN p_size % 3 = 0 THEN p_size % 5 * 3.25 END, CASE WHEN p_size % 3 = 1 THEN p_size % 4 * 3.25 * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END END, CASE p_brand WHEN 'Brand#1' THEN 14 WHEN 'Brand#2' THEN 8 END), 6) AS width FROM part")
def way_width(spark, sf):
    s = F.col("p_size")
    w = partition.way_width(F.col("p_brand"), F.when(s % 3 == 0, s % 5), F.when(s % 3 == 1, s % 4), F.col("p_partkey") % 2 == 0, {"Brand#1": 14.0, "Brand#2": 8.0})
    return table(spark, sf, "part").select("p_partkey", F.round(w, 6).alias("width"))


@query("sem_lane_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey) AS lane FROM lineitem")
def lane_order(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber", "l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("lane"))
