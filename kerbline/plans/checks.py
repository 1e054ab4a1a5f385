"""Constraint checks (P, S, I, U, R, B classes) over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline.operators import conformance
from kerbline.operators import constraints as k
from kerbline.operators import spatial
from kerbline.plans.joins import PART_BOX, points
from kerbline.plans.registry import query, table

BOX = f"b AS (SELECT p_partkey AS id, {PART_BOX} FROM part)"


@query("chk_overlap", f"WITH {BOX} SELECT a.id AS one, b.id AS two FROM b a JOIN b ON a.id < b.id AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0 AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.5")
def overlap(spark, sf):
    b = points(spark, sf, "part", "p_partkey", PART_BOX)
    return spatial.overlap_area(spatial.box_join(b, b, 16.0).filter("a.id < b.id")).filter("shared > 0.5").select(F.col("a.id").alias("one"), F.col("b.id").alias("two"))


@query("chk_parent_exists", "SELECT CAST(l_orderkey AS BIGINT) AS item FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def parent_exists(spark, sf):
    l = table(spark, sf, "lineitem")
    return k.missing(l, "l_orderkey", "l_orderkey", table(spark, sf, "orders").filter("o_orderstatus <> 'P'"), "o_orderkey").select(F.col("item").cast("long"))


@query("chk_unique", "SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS item FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def unique(spark, sf):
    return k.repeated(table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "id")


@query("chk_adds_up", "SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE abs(t - o_totalprice) > greatest(0.03 * o_totalprice, 1.5)")
def adds_up(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("t"))
    return table(spark, sf, "orders").join(t, "o_orderkey").filter(F.abs(F.col("t") - F.col("o_totalprice")) > F.greatest(0.03 * F.col("o_totalprice"), F.lit(1.5))).select("o_orderkey")


@query("chk_counts", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) < 3 AND count(*) >= 5")
def counts(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("s"), F.count("*").alias("n"))
    return g.filter("s < 3 AND n >= 5").select("o_custkey")


@query("chk_steps", "SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE abs(value - before) > 60")
def steps(spark, sf):
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").withColumn("before", before).filter(F.abs(F.col("value") - F.col("before")) > 60).select("event_id")


@query("chk_suite", """WITH v AS (SELECT 'P6' AS id, CAST(p_partkey AS VARCHAR) AS item FROM part WHERE p_size > 49 UNION ALL SELECT 'I4', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'P7', CAST(c_custkey AS VARCHAR) FROM customer GROUP BY c_custkey HAVING count(*) > 1),
c AS (SELECT * FROM (VALUES ('P6', 'size in range', true), ('I4', 'balance not negative', false), ('P7', 'unique id', true)) t(id, text, hard)), n AS (SELECT id, count(*) AS n FROM v GROUP BY 1), e AS (SELECT id, string_agg(item, ',' ORDER BY item) AS examples FROM (SELECT id, item FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY item) <= 50) GROUP BY 1)
SELECT c.id, text, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'PASS' WHEN hard THEN 'FAIL' ELSE 'INFO' END AS status, coalesce(examples, '') AS examples FROM c LEFT JOIN n USING (id) LEFT JOIN e USING (id)""")
def suite(spark, sf):
    p, s, c = (table(spark, sf, t) for t in ("part", "supplier", "customer"))
    return k.suite([k.Check("P6", "size in range", k.where(p, "p_partkey", F.col("p_size") > 49)), k.Check("I4", "balance not negative", k.where(s, "s_suppkey", F.col("s_acctbal") < 0), hard=False), k.Check("P7", "unique id", k.repeated(c, "c_custkey"))])


MODEL = {
    "P3": "SELECT p_partkey FROM part WHERE p_size < 1",
    "P4": "SELECT p_partkey FROM part WHERE p_size % 10 = 3",
    "P7": "SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1",
    "S1": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "S2": "SELECT c_custkey FROM customer WHERE c_nationkey % 4 > 2",
    "U8": "SELECT p_partkey FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS t FROM lineitem GROUP BY 1) ON p_partkey = l_partkey WHERE abs(coalesce(t, 0) - p_size) > greatest(0.03 * p_size, 1.5)",
    "U11": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N')",
    "U12": "SELECT c_custkey FROM customer WHERE c_nationkey % 6 >= 4 AND c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'A')",
    "U13": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'",
    "A1": "SELECT s FROM (SELECT o_custkey % 7 AS s, median(o_totalprice / 200000) AS m FROM orders GROUP BY 1) WHERE abs(m) > 0.5",
    "A2": "SELECT l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05",
    "R3": "SELECT o_orderkey FROM orders WHERE o_totalprice / 50000 < 2.75",
    "B7": "SELECT p_partkey FROM part WHERE p_partkey % 50 NOT IN (SELECT n_nationkey FROM nation)",
    "B8": "SELECT o_orderkey FROM orders WHERE o_totalprice / 50000 < 3",
}
HARD = ("P3", "P4", "P7", "S1", "S2", "U8", "A1", "A2", "B7")


@query("chk_street_model", " UNION ALL ".join(f"SELECT '{i}' AS id, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) = 0 THEN 'PASS' ELSE '{'FAIL' if i in HARD else 'INFO'}' END AS status FROM ({sql})" for i, sql in MODEL.items()))
def street_model(spark, sf):
    p, c, o, l, n = (table(spark, sf, t) for t in ("part", "customer", "orders", "lineitem", "nation"))
    col, none = F.col, F.lit(None).cast("long")
    model = {
        "spaces": p.select(col("p_partkey").alias("id"), none.alias("subsection"), none.alias("junction"), (col("p_partkey") % 50).alias("block"), F.when(col("p_size") % 10 == 3, 2).otherwise(1).alias("pieces"), F.lit(True).alias("valid"), col("p_size").cast("double").alias("area")),
        "blocks": n.select(col("n_nationkey").alias("id")),
        "sections": c.select(col("c_custkey").alias("id"), col("c_name").alias("road"), F.when(col("c_mktsegment") != "BUILDING", col("c_mktsegment")).alias("street"), (col("c_nationkey") % 4).alias("intersections")),
        "parts": l.select((col("l_orderkey") * 10 + col("l_linenumber")).alias("id"), col("l_partkey").alias("space"), F.when(col("l_returnflag") == "R", "parking").otherwise("lane").alias("kind"), col("l_quantity").alias("area"), F.when(col("l_discount") <= 0.05, "tag").alias("source")),
        "approaches": c.select(col("c_custkey").alias("id"), (col("c_nationkey") % 6).alias("arms")),
        "lanes": o.select(col("o_orderkey").alias("id"), col("o_custkey").alias("approach"), (col("o_custkey") % 7).alias("section"), (col("o_totalprice") / 50000).alias("width"), (col("o_totalprice") / 200000).alias("offset"), F.when(col("o_orderstatus") != "P", "straight").alias("arrow"), F.lit(3.0).alias("told_width")),
        "moves": l.filter("l_returnflag <> 'N'").select(col("l_orderkey").alias("lane"), F.when(col("l_returnflag") == "A", "straight").otherwise("left").alias("way")),
    }
    return k.suite(conformance.rules(model)).select("id", "n", "status")
