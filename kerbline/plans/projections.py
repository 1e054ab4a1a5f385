"""Projections, filters, predicates, casts (PRJ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import tags
from kerbline.operators import filters
from kerbline.plans.registry import query, table


@query("prj01_exclude", "SELECT * EXCLUDE (p_name, p_type) FROM part")
def exclude(spark, sf):
    return table(spark, sf, "part").drop("p_name", "p_type")


@query("prj02_first_rule", """SELECT p_partkey, CASE WHEN p_size > 40 AND p_retailprice > 1500 THEN 'large dear' WHEN p_size > 40 THEN 'large' WHEN p_type LIKE '%BRASS%' THEN 'brass'
  WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'own' ELSE 'other' END AS class FROM part""")
def first_rule(spark, sf):
    rules = [("large dear", (F.col("p_size") > 40) & (F.col("p_retailprice") > 1500)), ("large", F.col("p_size") > 40), ("brass", F.col("p_type").contains("BRASS")), ("own", F.col("p_brand").isin("Brand#1", "Brand#2"))]
    return table(spark, sf, "part").select("p_partkey", filters.first_rule(rules, "other").alias("class"))


@query("prj03_clamps", "SELECT o_orderkey, greatest(least(coalesce(nullif(o_orderpriority, '1-URGENT'), 'none'), '4'), '2') AS p, least(greatest(o_totalprice, 1000.0), 200000.0) AS clamped, coalesce(greatest(NULL, o_custkey), -1) AS kept FROM orders")
def clamps(spark, sf):
    p = F.greatest(F.least(F.coalesce(F.nullif("o_orderpriority", F.lit("1-URGENT")), F.lit("none")), F.lit("4")), F.lit("2"))
    return table(spark, sf, "orders").select("o_orderkey", p.alias("p"), filters.clamp(F.col("o_totalprice"), 1000.0, 200000.0).alias("clamped"), F.coalesce(F.greatest(F.lit(None).cast("long"), "o_custkey"), F.lit(-1)).alias("kept"))


@query("prj04_try_cast", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(event_type AS BIGINT) AS nothing, CAST(round(try_cast(json_extract_string(props, '$.k') || '.5' AS DOUBLE)) AS BIGINT) AS rounded FROM events")
def try_cast(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", k.try_cast("double").alias("k"), F.col("event_type").try_cast("long").alias("nothing"), tags.integer(F.concat(k, F.lit(".5"))).alias("rounded"))


@query("prj05_null_logic", "SELECT event_id, coalesce(nullif(event_type, 'view'), 'no') <> 'no' AS other, coalesce(nullif(event_type, 'click') = 'view', false) AS is_view, value > 50 OR nullif(event_type, 'view') IS NULL AS either FROM events")
def null_logic(spark, sf):
    e, nul = table(spark, sf, "events"), lambda v: F.nullif("event_type", F.lit(v))
    return e.select("event_id", (F.coalesce(nul("view"), F.lit("no")) != "no").alias("other"), F.coalesce(nul("click") == "view", F.lit(False)).alias("is_view"), ((F.col("value") > 50) | nul("view").isNull()).alias("either"))


@query("prj06_in_subquery", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def in_subquery(spark, sf):
    c, o, n = (table(spark, sf, t) for t in ("customer", "orders", "nation"))
    big = o.filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    one = n.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(big, "c_custkey", "left_semi").join(one, "c_nationkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("prj07_exists", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_extendedprice > o.o_totalprice * 0.3) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def exists(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    has = o.join(l, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_extendedprice") > F.col("o_totalprice") * 0.3), "left_semi")
    return has.join(l.filter("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("prj08_like", "SELECT p_partkey FROM part WHERE p_type LIKE 'S%' AND p_type NOT LIKE '%TIN' AND p_name ILIKE '%A%'")
def like(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_type").like("S%") & ~F.col("p_type").like("%TIN") & F.col("p_name").ilike("%A%")).select("p_partkey")


@query("prj09_between", "SELECT l_returnflag, count(*) FILTER (l_quantity BETWEEN 10 AND 20) AS n, count(*) AS total FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31' GROUP BY 1")
def between(spark, sf):
    l = table(spark, sf, "lineitem").filter(F.col("l_shipdate").between(F.lit("1995-01-01").cast("timestamp"), F.lit("1997-12-31").cast("timestamp")))
    return l.groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity").between(10, 20)).alias("n"), F.count("*").alias("total"))


@query("prj10_boolean_int", "SELECT event_id, CAST(nullif(event_type, 'view') IS NOT NULL AS INT) AS known, CAST(value > 50 AS INT) AS high FROM events")
def boolean_int(spark, sf):
    return table(spark, sf, "events").select("event_id", F.nullif("event_type", F.lit("view")).isNotNull().cast("int").alias("known"), (F.col("value") > 50).cast("int").alias("high"))


@query("prj11_facet_filter", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size >= 10 AND p_size <= 30 AND p_brand IN ('Brand#1', 'Brand#3') AND p_name ILIKE '%a%' AND p_partkey <> 7")
def facet_filter(spark, sf):
    where = [("p_size", ">=", 10), ("p_size", "<=", 30), ("p_brand", "in", ["Brand#1", "Brand#3"]), ("p_name", "contains", "A"), ("p_partkey", "!=", 7)]
    return filters.where(table(spark, sf, "part"), where).select("p_partkey", "p_brand", "p_size")


@query("prj12_guarded_sql", "SELECT r_name, 'drop table x; --' AS said FROM region ORDER BY r_name")
def guarded_sql(spark, sf):
    return filters.run_sql(spark, "SELECT r_name, 'drop table x; --' AS said FROM region ORDER BY r_name;", {"region": table(spark, sf, "region")})


@query("prj13_layer_view", "SELECT p_partkey AS id, p_name AS name, p_brand AS class FROM part WHERE p_size < 5")
def layer_view(spark, sf):
    return filters.layer(table(spark, sf, "part"), {"id": "p_partkey", "name": "p_name", "class": "p_brand", "size": "p_size"}).filter("size < 5").drop("size")
