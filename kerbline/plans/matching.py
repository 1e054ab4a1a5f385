"""Entity matching and stable ids (MAT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import fusion, matching, spatial
from kerbline.plans.joins import PART_POINT, SUPPLIER_POINT, columns
from kerbline.plans.registry import query, table


@query("mat01_fusion")
def fuse(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey AS id", "concat('c', p_size % 5) AS class", "p_partkey % 3 AS source_rank", "p_retailprice AS seen", *columns(PART_POINT))
    return fusion.fuse(p, radius=10.0)


@query("mat02_registry", "WITH t AS (SELECT 'part' AS kind, p_brand || ':' || p_size AS profile, p_partkey AS id FROM part), k AS (SELECT kind, profile || CASE WHEN n = 1 THEN '' ELSE '#' || n END AS key FROM (SELECT *, row_number() OVER (PARTITION BY kind, profile ORDER BY id) AS n FROM t WHERE id % 10 <> 1)), o AS (SELECT kind, profile || CASE WHEN n = 1 THEN '' ELSE '#' || n END AS key FROM (SELECT *, row_number() OVER (PARTITION BY kind, profile ORDER BY id) AS n FROM t WHERE id % 10 < 5)) SELECT coalesce(o.kind, k.kind) AS kind, coalesce(o.key, k.key) AS key, md5(coalesce(o.kind, k.kind) || '|' || coalesce(o.key, k.key)) AS uid, CASE WHEN o.key IS NOT NULL THEN 'one' ELSE 'two' END AS first_seen, CASE WHEN k.key IS NOT NULL THEN 'two' ELSE 'one' END AS last_seen FROM o FULL JOIN k ON o.kind = k.kind AND o.key = k.key")
def registry(spark, sf):
    t = table(spark, sf, "part").select(F.lit("part").alias("kind"), F.concat_ws(":", "p_brand", "p_size").alias("profile"), F.col("p_partkey").alias("id"))
    none = spark.createDataFrame([], "kind string, key string, uid string, first_seen string, last_seen string")
    keyed = lambda df: matching.with_profiles(df, "kind", "profile", "id")
    one = matching.register(none, keyed(t.filter("id % 10 < 5")), F.lit("one"))
    return matching.register(one, keyed(t.filter("id % 10 <> 1")), F.lit("two"))


@query("mat04_ref_or_near", f"WITH p AS (SELECT p_partkey AS id, p_size AS ref, {PART_POINT} FROM part), s AS (SELECT s_suppkey AS sid, s_suppkey % 60 AS code, {SUPPLIER_POINT} FROM supplier), r AS (SELECT id, min(sid) AS sid FROM p JOIN s ON ref = code GROUP BY 1), n AS (SELECT id, sid, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS d FROM p, s), m AS (SELECT id, arg_min(sid, (d, sid)) AS sid FROM n WHERE d <= 30 AND id NOT IN (SELECT id FROM r) GROUP BY 1) SELECT id, sid, 'ref' AS how FROM r UNION ALL SELECT id, sid, 'near' FROM m")
def ref_or_near(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_size AS ref", *columns(PART_POINT))
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_suppkey % 60 AS code", *columns(SUPPLIER_POINT))
    # One supplier for each code, before parts meet them.
    by_ref = p.join(s.groupBy(F.col("code").alias("ref")).agg(F.min("id").alias("sid")), "ref").groupBy("id").agg(F.min("sid").alias("sid"))
    near = spatial.nearest_within(p.join(by_ref, "id", "left_anti"), s, 30.0).select("id", F.col("near_id").alias("sid"))
    return by_ref.withColumn("how", F.lit("ref")).unionByName(near.withColumn("how", F.lit("near")))


@query("mat06_inherited", "SELECT c_custkey, c_nationkey, n_name AS inherited FROM customer LEFT JOIN nation ON 'w' || n_nationkey = 'w' || c_nationkey WHERE c_acctbal > 0")
def inherited(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 0").withColumn("ref", F.concat(F.lit("w"), F.col("c_nationkey").cast("string")))
    n = table(spark, sf, "nation").select(F.concat(F.lit("w"), F.col("n_nationkey").cast("string")).alias("ref"), F.col("n_name").alias("inherited"))
    return c.join(n, "ref", "left").select("c_custkey", "c_nationkey", "inherited")
