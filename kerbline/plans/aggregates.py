"""Aggregates (AGG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import facets, matching, spatial
from kerbline.plans.joins import PART_BOX, points
from kerbline.plans.registry import query, table


@query("agg01_basic", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_shipdate) AS first, max(l_discount) AS most FROM lineitem GROUP BY 1, 2")
def basic(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.min("l_shipdate").alias("first"), F.max("l_discount").alias("most"))


@query("agg02_boolean", "SELECT user_id, CAST(count_if(value > 50) AS BIGINT) AS high, bool_or(event_type = 'error') AS any_error, bool_and(value > 1) AS all_some FROM events GROUP BY 1")
def boolean(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("high"), F.bool_or(F.col("event_type") == "error").alias("any_error"), F.bool_and(F.col("value") > 1).alias("all_some"))


@query("agg03_filter", "SELECT o_orderstatus, CAST(count(*) FILTER (o_totalprice > 100000) AS BIGINT) AS big, round(avg(o_totalprice) FILTER (o_orderpriority LIKE '1%'), 4) AS urgent FROM orders GROUP BY 1")
def filtered(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 100000).alias("big"), F.round(F.avg(F.when(F.col("o_orderpriority").like("1%"), F.col("o_totalprice"))), 4).alias("urgent"))


@query("agg04_pivot_any", "SELECT l_orderkey, any_value(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS first, any_value(CASE WHEN l_linenumber = 2 THEN l_partkey END) AS second FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey) GROUP BY 1")
def pivot_any(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    at = lambda k: F.first(F.when(F.col("l_linenumber") == k, F.col("p")), ignorenulls=True)
    return l.groupBy("l_orderkey").agg(at(1).alias("first"), at(2).alias("second"))


@query("agg05_mode", "SELECT user_id, arg_max(event_type, (n, -ascii(event_type))) AS mode FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def mode(spark, sf):
    return facets.mode(table(spark, sf, "events"), ["user_id"], "event_type").withColumnRenamed("event_type", "mode")


@query("agg06_medians", "SELECT l_suppkey, round(median(l_extendedprice), 4) AS exact, (list_sort(list(l_extendedprice)))[len(list(l_extendedprice)) // 2 + 1] AS upper FROM lineitem GROUP BY 1")
def medians(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.median("l_extendedprice"), 4).alias("exact"), facets.upper_median("l_extendedprice").alias("upper"))


@query("agg07_arg_max", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY 1")
def arg_max(spark, sf):
    key = F.struct("o_totalprice", "o_orderkey")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", key).alias("dearest"), F.min_by("o_orderkey", key).alias("cheapest"))


@query("agg08_ordered_lists", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments, array_to_string((list(c_name ORDER BY c_acctbal DESC, c_custkey))[1:3], ',') AS richest FROM customer GROUP BY 1")
def ordered_lists(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"), F.array_join(facets.top_values("c_name", [-F.col("c_acctbal"), F.col("c_custkey")], 3), ",").alias("richest"))


@query("agg09_string_agg", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def string_agg(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "; ").alias("names"))


@query("agg11_percentiles", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.1), 4) AS p10, round(quantile_cont(p_retailprice, 0.5), 4) AS p50, round(quantile_cont(p_retailprice, 0.9), 4) AS p90 FROM part GROUP BY 1")
def percentiles(spark, sf):
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.percentile("p_retailprice", [0.1, 0.5, 0.9]).alias("p"))
    return p.select("p_brand", *[F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


@query("agg12_having", "SELECT o_custkey, o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL HAVING count(*) > 2 AND sum(o_totalprice) > 300000")
def having(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return g.filter("n > 2 AND t > 300000").drop("t")


@query("agg13_shares", "SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted, round(avg(CAST(l_returnflag = 'R' AS DOUBLE)), 6) AS returned FROM lineitem GROUP BY 1")
def shares(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("weighted"), F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 6).alias("returned"))


@query("agg14_iou_rate", f"WITH b AS (SELECT p_partkey AS id, {PART_BOX} FROM part), t AS (SELECT id, x0 + 1 AS x0, y0 AS y0, x1 + 1 AS x1, y1 FROM b), s AS (SELECT t.id, (least(t.x1, b.x1) - greatest(t.x0, b.x0)) * (least(t.y1, b.y1) - greatest(t.y0, b.y0)) AS i, (t.x1 - t.x0) * (t.y1 - t.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS u FROM t JOIN b ON t.x0 <= b.x1 AND b.x0 <= t.x1 AND t.y0 <= b.y1 AND b.y0 <= t.y1), m AS (SELECT t.id, coalesce(max(i / (u - i)), 0) AS iou FROM t LEFT JOIN s USING (id) GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS n, CAST(count_if(iou >= 0.8) AS BIGINT) AS matched, round(median(iou), 6) AS median FROM m")
def iou_rate(spark, sf):
    b = points(spark, sf, "part", "p_partkey", PART_BOX)
    t = b.withColumns({"x0": F.col("x0") + 1, "x1": F.col("x1") + 1})
    # Equal boxes have the same best.
    box = ["x0", "y0", "x1", "y1"]
    pairs = spatial.overlap_area(spatial.box_join(t.select(*box).distinct(), b.select(*box).distinct(), 16.0))
    best = pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in box]).agg(F.max("iou").alias("iou"))
    m = t.join(best.hint("merge"), box, "left").select(F.coalesce("iou", F.lit(0.0)).alias("iou"))
    return m.agg(F.count("*").alias("n"), F.count_if(F.col("iou") >= 0.8).alias("matched"), F.round(F.median("iou"), 6).alias("median"))


@query("agg15_two_level", "SELECT s_nationkey, max(t) AS most, round(avg(t), 4) AS mean FROM (SELECT l_suppkey, round(sum(l_extendedprice), 2) AS t FROM lineitem GROUP BY 1) JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def two_level(spark, sf):
    per = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("t"))
    return per.join(table(spark, sf, "supplier"), "s_suppkey").groupBy("s_nationkey").agg(F.max("t").alias("most"), F.round(F.avg("t"), 4).alias("mean"))


@query("agg16_facets", """WITH v AS (SELECT 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_name', p_name FROM part), c AS (SELECT field, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2), d AS (SELECT *, count(*) OVER (PARTITION BY field) AS k FROM c)
SELECT field, 'choice' AS kind, value, CAST(n AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high FROM d WHERE k <= 40 UNION ALL SELECT DISTINCT field, 'text', NULL, NULL, NULL, NULL FROM d WHERE k > 40
UNION ALL SELECT 'p_size', 'number', NULL, NULL, min(p_size), max(p_size) FROM part UNION ALL SELECT 'p_retailprice', 'number', NULL, NULL, min(p_retailprice), max(p_retailprice) FROM part""")
def facet_profile(spark, sf):
    return facets.profile(table(spark, sf, "part"), ["p_brand", "p_type", "p_name", "p_size", "p_retailprice"])


@query("agg17_samples", "SELECT field, array_to_string(list_sort(list(value)), '|') AS samples, CAST(any_value(total) AS BIGINT) AS n FROM (SELECT DISTINCT 'c_mktsegment' AS field, c_mktsegment AS value, (SELECT count(*) FROM customer) AS total FROM customer) GROUP BY 1")
def samples(spark, sf):
    return facets.value_samples(table(spark, sf, "customer"), ["c_mktsegment"])


@query("agg18_tag_inventory", """WITH t AS (SELECT 'type' AS key, event_type AS value, value AS v FROM events UNION ALL SELECT 'k', json_extract_string(props, '$.k'), value FROM events), c AS (SELECT key, value, count(*) AS n, count(*) FILTER (v > 50) AS kept FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS k FROM c)
SELECT key, CAST(sum(n) AS BIGINT) AS n, CAST(sum(kept) AS BIGINT) AS kept, string_agg(value, ',' ORDER BY k) FILTER (k <= 3) AS top FROM r GROUP BY 1""")
def tag_inventory(spark, sf):
    e = table(spark, sf, "events")
    tags = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return facets.tag_inventory(e.select(tags.alias("tags"), (F.col("value") > 50).alias("kept")), 3)


@query("agg19_rollup", "SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("agg21_noisy_or", "WITH b AS (SELECT user_id, event_type, max(value / (value + 100)) AS c FROM events GROUP BY 1, 2) SELECT user_id, round(1 - product(1 - c), 2) AS confidence FROM b GROUP BY 1")
def noisy_or(spark, sf):
    e = table(spark, sf, "events").withColumn("c", F.col("value") / (F.col("value") + 100))
    return matching.noisy_or(["user_id"], e, "event_type", "c")


@query("agg22_use_vote", "WITH u AS (SELECT l_suppkey, p_brand, count(*) AS n, min(p_partkey) AS first FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT l_suppkey, arg_max(p_brand, (n, -first)) AS brand, CAST(max(n) AS BIGINT) AS votes FROM u GROUP BY 1")
def use_vote(spark, sf):
    u = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return u.groupBy("l_suppkey").agg(F.max_by("p_brand", F.struct("n", -F.col("first"))).alias("brand"), F.max("n").alias("votes"))


@query("agg23_peak_hour", "WITH h AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, CAST(max(n) AS BIGINT) AS peak, CAST(arg_max(h, (n, -h)) AS BIGINT) AS peak_hour, CAST(sum(n) AS BIGINT) AS departures FROM h GROUP BY 1")
def peak_hour(spark, sf):
    return facets.peak_hour(table(spark, sf, "events"), "user_id", "ts")
