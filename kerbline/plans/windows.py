"""Windows (WIN), sorting and limits (SRT), set operations (SET)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline.operators import series
from kerbline.plans.registry import query, table


@query("win01_keep_one", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def keep_one(spark, sf):
    # A grouped maximum, as rows of one group need not be sorted for it.
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("win02_surrogate", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_nationkey, c_custkey) AS BIGINT) AS id FROM customer")
def surrogate(spark, sf):
    return series.numbered(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey", "c_custkey"], "id").select("c_custkey", "id")


@query("win03_lead", "SELECT event_id, lead(event_type) OVER w AS following, lead(value, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lead(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.lead("event_type").over(w).alias("following"), F.lead("value", 2).over(w).alias("second"))


@query("win04_moving_median", "SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS m5, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS m9 FROM events")
def moving_median(spark, sf):
    m = lambda k: F.round(series.moving_median("value", ["user_id"], ["ts", "event_id"], k), 6)
    return table(spark, sf, "events").select("event_id", m(2).alias("m5"), m(4).alias("m9"))


@query("win05_share_switch", "SELECT event_id, CASE WHEN avg(CAST(value > 30 AS INT)) OVER (PARTITION BY user_id) >= 0.5 THEN value ELSE 25.0 END AS used FROM events")
def share_switch(spark, sf):
    share = F.avg((F.col("value") > 30).cast("int")).over(Window.partitionBy("user_id"))
    return table(spark, sf, "events").select("event_id", F.when(share >= 0.5, F.col("value")).otherwise(25.0).alias("used"))


RUNS = "a AS (SELECT *, CAST(event_type IS DISTINCT FROM lag(event_type) OVER w AS INT) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)"


@query("win06_runs", f"WITH {RUNS} SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1, 2")
def runs(spark, sf):
    return series.runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("win06_smoothed_runs", f"WITH {RUNS}, r AS (SELECT user_id, run, any_value(event_type) AS t, count(*) AS n FROM b GROUP BY 1, 2), s AS (SELECT user_id, run, last_value(CASE WHEN n >= 2 THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY run) AS kept, t FROM r) SELECT b.event_id, coalesce(s.kept, s.t) AS smoothed FROM b JOIN s USING (user_id, run)")
def smoothed_runs(spark, sf):
    return series.smoothed(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", least=2).select("event_id", "smoothed")


@query("win07_change_points")
def change_points(spark, sf):
    return series.change_points(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", step=40.0, ahead=3)


@query("win08_ranges", "SELECT event_id, round(sum(value) OVER w - value, 6) AS s_from, round(sum(value) OVER w, 6) AS s_to, first_value(event_id) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def ranges(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = F.sum("value").over(w)
    return table(spark, sf, "events").select("event_id", F.round(s - F.col("value"), 6).alias("s_from"), F.round(s, 6).alias("s_to"), F.first("event_id").over(w).alias("first"))


@query("win09_numbered_ids", "SELECT p_partkey, p_brand || CASE WHEN n = 1 THEN '' ELSE '.' || n END AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS n FROM part)")
def numbered_ids(spark, sf):
    return series.suffixed(table(spark, sf, "part"), "p_brand", ["p_size", "p_partkey"], ".").select("p_partkey", "id")


@query("win10_distinct_on", "SELECT l_partkey, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS kept FROM lineitem GROUP BY ALL")
def distinct_on(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("kept"))


@query("srt01_order", "SELECT p_partkey, p_size FROM part ORDER BY (p_brand = 'Brand#3') DESC, nullif(p_size, 7) DESC NULLS LAST, p_partkey")
def order(spark, sf):
    p = table(spark, sf, "part")
    return p.orderBy(F.desc(F.col("p_brand") == "Brand#3"), F.desc_nulls_last(F.nullif("p_size", F.lit(7))), "p_partkey").select("p_partkey", "p_size")


@query("srt02_limit_with_totals", "SELECT o_orderkey, CAST((SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS BIGINT) AS total FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def limit_with_totals(spark, sf):
    o = table(spark, sf, "orders").filter("o_totalprice > 100000")
    first = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey")
    return first.crossJoin(F.broadcast(o.agg(F.count("*").alias("total"))))  # one row


@query("srt03_more_rows", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 201")
def more_rows(spark, sf):
    return table(spark, sf, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(201).select("l_orderkey", "l_linenumber")


@query("srt04_top_per_group", "SELECT p_brand, p_type, CAST(n AS BIGINT) AS n FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) <= 3")
def top_per_group(spark, sf):
    return series.top(table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")), ["p_brand"], [F.desc("n"), F.col("p_type")], 3)


@query("srt05_nearest_first", "SELECT s_suppkey, CAST((s_suppkey * 6151) % 1000 AS DOUBLE) AS x FROM supplier ORDER BY abs((s_suppkey * 6151) % 1000 - 500), s_nationkey <> 3, s_suppkey LIMIT 1")
def nearest_first(spark, sf):
    s = table(spark, sf, "supplier").withColumn("x", ((F.col("s_suppkey") * 6151) % 1000).cast("double"))
    return s.orderBy(F.abs(F.col("x") - 500), F.col("s_nationkey") != 3, "s_suppkey").limit(1).select("s_suppkey", "x")


@query("set01_unions", "SELECT 'c' AS kind, c_name AS name, c_acctbal AS bal, NULL AS extra FROM customer UNION ALL SELECT 's', s_name, s_acctbal, s_suppkey FROM supplier UNION SELECT 'n', n_name, NULL, NULL FROM nation")
def unions(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("c").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    s = table(spark, sf, "supplier").select(F.lit("s").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("extra"))
    n = table(spark, sf, "nation").select(F.lit("n").alias("kind"), F.col("n_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True).unionByName(n, allowMissingColumns=True).distinct()


@query("set02_except", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, sf, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("set03_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("set04_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("set05_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity < 5 OR l_discount = 0)")
def delete(spark, sf):
    return table(spark, sf, "lineitem").filter(~((F.col("l_quantity") < 5) | (F.col("l_discount") == 0))).select("l_orderkey", "l_linenumber")


@query("set06_insert_by_name", "SELECT r_name AS name, r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT n_name, n_nationkey, n_regionkey FROM nation")
def insert_by_name(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("id"))
    return r.unionByName(table(spark, sf, "nation").select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), allowMissingColumns=True)
