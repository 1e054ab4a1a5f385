"""Scalar functions: strings (STR), dates (DAT), numbers (MTH), lists, maps, JSON (LST, MAP, JSN), ids (UID)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import profiles, shapes, tags
from kerbline.plans.registry import query, table


@query("str01_basic", "SELECT p_partkey, left(p_name, 4) AS l, substr(p_type, 3, 5) AS s, split_part(p_brand, '#', 2) AS part, lower(p_type) AS low, trim('  ' || p_name || ' ') AS t, replace(p_type, ' ', '-') AS r, p_brand || '/' || p_partkey AS id FROM part")
def basic(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.left("p_name", F.lit(4)).alias("l"), F.substring("p_type", 3, 5).alias("s"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("part"), F.lower("p_type").alias("low"), F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("t"), F.replace("p_type", F.lit(" "), F.lit("-")).alias("r"), F.concat_ws("/", "p_brand", "p_partkey").alias("id"))


@query("str02_extract", "SELECT event_id, try_cast(nullif(regexp_extract(props, '-?[0-9]+', 0), '') AS INT) AS level, try_cast(nullif(regexp_extract(value || ' m', '^\\s*([0-9]+([.][0-9]+)?)', 1), '') AS DOUBLE) AS lead FROM events")
def extract(spark, sf):
    return table(spark, sf, "events").select("event_id", tags.first_integer(F.col("props")).alias("level"), tags.leading_number(F.concat(F.col("value").cast("string"), F.lit(" m"))).alias("lead"))


@query("str03_all_matches", "SELECT page_id, CAST(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS BIGINT) AS links, array_to_string(regexp_extract_all(url, '[0-9]+'), '|') AS numbers FROM pages")
def all_matches(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.array_join(F.regexp_extract_all("url", F.lit("([0-9]+)"), F.lit(1)), "|").alias("numbers"))


@query("str04_joined_names", "SELECT n_regionkey, array_to_string((list_sort(list(DISTINCT n_name)))[1:3], ' x ') AS name, concat_ws('|', min(n_name), NULL, max(n_name)) AS ends FROM nation GROUP BY 1")
def joined_names(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.slice(F.array_sort(F.collect_set("n_name")), 1, 3), " x ").alias("name"), F.concat_ws("|", F.min("n_name"), F.lit(None).cast("string"), F.max("n_name")).alias("ends"))


@query("str05_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tags.slug(F.concat_ws(" ", "p_brand", "p_type")).alias("slug"))


@query("str06_units", "SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN p_size * 0.3048 WHEN 1 THEN p_size * 0.3048 ELSE p_size END, 6) AS m FROM part")
def units(spark, sf):
    text = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, " ft").otherwise(" (m)"))
    return table(spark, sf, "part").select("p_partkey", F.round(tags.metres(text), 6).alias("m"))


@query("str07_vocabulary", "SELECT event_id, CASE event_type WHEN 'view' THEN 'look' WHEN 'click' THEN 'look' WHEN 'purchase' THEN 'trade' WHEN 'signup' THEN 'trade' ELSE 'other' END AS grp FROM events")
def vocabulary(spark, sf):
    return table(spark, sf, "events").select("event_id", tags.vocabulary(F.col("event_type"), {"look": ["view", "click"], "trade": ["purchase", "signup"]}, "other").alias("grp"))


@query("str08_rendered", "SELECT o_orderkey, concat_ws('; ', 'pay $' || CAST(floor(o_totalprice / 1000) AS BIGINT) || '/h', CASE WHEN o_orderstatus = 'F' THEN 'no parking' END, nullif(o_orderpriority, '5-LOW')) AS rule FROM orders")
def rendered(spark, sf):
    pay = F.concat(F.lit("pay $"), F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("/h"))
    return table(spark, sf, "orders").select("o_orderkey", F.concat_ws("; ", pay, F.when(F.col("o_orderstatus") == "F", "no parking"), F.nullif("o_orderpriority", F.lit("5-LOW"))).alias("rule"))


@query("dat01_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, isodow(ts) = 3 AS wednesday, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(strftime(ts, '%Y%m%d') AS BIGINT) BETWEEN 20240105 AND 20240120 AS served FROM events")
def dates(spark, sf):
    day = F.date_format("ts", "yyyyMMdd").cast("long")
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.dayofweek("ts") == 4).alias("wednesday"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), day.between(20240105, 20240120).alias("served"))


@query("dat02_fixed_now", "SELECT user_id, min(ts) AS first_seen, TIMESTAMP '2026-01-01 00:00:00' AS built FROM events GROUP BY 1")
def fixed_now(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("built"))


@query("mth01_rounding", "SELECT o_orderkey, round(o_totalprice / 7, 2) AS r, CAST(ceil(o_totalprice / 1000) AS BIGINT) AS c, CAST(floor(-o_totalprice / 1000) AS BIGINT) AS f, abs(o_totalprice - 100000) AS a, round(sqrt(o_totalprice), 6) AS q FROM orders")
def rounding(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.round(p / 7, 2).alias("r"), F.ceil(p / 1000).alias("c"), F.floor(-p / 1000).alias("f"), F.abs(p - 100000).alias("a"), F.round(F.sqrt(p), 6).alias("q"))


@query("mth02_angles", "SELECT p_partkey, round(degrees(atan2(p_size - 25, p_partkey % 50 - 25)), 6) AS a, CAST(((p_size * 17 - p_partkey + 180) % 360 + 360) % 360 - 180 AS DOUBLE) AS turn, round(cos(radians(p_size)), 6) AS c FROM part")
def angles(spark, sf):
    x, y = F.col("p_partkey") % 50 - 25, F.col("p_size") - 25
    return table(spark, sf, "part").select("p_partkey", F.round(F.degrees(F.atan2(y, x)), 6).alias("a"), shapes.turn((F.col("p_size") * 17).cast("double"), F.col("p_partkey").cast("double")).alias("turn"), F.round(F.cos(F.radians("p_size")), 6).alias("c"))


@query("mth04_degree_box", "SELECT s_suppkey, round(250 / 111320.0, 9) AS dlat, round(250 / (111320.0 * cos(radians(40 + s_nationkey))), 9) AS dlon FROM supplier")
def degree_box(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.round(F.lit(250) / 111320.0, 9).alias("dlat"), F.round(250 / (111320.0 * F.cos(F.radians(40 + F.col("s_nationkey")))), 9).alias("dlon"))


@query("mth05_vertical_curve", """SELECT p_partkey, round(CASE WHEN abs(s - 400) < 60 THEN 16 - 60 * 0.04 + 0.04 * (s - 340) + (-16 / 600.0 - 0.04) / 240 * (s - 340) ** 2
  WHEN s <= 400 THEN s * 0.04 ELSE 16.0 - (s - 400) * 16 / 600 END, 6) AS z FROM (SELECT p_partkey, CAST(p_partkey % 1000 AS DOUBLE) AS s FROM part)""")
def vertical_curve(spark, sf):
    knots = [(0.0, 0.0), (400.0, 16.0), (1000.0, 0.0)]
    z = profiles.height(knots, (F.col("p_partkey") % 1000).cast("double"), 120.0)
    return table(spark, sf, "part").select("p_partkey", F.round(z, 6).alias("z"))


@query("lst01_lists", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags, array_to_string(list_filter(list_sort(list(l_linenumber)), lambda x: x > 2)[1:2], ',') AS later, list_contains(list(l_linestatus), 'O') AS any_open FROM lineitem GROUP BY 1")
def lists(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"), F.array_sort(F.collect_list("l_linenumber")).alias("n"), F.collect_set("l_linestatus").alias("s"))
    return g.select("l_orderkey", F.array_join(F.array_sort("f"), ",").alias("flags"), F.array_join(F.slice(F.filter("n", lambda x: x > 2), 1, 2), ",").alias("later"), F.array_contains("s", "O").alias("any_open"))


@query("map01_maps", "SELECT user_id, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS clicks FROM events GROUP BY 1")
def maps(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.size(F.map_keys("m")).cast("long").alias("kinds"), F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).alias("clicks"))


@query("jsn01_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def json(spark, sf):
    back = F.to_json(F.map_from_arrays(F.array(F.lit("k")), F.array(F.get_json_object("props", "$.k"))))
    return table(spark, sf, "events").select("event_id", F.get_json_object(back, "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("uid01_named_ids", "SELECT p_partkey, md5('part|' || p_partkey) AS uid FROM part")
def named_ids(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.md5(F.concat_ws("|", F.lit("part"), F.col("p_partkey").cast("string"))).alias("uid"))


@query("sem_building_levels", "SELECT p_partkey, CAST(CASE WHEN p_size % 5 = 0 THEN -coalesce(fl, ug, 1) ELSE coalesce(mn, 0) - coalesce(ug, 0) END AS BIGINT) AS low, CAST(CASE WHEN p_size % 5 = 0 THEN -1 ELSE coalesce(fl, round(h / 3), 1) - 1 + coalesce(mn, 0) END AS BIGINT) AS high FROM (SELECT *, nullif(p_size % 8, 0) AS fl, nullif(p_size % 3, 0) AS ug, nullif(p_size % 4, 1) AS mn, CASE WHEN p_size > 20 THEN CAST(p_size AS DOUBLE) END AS h FROM part)")
def building_levels(spark, sf):
    s, n = F.col("p_size").cast("long"), lambda c, v: F.nullif(c, F.lit(v).cast("long"))
    span = tags.building_span(n(s % 8, 0), n(s % 3, 0), n(s % 4, 1), F.when(s > 20, s.cast("double")), s % 5 == 0)
    return table(spark, sf, "part").select("p_partkey", span.alias("x")).select("p_partkey", "x.low", "x.high")


@query("sem_road_level", "SELECT event_id, CAST(coalesce(try_cast(nullif(json_extract_string(props, '$.k'), '7') AS INT), CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN -1 ELSE 0 END) AS INT) AS level FROM events")
def road_level(spark, sf):
    tag = lambda v: F.when(F.col("event_type") == v, "yes")
    return table(spark, sf, "events").select("event_id", tags.road_level(F.nullif(F.get_json_object("props", "$.k"), F.lit("7")), tag("view"), tag("click")).alias("level"))
