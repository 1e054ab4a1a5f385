"""Sources (SRC) and sinks (SNK); what is written goes to the folder that the session shares."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.functions import shapes as g
from kerbline.operators import corrections
from kerbline.operators.store import shared_dir
from kerbline.plans.geometry import BOX, rings
from kerbline.plans.joins import PART_POINT, columns
from kerbline.plans.registry import query, table
from kerbline.sources import clustered, readers, writers


def place(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/kerbline-{name}-{uuid.uuid4().hex}"


@query("src01_catalog", "SELECT CAST(count(*) AS BIGINT) AS n FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalog(spark, sf):
    for t in ("nation", "region"):
        table(spark, sf, t).createOrReplaceTempView(f"osm_{t}")
    return spark.sql("SELECT count(*) AS n FROM osm_nation JOIN osm_region ON n_regionkey = r_regionkey")


@query("src03_union_by_name", "SELECT c_custkey AS edge, c_nationkey AS node, 'road' AS kind, c_mktsegment AS name FROM customer UNION ALL SELECT s_suppkey, s_nationkey, 'walk', NULL FROM supplier")
def union_by_name(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("edge"), F.col("c_nationkey").alias("node"), F.lit("road").alias("kind"), F.col("c_mktsegment").alias("name"))
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("node"), F.col("s_suppkey").alias("edge"), F.lit("walk").alias("kind")), allowMissingColumns=True)


@query("src04_tag_maps", "SELECT event_id, json_extract_string(props, '$.k') AS k, NULL AS missing FROM events")
def tag_maps(spark, sf):
    tags = F.from_json("props", "map<string, string>")
    return table(spark, sf, "events").select("event_id", tags.alias("t")).select("event_id", F.try_element_at("t", F.lit("k")).alias("k"), F.try_element_at("t", F.lit("layer")).alias("missing"))


@query("src06_feature_collection", f"{BOX} SELECT CAST(id AS VARCHAR) AS id, x0 AS x, y0 AS y FROM b")
def feature_collection(spark, sf):
    f = rings(spark, sf).withColumn("coordinates", F.array("x0", "y0")).select(F.floor(F.col("id") / 100).alias("file"), F.struct(F.col("id").cast("string").alias("id"), F.struct(F.lit("Point").alias("type"), "coordinates").alias("geometry")).alias("f"))
    path = place(spark, "features")
    docs = f.groupBy("file").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("f").alias("features"))).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    read = readers.feature_collections(spark, path)
    xy = F.from_json("coordinates", "array<double>")
    return read.select("id", xy[0].alias("x"), xy[1].alias("y"))


@query("src10_box_scan", f"SELECT id FROM (SELECT p_partkey AS id, {PART_POINT} FROM part) WHERE x BETWEEN 100 AND 300 AND y BETWEEN 400 AND 900")
def box_scan(spark, sf):
    path = place(spark, "tiles")
    table(spark, sf, "part").selectExpr("p_partkey AS id", *columns(PART_POINT)).repartitionByRange("x").sortWithinPartitions("x", "y").write.parquet(path)
    return readers.in_box(spark.read.parquet(path), 100, 400, 300, 900).select("id")


@query("src10_clustered_scan", f"SELECT id, x, y FROM (SELECT p_partkey AS id, {PART_POINT} FROM part) WHERE x BETWEEN 120 AND 310 AND y BETWEEN 440 AND 870")
def clustered_scan(spark, sf):
    path, grid = place(spark, "clustered"), clustered.Grid(0.0, 0.0, 1000.0, 1000.0)
    clustered.write(table(spark, sf, "part").selectExpr("p_partkey AS id", *columns(PART_POINT)), grid, path)
    return clustered.in_box(spark.read.parquet(path), grid, (120.0, 440.0, 310.0, 870.0))


@query("src12_xml", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def xml(spark, sf):
    path = place(spark, "xml")
    table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).write.format("xml").option("rowTag", "lane").save(path)
    return readers.xml_rows(spark, path, "lane", "id int, name string")


@query("src15_synthetic", "SELECT v.name, v.low, unnest(range(v.low, v.high + 1)) AS step FROM (VALUES ('a', 1, 3), ('b', 5, 4), ('c', 2, 2)) v(name, low, high)")
def synthetic(spark, sf):
    v = spark.sql("SELECT * FROM VALUES ('a', 1, 3), ('b', 5, 4), ('c', 2, 2) AS v(name, low, high)")
    steps = F.when(F.col("low") <= F.col("high"), F.sequence("low", "high")).otherwise(F.array().cast("array<int>"))
    return v.select("name", "low", F.explode(steps).alias("step")).withColumn("step", F.col("step").cast("long"))


@query("src17_clip", "WITH o AS (SELECT * FROM orders WHERE o_totalprice > 200000), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)) SELECT 'orders' AS relation, CAST(count(*) AS BIGINT) AS n FROM o UNION ALL SELECT 'lineitem', count(*) FROM l UNION ALL SELECT 'part', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)")
def clip(spark, sf):
    t = {n: table(spark, sf, n) for n in ("orders", "lineitem", "part")}
    c = readers.clipped(t, "orders", t["orders"].filter("o_totalprice > 200000"), [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("part", "p_partkey", "lineitem", "l_partkey")])
    out = [c[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("relation"), "n") for n in t]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("snk02_typed", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS DOUBLE) AS level, CAST(NULL AS VARCHAR) AS attrs FROM nation")
def typed(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("level"))
    kind = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("level", T.DoubleType()), T.StructField("attrs", T.StringType())])
    path = place(spark, "typed")
    writers.replace(writers.typed(n, kind), path)
    return spark.read.schema(kind).parquet(path)


@query("snk03_measured", f"{BOX} SELECT id, 2 * (x1 - x0 + y1 - y0) AS __len, (x1 - x0) * (y1 - y0) AS __area, round((x0 + x1) / 2, 6) AS __x, round((y0 + y1) / 2, 6) AS __y, x0 AS __w, y0 AS __s, x1 AS __e, y1 AS __n FROM b")
def measured(spark, sf):
    m = writers.measured(rings(spark, sf).select("id", "ring"), "ring").drop("ring")
    return m.withColumns({"__x": F.round("__x", 6), "__y": F.round("__y", 6)})


@query("snk05_documents", "SELECT r_regionkey AS id, r_name AS name FROM region")
def json_documents(spark, sf):
    path = place(spark, "json")
    writers.documents(table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), path)
    return spark.read.schema("id int, name string").json(path)


@query("snk10_replaced", "SELECT r_regionkey AS id, 'two' AS run FROM region")
def replaced(spark, sf):
    path = place(spark, "checks")
    for run in ("one", "two"):
        writers.replace(table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.lit(run).alias("run")), path)
    return spark.read.schema("id int, run string").parquet(path)


@query("fun_wkt_of_line", f"{BOX} SELECT id, x1 AS ex, y1 AS ey FROM b")
def wkt_line(spark, sf):
    back = rings(spark, sf).select("id", g.from_wkt(g.wkt(F.slice("ring", 1, 3))).alias("p"))
    return back.select("id", g.end(F.col("p"))["x"].alias("ex"), g.end(F.col("p"))["y"].alias("ey"))


@query("src02_snapshot", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def snapshot(spark, sf):
    path = place(spark, "source")
    writers.replace(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), path)
    kept = writers.snapshot(spark.read.schema("id int, name string").parquet(path), place(spark, "snapshot"))
    writers.replace(kept.select("id", F.lit("changed").alias("name")), path)
    return kept


@query("src07_bound_shape", f"{BOX} SELECT id FROM b WHERE x0 >= 100 AND x1 <= 400 AND y0 >= 50 AND y1 <= 700")
def bound_shape(spark, sf):
    # A box handed over as a GeoJSON parameter of the statement.
    rings(spark, sf).createOrReplaceTempView("bound_shape_boxes")
    given = '{"type": "LineString", "coordinates": [[100, 50], [400, 50], [400, 700], [100, 700], [100, 50]]}'
    box = spark.sql("SELECT from_json(:shape, 'struct<coordinates: array<array<double>>>').coordinates AS c", args={"shape": given}).select(g.box(F.transform("c", lambda p: g.point(p[0], p[1]))).alias("b")).select("b.*").first()
    sql = "SELECT id FROM bound_shape_boxes WHERE x0 >= :x0 AND x1 <= :x1 AND y0 >= :y0 AND y1 <= :y1"
    return spark.sql(sql, args=box.asDict())


@query("src08_members", "SELECT o_custkey AS grp, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS k, o_orderkey AS member FROM orders")
def members(spark, sf):
    path = place(spark, "groups")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("of"))
    writers.replace(o, path)
    return readers.members(spark.read.schema(o.schema).parquet(path), "grp", "of").withColumn("k", F.col("k").cast("long"))


@query("src13_lane_overrides", "SELECT s_suppkey AS key, CAST((1 + s_suppkey % 3) * CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS lanes FROM supplier WHERE s_suppkey % 4 = 1")
def lane_overrides(spark, sf):
    s = table(spark, sf, "supplier")
    ways = s.select(F.col("s_suppkey").alias("key"), (F.col("s_nationkey") % 2 == 0).alias("oneway"))
    given = s.filter("s_suppkey % 4 = 1").select(F.col("s_suppkey").alias("key"), (1 + F.col("s_suppkey") % 3).alias("per_direction"))
    return corrections.doubled(given, ways)


@query("src14_corrections", "SELECT s_suppkey AS way, CASE WHEN s_suppkey % 5 = 0 THEN 'corrected' ELSE s_name END AS name, CASE WHEN s_suppkey % 5 = 0 THEN 7 ELSE s_nationkey END AS lanes, CASE WHEN s_suppkey % 5 = 0 THEN 'lanes,name' ELSE '' END AS of, CASE WHEN s_suppkey % 5 = 0 THEN 'seen on site' END AS note FROM supplier")
def hand_corrections(spark, sf):
    path = place(spark, "corrections")
    s = table(spark, sf, "supplier")
    given = s.filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("key"), F.lit("seen on site").alias("note"), F.create_map(F.lit("name"), F.lit("corrected"), F.lit("lanes"), F.lit("7")).alias("set"))
    given.write.json(path)
    ways = s.select(F.col("s_suppkey").alias("way"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("lanes"))
    c = corrections.corrected(ways, "way", ["name", "lanes"], readers.correction_documents(spark, path))
    return c.select("way", "name", "lanes", F.array_join("corrected_fields", ",").alias("of"), "note")


@query("fun_lanes_per_direction", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE CASE WHEN l_returnflag = 'R' THEN 1 ELSE l_linenumber - l_linenumber // 2 END END AS BIGINT) AS along, CAST(CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_linenumber // 2 END AS BIGINT) AS against FROM lineitem")
def lanes_per_direction(spark, sf):
    l = table(spark, sf, "lineitem")
    along, against = corrections.per_direction(F.col("l_linenumber"), F.when(F.col("l_returnflag") == "R", 1), F.lit(None).cast("int"), F.col("l_returnflag") == "A")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", along.alias("along"), against.alias("against"))


@query("snk04_described", "SELECT 'crs' AS key, 'EPSG:32610' AS value, CAST(count(*) AS BIGINT) AS n FROM nation UNION ALL SELECT 'version', '3', count(*) FROM nation")
def described(spark, sf):
    path = place(spark, "described")
    writers.described(table(spark, sf, "nation"), path, {"version": "3", "crs": "EPSG:32610"})
    back = spark.read.parquet(path)
    about = spark.createDataFrame(sorted(writers.about(back).items()), "key string, value string")
    return about.join(F.broadcast(back.agg(F.count("*").alias("n"))))  # one row


@query("snk08_cross_sections", "WITH s AS (SELECT l_orderkey AS section, l_linenumber AS t, l_returnflag AS kind, min(l_quantity) AS width FROM lineitem GROUP BY 1, 2, 3), c AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY t, kind, width) - row_number() OVER (PARTITION BY section, kind ORDER BY t, width) AS run FROM s) SELECT section, CAST(count(DISTINCT (kind, run)) AS BIGINT) AS n, CAST(sum(width) AS DOUBLE) AS width FROM c GROUP BY 1")
def cross_sections(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("section"), F.col("l_linenumber").alias("t"), F.col("l_returnflag").alias("kind")).agg(F.min("l_quantity").alias("width"))
    read = writers.cross_sections(s, "section").select("section", F.from_json("value", "struct<strips: array<struct<kind: string, width: double>>>")["strips"].alias("s"))
    return read.select("section", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0.0), lambda n, x: n + x["width"]).alias("width"))


@query("snk09_manifest", "SELECT 'nation.parquet' AS name, true AS told UNION ALL SELECT 'region.parquet', true")
def manifest(spark, sf):
    m = readers.manifest(spark, [f"{sf}/nation.parquet", f"{sf}/region.parquet"])
    return m.select("name", ((F.col("bytes") > 0) & F.col("modified").isNotNull()).alias("told"))
