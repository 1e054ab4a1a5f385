"""Spatial functions (GEO) over shapes derived from keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline.functions import shapes as g
from kerbline.operators import nodes, spatial
from kerbline.plans.joins import PART_BOX, PART_POINT, SUPPLIER_POINT, points
from kerbline.plans.registry import query, table

BOX = f"WITH b AS (SELECT p_partkey AS id, {PART_BOX} FROM part)"


def rings(spark, sf):
    b = points(spark, sf, "part", "p_partkey", PART_BOX)
    return b.select("id", g.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("ring"), "x0", "y0", "x1", "y1")


def lines(spark, sf):
    """A line of three points for each part: right, then up."""
    r = rings(spark, sf)
    return r.select("id", F.slice("ring", 1, 3).alias("line"), "x0", "y0", "x1", "y1")


@query("geo01_utm_round_trip", "SELECT s_suppkey, round((s_suppkey * 6151) % 1000 / 200.0 + 13, 6) AS lon, round((s_suppkey * 3571) % 1000 / 50.0 + 45, 6) AS lat FROM supplier")
def utm_round_trip(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 6151) % 1000 / 200 + 13).alias("lon"), ((F.col("s_suppkey") * 3571) % 1000 / 50 + 45).alias("lat"))
    back = s.select("s_suppkey", g.utm(F.col("lon"), F.col("lat"), 33).alias("m")).select("s_suppkey", g.lon_lat(F.col("m"), 33).alias("p"))
    return back.select("s_suppkey", F.round("p.x", 6).alias("lon"), F.round("p.y", 6).alias("lat"))


@query("geo03_wkt", f"{BOX} SELECT id, x0 AS x, y0 AS y, CAST(5 AS BIGINT) AS n, 'POLYGON ((' AS head FROM b")
def wkt(spark, sf):
    r = rings(spark, sf).select("id", g.wkt(F.col("ring"), "POLYGON").alias("t"))
    back = r.select("id", "t", g.from_wkt(F.col("t")).alias("p"))
    return back.select("id", F.col("p")[0]["x"].alias("x"), F.col("p")[0]["y"].alias("y"), F.size("p").cast("long").alias("n"), F.substring("t", 1, 10).alias("head"))


@query("geo04_geojson", f"{BOX} SELECT id, x1 AS x, y1 AS y FROM b")
def geojson(spark, sf):
    r = lines(spark, sf).select("id", g.from_geojson(g.geojson(F.col("line"))).alias("p"))
    return r.select("id", F.col("p")[2]["x"].alias("x"), F.col("p")[2]["y"].alias("y"))


@query("geo05_points", f"SELECT p_partkey AS id, {PART_POINT} FROM part")
def point_xy(spark, sf):
    p = points(spark, sf, "part", "p_partkey", PART_POINT).select("id", g.point(F.col("x"), F.col("y")).alias("p"))
    return p.select("id", "p.x", "p.y")


@query("geo07_ends_centroid", f"{BOX} SELECT id, x0 AS sx, y1 AS ey, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy FROM b")
def ends_centroid(spark, sf):
    r = rings(spark, sf).select("id", F.col("ring"), F.slice("ring", 1, 3).alias("line"))
    c = r.select("id", "line", g.centroid(F.col("ring")).alias("c"))
    return c.select("id", g.start(F.col("line"))["x"].alias("sx"), g.end(F.col("line"))["y"].alias("ey"), F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"))


@query("geo08_measures", f"{BOX} SELECT id, round((x1 - x0) * (y1 - y0), 6) AS area, round(2 * (x1 - x0 + y1 - y0), 6) AS perimeter, round(x1 - x0 + y1 - y0, 6) AS length FROM b")
def measures(spark, sf):
    return rings(spark, sf).select("id", F.round(g.signed_area(F.col("ring")), 6).alias("area"), F.round(g.length(F.col("ring")), 6).alias("perimeter"), F.round(g.length(F.slice("ring", 1, 3)), 6).alias("length"))


@query("geo09_distance_to_line", f"{BOX} SELECT id, round(x1 - x0, 6) AS d FROM b")
def distance_to_line(spark, sf):
    # From the ring's lower left corner to its right side.
    r = rings(spark, sf)
    return r.select("id", F.round(g.distance_to(F.slice("ring", 2, 2), g.point(F.col("x0"), F.col("y0"))), 6).alias("d"))


@query("geo10_haversine", "SELECT s_suppkey, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(s_nationkey) / 2), 2) + cos(radians(50)) * cos(radians(50 + s_nationkey)) * pow(sin(radians(1) / 2), 2))), 3) AS d FROM supplier")
def haversine(spark, sf):
    k = F.col("s_nationkey")
    return table(spark, sf, "supplier").select("s_suppkey", F.round(g.haversine(F.lit(10.0), F.lit(50.0), F.lit(11.0), 50.0 + k), 3).alias("d"))


@query("geo12_point_in_ring", f"WITH b AS (SELECT p_partkey AS id, {PART_BOX} FROM part), s AS (SELECT s_suppkey AS sid, x + 0.5 AS x, y + 0.5 AS y FROM (SELECT s_suppkey, {SUPPLIER_POINT} FROM supplier)) SELECT sid, id FROM s JOIN b ON x > x0 AND x < x1 AND y > y0 AND y < y1")
def point_in_ring(spark, sf):
    s = points(spark, sf, "supplier", "s_suppkey", SUPPLIER_POINT).select("id", (F.col("x") + 0.5).alias("x0"), (F.col("y") + 0.5).alias("y0"))
    s = s.withColumns({"x1": F.col("x0"), "y1": F.col("y0")})
    near = spatial.box_join(s, rings(spark, sf), 16.0)
    return near.filter(g.contains(F.col("b.ring"), g.point(F.col("a.x0"), F.col("a.y0")))).select(F.col("a.id").alias("sid"), F.col("b.id").alias("id"))


@query("geo13_interpolate", f"{BOX} SELECT id, round(least(x0 + 3, x1), 6) AS x, round(y0 + greatest(least(3 - (x1 - x0), y1 - y0), 0), 6) AS y FROM b")
def interpolate(spark, sf):
    p = lines(spark, sf).select("id", g.interpolate(F.col("line"), F.lit(3.0)).alias("p"))
    return p.select("id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("geo15_box_overlay", f"{BOX} SELECT a.id AS one, b.id AS two, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared FROM b a JOIN b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def box_overlay(spark, sf):
    b = points(spark, sf, "part", "p_partkey", PART_BOX)
    o = spatial.overlap_area(spatial.box_join(b, b, 16.0).filter("a.id < b.id"))
    return o.filter("shared > 0").select(F.col("a.id").alias("one"), F.col("b.id").alias("two"), "shared")


@query("geo18_dump", f"{BOX} SELECT id, unnest([0, 1, 2]) AS k, unnest([x0, x1, x1]) AS x, unnest([y0, y0, y1]) AS y FROM b")
def dump(spark, sf):
    return lines(spark, sf).select("id", F.posexplode("line").alias("k", "p")).select("id", "k", "p.x", "p.y")


@query("geo20_bounds", f"{BOX} SELECT id, x0, y0, x1, y1 FROM b")
def bounds(spark, sf):
    return rings(spark, sf).select("id", g.box(F.col("ring")).alias("b")).select("id", "b.*")


@query("geo24_project", f"{BOX} SELECT id, round(x1 - x0 + (y1 - y0) / 2, 6) AS s, -2.0 AS t FROM b")
def project(spark, sf):
    # Two to the right of the middle of the upward part.
    r = lines(spark, sf)
    q = r.select("id", g.project(F.col("line"), g.point(F.col("x1") + 2, (F.col("y0") + F.col("y1")) / 2)).alias("q"))
    return q.select("id", F.round("q.s", 6).alias("s"), F.round("q.t", 6).alias("t"))


@query("geo25_parallel", f"{BOX} SELECT id, x0 AS x, y0 + 2 AS y FROM b")
def parallel(spark, sf):
    p = rings(spark, sf).select("id", g.shifted(F.slice("ring", 1, 2), F.lit(2.0)).alias("p"))
    return p.select("id", F.col("p")[0]["x"].alias("x"), F.col("p")[0]["y"].alias("y"))


@query("geo28_stations", f"{BOX}, l AS (SELECT *, x1 - x0 + y1 - y0 AS len FROM b) SELECT id, CAST(k AS BIGINT) AS k, round(least(x0 + k * 3, x1), 6) AS x, round(y0 + greatest(k * 3 - (x1 - x0), 0), 6) AS y FROM (SELECT *, unnest(range(0, CAST(floor(len / 3) AS BIGINT) + 1)) AS k FROM l)")
def stations(spark, sf):
    l = lines(spark, sf).withColumn("len", g.length(F.col("line")))
    at = l.select("id", "line", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("len") / 3))).alias("k"))
    p = at.select("id", "k", g.interpolate(F.col("line"), F.col("k") * 3.0).alias("p"))
    return p.select("id", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("geo32_half_plane", f"{BOX} SELECT id, round((x1 - x0) / 2 * (y1 - y0), 6) AS area FROM b")
def half_plane(spark, sf):
    r = rings(spark, sf).select("id", g.clip(F.col("ring"), F.lit(1.0), F.lit(0.0), (F.col("x0") + F.col("x1")) / 2).alias("left"))
    return r.select("id", F.round(g.signed_area(F.col("left")), 6).alias("area"))


@query("geo36_extent", f"{BOX} SELECT id, 0.0 AS s0, round(x1 - x0, 6) AS s1, 0.0 AS t0, round(y1 - y0, 6) AS t1 FROM b")
def extent(spark, sf):
    r = rings(spark, sf).select("id", g.extent(F.slice("ring", 1, 2), F.col("ring")).alias("e"))
    return r.select("id", *[F.round(f"e.{c}", 6).alias(c) for c in ("s0", "s1", "t0", "t1")])


@query("geo38_strip_size", f"{BOX} SELECT id, round(least(x1 - x0, y1 - y0), 5) AS width, round(greatest(x1 - x0, y1 - y0), 5) AS length FROM b")
def strip_size(spark, sf):
    r = rings(spark, sf).select("id", g.strip_size(g.signed_area(F.col("ring")), g.length(F.col("ring"))).alias("s"))
    return r.select("id", F.round("s.width", 5).alias("width"), F.round("s.length", 5).alias("length"))


@query("geo41_deck_top", "WITH g AS (SELECT *, CAST(value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) > 3 AS INT) AS gap FROM events), c AS (SELECT *, coalesce(sum(gap) OVER (PARTITION BY user_id ORDER BY value, event_id), 0) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n, quantile_cont(value, 0.95) AS top FROM c GROUP BY 1, 2) SELECT user_id, round(arg_max(top, (n, -k)), 6) AS top, CAST(max(n) AS BIGINT) AS n FROM n GROUP BY 1")
def deck_top(spark, sf):
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    e = table(spark, sf, "events").withColumn("gap", (F.col("value") - F.lag("value").over(w) > 3).cast("int"))
    c = e.withColumn("k", F.coalesce(F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)))
    n = c.groupBy("user_id", "k").agg(F.count("*").alias("n"), F.percentile("value", 0.95).alias("top"))
    return n.groupBy("user_id").agg(F.round(F.max_by("top", F.struct("n", -F.col("k"))), 6).alias("top"), F.max("n").alias("n"))


@query("geo46_inverse_distance", f"WITH p AS (SELECT p_partkey AS id, {PART_POINT} FROM part), s AS (SELECT s_suppkey AS sid, s_acctbal AS z, {SUPPLIER_POINT} FROM supplier), d AS (SELECT id, z, 1 / greatest((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), 0.01) AS w FROM p JOIN s ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 10000) SELECT id, round(sum(w * z) / sum(w), 4) AS z FROM d GROUP BY id")
def inverse_distance(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("z"), ((F.col("s_suppkey") * 6151) % 1000).cast("double").alias("x"), ((F.col("s_suppkey") * 3571) % 1000).cast("double").alias("y"))
    w = 1 / F.greatest(F.col("d") * F.col("d"), F.lit(0.01))
    return nodes.weighted(points(spark, sf, "part", "p_partkey", PART_POINT), s, 100.0, w, "z").withColumn("z", F.round("z", 4))
