"""Spatial functions (GEO) on outlines, codecs, and operators at nodes (GRF) over shapes derived from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import outlines as o
from kerbline.functions import shapes as g
from kerbline.operators import graph, nodes, streets
from kerbline.plans.geometry import BOX, lines, rings
from kerbline.plans.joins import PART_BOX, PART_POINT, SUPPLIER_POINT, columns, points
from kerbline.plans.junctions import LINE, SQUARE, network, squares
from kerbline.plans.registry import query, table


def xy(df, *of, **more):
    """id, the rounded places of points, and other named columns."""
    return df.select("id", *[F.round(p[c], 6).alias(f"{c}{k}") for k, p in enumerate(of) for c in ("x", "y")], *[c.alias(n) for n, c in more.items()])


@query("geo02_wkb", f"{BOX} SELECT id, CAST(1 + 4 + 4 + 3 * 16 AS BIGINT) AS n, x1 AS x0, y1 AS y0 FROM b")
def wkb(spark, sf):
    b = lines(spark, sf).select("id", o.wkb(F.col("line")).alias("w"))
    return b.select("id", F.length("w").cast("long").alias("n"), o.from_wkb(F.col("w")).alias("p")).select("id", "n", F.col("p")[2]["x"].alias("x0"), F.col("p")[2]["y"].alias("y0"))


@query("geo06_closed", f"{BOX} SELECT id, CAST(4 AS BIGINT) AS n, (x1 - x0) * (y1 - y0) / 2 AS area FROM b")
def closed(spark, sf):
    r = lines(spark, sf).select("id", o.closed(o.closed(F.col("line"))).alias("r"))
    return r.select("id", F.size("r").cast("long").alias("n"), g.signed_area(F.col("r")).alias("area"))


@query("geo19_simplified", f"{BOX} SELECT id, CAST(CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 5 END AS BIGINT) AS n FROM b JOIN part ON id = p_partkey")
def simplified(spark, sf):
    # The legs of each line bend in their middle, by less or more than the tolerance.
    off = F.when(F.col("id") % 2 == 0, 0.04).otherwise(0.07)
    middle = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    l = F.array(F.col("line")[0], g.point(middle[0], F.col("y0") + off), F.col("line")[1], g.point(F.col("x1") - off, middle[1]), F.col("line")[2])
    return lines(spark, sf).select("id", F.size(o.simplified(l, 0.05)).cast("long").alias("n"))


@query("geo21_tried", f"{BOX} SELECT id, CASE WHEN id % 3 <> 0 THEN x0 END AS x FROM b")
def tried(spark, sf):
    t = rings(spark, sf).select("id", g.wkt(F.col("ring"), "POLYGON").alias("t"))
    t = t.select("id", F.when(F.col("id") % 6 == 0, "none").when(F.col("id") % 3 == 0, F.regexp_replace("t", "0", "o")).otherwise(F.col("t")).alias("t"))
    return t.select("id", o.tried_wkt(F.col("t")).alias("p")).select("id", F.when(F.col("id") % 3 != 0, F.col("p")[0]["x"]).otherwise(F.size("p").cast("double")).alias("x"))


@query("geo25_parallel_line", f"{BOX} SELECT id, x0, y0 + 0.5 AS y0, x1 - 0.5 AS x1, y0 + 0.5 AS y1, x1 - 0.5 AS x2, y1 AS y2 FROM b")
def parallel_line(spark, sf):
    p = lines(spark, sf).select("id", o.parallel(F.col("line"), F.lit(0.5)).alias("p"))
    return xy(p, *[F.col("p")[k] for k in range(3)])


@query("geo35_arrow", f"{BOX} SELECT id, CAST(4 AS BIGINT) AS n, x0 - 3 AS x0, y0 AS y0, x0 AS x1, y0 AS y1, x0 - 0.8 AS x2, y0 + 0.4 AS y2, x0 - 0.95 AS x3, y0 + 1 AS y3 FROM (SELECT id, x0, y0 FROM b)")
def arrow(spark, sf):
    r = rings(spark, sf).select("id", F.col("ring")[0].alias("tip"), o.unit(F.col("ring")[0], F.col("ring")[1]).alias("u"))
    a = r.select("id", o.arrow(F.col("tip"), F.col("u"), 3.0, ("straight", "left")).alias("a"))
    return xy(a, F.col("a")[0][0], F.col("a")[0][1], F.col("a")[2][0], F.col("a")[1][1], n=F.size("a").cast("long"))


@query("geo37_touch_length", f"{BOX} SELECT id, greatest(y1 - y0 - 1, 0) AS d FROM b")
def touch_length(spark, sf):
    # A neighbour to the right, one higher.
    beside = g.rectangle(F.col("x1"), F.col("y0") + 1, F.col("x1") + 2, F.col("y1") + 1)
    return rings(spark, sf).select("id", F.round(o.touch_length(F.col("ring"), beside, 0.05), 6).alias("d"))


TRAPEZE = """p AS (SELECT p_partkey AS id, 4 + p_size % 20 AS w, 3 + p_partkey % 11 AS h, p_partkey % 4 AS c FROM part),
  v AS (SELECT id, unnest([0, w, w - c, 0]) AS x, unnest([0, 0, h, h]) AS y FROM p),
  e AS (SELECT id, unnest([w, -c, c - w, 0]) AS dx, unnest([0, h, 0, -h]) AS dy FROM p),
  r AS (SELECT e.id, dx, dy, (max(x * dx + y * dy) - min(x * dx + y * dy)) * (max(y * dx - x * dy) - min(y * dx - x * dy)) / (dx * dx + dy * dy) AS area FROM e JOIN v USING (id) GROUP BY 1, 2, 3)"""


@query("geo39_rectangularity", f"WITH {TRAPEZE} SELECT id, round((w - c / 2) * h / (SELECT min(area) FROM r WHERE r.id = p.id), 6) AS share FROM p")
def rectangularity(spark, sf):
    k = F.col("p_partkey")
    w, h, c = 4 + F.col("p_size") % 20, 3 + k % 11, k % 4
    zero = F.lit(0)
    ring = F.array(*[g.point(x, y) for x, y in ((zero, zero), (w, zero), (w - c, h), (zero, h), (zero, zero))])
    return table(spark, sf, "part").select(k.alias("id"), F.round(o.rectangularity(ring), 6).alias("share"))


WAYS = f"WITH s AS (SELECT s_suppkey AS unit, {SUPPLIER_POINT} FROM supplier), b AS (SELECT p_partkey AS other, {PART_BOX} FROM part), p AS (SELECT unit, other, x, y, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x0, y0, x1, y1, sqrt(((x0 + x1) / 2 - x) * ((x0 + x1) / 2 - x) + ((y0 + y1) / 2 - y) * ((y0 + y1) / 2 - y)) AS d FROM s JOIN b ON sqrt(((x0 + x1) / 2 - x) * ((x0 + x1) / 2 - x) + ((y0 + y1) / 2 - y) * ((y0 + y1) / 2 - y)) <= 40)"


@query(
    "geo42_front_row",
    f"{WAYS}, t AS (SELECT a.unit, a.other, CASE WHEN a.cx = a.x THEN CASE WHEN a.x > b.x0 AND a.x < b.x1 THEN 0 ELSE 1 END ELSE least((b.x0 - a.x) / (a.cx - a.x), (b.x1 - a.x) / (a.cx - a.x)) END AS xi, CASE WHEN a.cx = a.x THEN CASE WHEN a.x > b.x0 AND a.x < b.x1 THEN 1 ELSE 0 END ELSE greatest((b.x0 - a.x) / (a.cx - a.x), (b.x1 - a.x) / (a.cx - a.x)) END AS xo, CASE WHEN a.cy = a.y THEN CASE WHEN a.y > b.y0 AND a.y < b.y1 THEN 0 ELSE 1 END ELSE least((b.y0 - a.y) / (a.cy - a.y), (b.y1 - a.y) / (a.cy - a.y)) END AS yi, CASE WHEN a.cy = a.y THEN CASE WHEN a.y > b.y0 AND a.y < b.y1 THEN 1 ELSE 0 END ELSE greatest((b.y0 - a.y) / (a.cy - a.y), (b.y1 - a.y) / (a.cy - a.y)) END AS yo FROM p a JOIN p b ON a.unit = b.unit AND b.d < a.d) SELECT unit, other FROM p WHERE (unit, other) NOT IN (SELECT (unit, other) FROM t WHERE greatest(xi, yi, 0) < least(xo, yo, 1))",
)
def front_row(spark, sf):
    s = points(spark, sf, "supplier", "s_suppkey", SUPPLIER_POINT)
    return nodes.front_others(s, points(spark, sf, "part", "p_partkey", PART_BOX), 40.0)


@query("geo43_colours")
def colours(spark, sf):
    return nodes.box_colours(points(spark, sf, "part", "p_partkey", PART_BOX), 16.0)


NEAR = f"p AS (SELECT p_partkey AS id, {PART_POINT} FROM part), s AS (SELECT s_suppkey AS sid, s_acctbal AS z, {SUPPLIER_POINT} FROM supplier)"


def around(spark, sf, radius, weight):
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS z", *columns(SUPPLIER_POINT))
    return nodes.weighted(points(spark, sf, "part", "p_partkey", PART_POINT), s, radius, weight, "z").withColumn("z", F.round("z", 4))


@query("geo45_blended", f"WITH {NEAR}, d AS (SELECT id, z, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS d FROM p JOIN s ON sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) <= 80) SELECT id, round(sum(z / ((d + 2) * (d + 2))) / sum(1 / ((d + 2) * (d + 2))), 4) AS z FROM d GROUP BY id")
def blended(spark, sf):
    return around(spark, sf, 80.0, 1 / ((F.col("d") + 2) * (F.col("d") + 2)))


@query("geo48_bisector", """WITH d AS (SELECT p_partkey AS id, 1 + p_partkey % 7 AS ix, p_partkey % 5 AS iy, p_size % 9 - 2 AS ox, 1 + p_size % 4 AS oy FROM part),
  n AS (SELECT id, ix / sqrt(ix * ix + iy * iy) + ox / sqrt(ox * ox + oy * oy) AS x, iy / sqrt(ix * ix + iy * iy) + oy / sqrt(ox * ox + oy * oy) AS y FROM d)
  SELECT id, round(x / sqrt(x * x + y * y), 6) AS x0, round(y / sqrt(x * x + y * y), 6) AS y0 FROM n""")
def bisector(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    at = g.point(10 + k % 7, k % 5)
    after = g.point(10 + k % 7 + s % 9 - 2, k % 5 + 1 + s % 4)
    return xy(table(spark, sf, "part").select(k.alias("id"), o.bisector(g.point(F.lit(9), F.lit(0)), at, after).alias("n")), F.col("n"))


@query("geo49_kernel", f"WITH {NEAR}, d AS (SELECT id, z, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS d FROM p JOIN s ON sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) <= 90) SELECT id, round(sum(z * exp(-d * d / 1800)) / sum(exp(-d * d / 1800)), 4) AS z FROM d GROUP BY id")
def kernel(spark, sf):
    # A width of 30, cut off at three times that.
    return around(spark, sf, 90.0, F.exp(-F.col("d") * F.col("d") / 1800.0))


@query("geo50_extended", f"{BOX} SELECT id, CAST(4 AS BIGINT) AS n, x1 AS x0, y1 + 150 AS y0 FROM b")
def extended(spark, sf):
    e = lines(spark, sf).select("id", o.extended(F.col("line"), F.lit(150.0)).alias("e"))
    return e.select("id", F.size("e").cast("long").alias("n"), g.end(F.col("e"))["x"].alias("x0"), g.end(F.col("e"))["y"].alias("y0"))


@query("grf02_degree_through", f"WITH s AS (SELECT s_suppkey AS id, {SUPPLIER_POINT} FROM supplier), l AS (SELECT {PART_BOX} FROM part), m AS (SELECT id, CASE WHEN x < x0 + 0.5 OR x > x1 - 0.5 THEN 1 ELSE 2 END AS k FROM s JOIN l ON x >= x0 AND x <= x1 AND y = y0) SELECT s.id, CAST(coalesce(sum(k), 0) AS BIGINT) AS degree FROM s LEFT JOIN m ON s.id = m.id GROUP BY 1")
def degree_through(spark, sf):
    l = rings(spark, sf).select("id", F.slice("ring", 1, 2).alias("line"))
    return nodes.degree_through(points(spark, sf, "supplier", "s_suppkey", SUPPLIER_POINT), l, within=0.5, cell=16.0)


@query("grf12_stream_kinds", "SELECT s_suppkey AS node, CASE s_suppkey % 5 WHEN 0 THEN 'crossing' WHEN 1 THEN 'T' WHEN 2 THEN 'merge' WHEN 3 THEN 'joint' ELSE 'touch' END AS kind FROM supplier")
def stream_kinds(spark, sf):
    # Ends of the five kinds of node; at the last, a two-way road parts into its directions.
    sets = {0: [(0, None), (90, None), (180, None), (270, None)], 1: [(0, None), (90, None), (180, None)], 2: [(0, "in"), (12, "in"), (186, "out")], 3: [(0, None), (180, None)], 4: [(0, "in"), (12, "out"), (186, None)]}
    rows = [(kind, k, float(h), flow) for kind, ends in sets.items() for k, (h, flow) in enumerate(ends)]
    given = spark.createDataFrame(rows, "kind int, edge int, heading double, flow string")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 5).cast("int").alias("kind"))
    return nodes.stream_kinds(s.join(given, "kind").drop("kind"))


#: Edges of the customers' lattice; those of its corner squares are one section each, all others are sections by themselves.
SECTIONS = f"""{LINE}, {SQUARE}, e AS MATERIALIZED (SELECT l.edge, l.source, l.target, coalesce(-sq - 1, l.edge) AS section, sqrt((l.x1 - l.x0) ** 2 + (l.y1 - l.y0) ** 2) AS len
    FROM line l LEFT JOIN square s ON s.edge = l.edge),
  odd AS (SELECT section, node, count(*) % 2 AS odd FROM (SELECT section, source AS node FROM e UNION ALL SELECT section, target FROM e) GROUP BY 1, 2),
  a AS (SELECT section, sum(odd) AS loose, sum(CASE WHEN odd = 1 AND degree >= 3 THEN 1 ELSE 0 END) AS held FROM odd JOIN deg USING (node) GROUP BY 1),
  w AS (SELECT section, sum(len) AS len FROM e GROUP BY 1 HAVING sum(len) < 420)"""


@query("grf13_connectors", f"WITH {SECTIONS} SELECT section, round(len, 6) AS len, CASE WHEN loose = 0 THEN 'ring' ELSE 'connector' END AS kind FROM w JOIN a USING (section) WHERE loose = 0 OR (loose = 2 AND held = 2)")
def connectors(spark, sf):
    edges = network(spark, sf)[1]
    square = (-(F.floor(F.col("i") / 4) + 1000 * F.floor(F.col("j") / 4)) - 1).alias("square")
    of = edges.join(squares(edges).select("edge"), "edge", "left_semi").select("edge", square)
    e = edges.join(of, "edge", "left").select(F.coalesce("square", "edge").alias("section"), "source", "target", F.col("length").alias("len"))
    junctions = graph.degree(edges).filter("degree >= 3").select("node")
    return nodes.connectors(e, junctions, 420.0).withColumn("len", F.round("len", 6))


@query("grf14_shape_clusters", f"WITH RECURSIVE b AS (SELECT p_partkey AS id, {PART_BOX} FROM part), l AS (SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1), r(id, seen) AS (SELECT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen) SELECT id, min(seen) AS cluster FROM r GROUP BY 1")
def shape_clusters(spark, sf):
    return nodes.shape_clusters(points(spark, sf, "part", "p_partkey", PART_BOX), 16.0)


@query("geo23_merged_lines", "SELECT p_partkey AS edge, p_partkey - p_partkey % 10 AS chain, CAST(p_partkey % 10 AS BIGINT) AS k, p_partkey % 3 <> 1 AS forward FROM part")
def merged_lines(spark, sf):
    # A line through every ten parts, some of its edges drawn the other way.
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    begin, end = k, F.when((k + 1) % 10 == 0, -k).otherwise(k + 1)
    turned = k % 3 == 1
    return graph.chains(p.select(k.alias("edge"), F.when(turned, end).otherwise(begin).alias("source"), F.when(turned, begin).otherwise(end).alias("target")))


@query("grf22_divided_pairs", f"WITH s AS (SELECT p_partkey % 300 AS run, p_partkey % 5 AS name, row_number() OVER (PARTITION BY p_partkey % 300 ORDER BY p_partkey) AS k, {PART_POINT} FROM part), n AS (SELECT run, count(*) AS n FROM s GROUP BY 1), h AS (SELECT a.run, b.run AS other, count(DISTINCT a.k) AS held FROM s a JOIN s b ON a.run <> b.run AND a.name = b.name AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 90 GROUP BY 1, 2), g AS (SELECT h.run, other FROM h JOIN n ON h.run = n.run WHERE held >= 0.3 * n) SELECT x.run AS one, x.other AS two FROM g x JOIN g y ON x.run = y.other AND x.other = y.run WHERE x.run < x.other")
def divided_pairs(spark, sf):
    s = table(spark, sf, "part").selectExpr("p_partkey % 300 AS run", "p_partkey % 5 AS name", *columns(PART_POINT))
    return streets.divided_pairs(s, within=90.0, share=0.3)


@query("grf24_followed", "WITH RECURSIVE l AS (SELECT s_suppkey AS lane, s_suppkey + 1 AS next FROM supplier UNION ALL SELECT s_suppkey, s_suppkey + 2 FROM supplier WHERE s_suppkey % 9 = 4), o AS (SELECT lane, min(next) AS next FROM l WHERE lane % 7 <> 0 GROUP BY 1 HAVING count(*) = 1), w(start, here, hops) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION ALL SELECT start, next, hops + 1 FROM w JOIN o ON o.lane = w.here WHERE hops < 20) SELECT start, arg_max(here, hops) AS reached FROM w GROUP BY 1")
def followed(spark, sf):
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    links = s.select(k.alias("lane"), (k + 1).alias("next")).unionAll(s.filter("s_suppkey % 9 = 4").select(k, k + 2))
    return streets.followed(s.select(k.alias("lane"), (k % 7 == 0).alias("junction")), links)


@query("grf05_junction_clusters")
def junction_clusters(spark, sf):
    return nodes.junction_clusters(points(spark, sf, "supplier", "s_suppkey", SUPPLIER_POINT).unionAll(points(spark, sf, "part", "p_partkey", PART_POINT).selectExpr("id + 10000000", "x", "y")), reach=15.0, widest=30.0)
