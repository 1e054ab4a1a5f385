"""Faces and blocks (GEO26, STP10) of a plane network derived from the customers: customer k stands near column k % 40 and row
k / 40 of a lattice, moved by up to 24 of 100; edges lead to the right, up and aslant, each kept or not by the customer's data."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import faces
from kerbline.plans.registry import query, table

CELL = 100.0
W = 40
NETWORK = f"""node AS (SELECT c_custkey AS node, c_custkey % {W} * 100 + (c_custkey * 37 + c_nationkey * 11) % 25 AS x,
    c_custkey // {W} * 100 + (c_custkey * 53 + c_nationkey * 7) % 25 AS y FROM customer),
  edge AS (SELECT 3 * c_custkey + k AS edge, c_custkey AS source, c_custkey + CASE k WHEN 0 THEN 1 WHEN 1 THEN {W} ELSE {W + 1} END AS target,
    CASE k WHEN 0 THEN c_custkey // {W} WHEN 1 THEN 1000 + c_custkey % {W} // 3 ELSE 2000 END AS street
    FROM customer, (VALUES (0), (1), (2)) AS t(k) WHERE CASE k WHEN 0 THEN (c_nationkey + c_custkey) % 5 >= 2 AND c_custkey % {W} < {W - 1}
    WHEN 1 THEN (c_nationkey * 3 + c_custkey) % 7 >= 3 ELSE c_mktsegment = 'BUILDING' AND c_custkey % {W} < {W - 1} END)"""
RINGS = f"""{NETWORK},
  e AS MATERIALIZED (SELECT e.*, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM edge e JOIN node a ON a.node = source JOIN node b ON b.node = target),
  half AS MATERIALIZED (SELECT 2 * edge AS h, source AS n, x0, y0, x1, y1, street FROM e UNION ALL SELECT 2 * edge + 1, target, x1, y1, x0, y0, street FROM e),
  around AS (SELECT h, coalesce(lag(h) OVER w, last_value(h) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before
    FROM half WINDOW w AS (PARTITION BY n ORDER BY atan2(y1 - y0, x1 - x0))),
  ahead AS MATERIALIZED (SELECT xor(h, 1) AS h, before AS next FROM around),
  walk(s, here) AS (SELECT h, h FROM half UNION ALL SELECT s, next FROM walk JOIN ahead ON h = here WHERE next > s),
  ring AS MATERIALIZED (SELECT s AS ring, here AS h FROM walk WHERE s IN (SELECT s FROM walk JOIN ahead ON h = here WHERE next = s)),
  shape AS MATERIALIZED (SELECT ring, count(*) AS sides, sum(x0 * y1 - x1 * y0) / 2 AS area, sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) AS perimeter
    FROM ring JOIN half USING (h) GROUP BY 1)"""
HOLES = f"""{RINGS},
  eye AS (SELECT ring, min({{'x': x0, 'y': y0}}) AS p FROM ring JOIN half USING (h) JOIN shape USING (ring) WHERE area <= 0 GROUP BY 1),
  seen AS (SELECT e.ring, r.ring AS next, x0 + (x1 - x0) / (y1 - y0) * (p.y - y0) AS here, (x1 - x0) / (y1 - y0) AS slope
    FROM eye e JOIN half d ON d.y0 > p.y AND d.y1 <= p.y JOIN ring r ON r.h = d.h WHERE x0 + (x1 - x0) / (y1 - y0) * (p.y - y0) < p.x),
  beside AS MATERIALIZED (SELECT ring, arg_max(next, (here, slope)) AS next FROM seen GROUP BY 1),
  up(ring, here) AS (SELECT ring, next FROM beside UNION ALL SELECT u.ring, b.next FROM up u JOIN beside b ON b.ring = u.here),
  within AS (SELECT u.ring, here AS face FROM up u JOIN shape s ON s.ring = here WHERE s.area > 0),
  face AS (SELECT f.ring AS face, f.sides + coalesce(sum(h.sides), 0) AS sides, f.area + coalesce(sum(h.area), 0) AS area,
    f.perimeter + coalesce(sum(h.perimeter), 0) AS perimeter, count(h.ring) AS holes
    FROM shape f LEFT JOIN within w ON w.face = f.ring LEFT JOIN shape h ON h.ring = w.ring WHERE f.area > 0 GROUP BY f.ring, f.sides, f.area, f.perimeter)"""


def lattice(spark, sf):
    """Nodes (node, x, y, nation) and edges (edge, source, target, street), of which some lead to a node that isn't there."""
    c, k, n = table(spark, sf, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    column, row = k % W, F.floor(k / W)
    nodes = c.select(k.alias("node"), (column * 100 + (k * 37 + n * 11) % 25).cast("double").alias("x"), (row * 100 + (k * 53 + n * 7) % 25).cast("double").alias("y"), n.alias("nation"))
    inside = column < W - 1

    def kind(number, step, street, kept):
        return F.struct((3 * k + number).alias("edge"), (k + step).alias("target"), street.cast("long").alias("street"), kept.alias("kept"))

    all_ = F.array(
        kind(0, 1, row, ((n + k) % 5 >= 2) & inside),
        kind(1, W, 1000 + F.floor(column / 3), (n * 3 + k) % 7 >= 3),
        kind(2, W + 1, F.lit(2000), (F.col("c_mktsegment") == "BUILDING") & inside),
    )
    return nodes, c.select(k.alias("source"), F.inline(all_)).filter("kept").drop("kept")


def ringed(spark, sf):
    nodes, edges = lattice(spark, sf)
    return faces.rings(faces.half_edges(edges, nodes, "street"))


@query("geo26_rings", f"WITH RECURSIVE {RINGS} SELECT ring, CAST(sides AS BIGINT) AS sides, CAST(area AS DOUBLE) AS area, round(perimeter, 6) AS perimeter FROM shape")
def face_rings(spark, sf):
    return faces.outlines(ringed(spark, sf)).select("ring", "sides", "area", F.round("perimeter", 6).alias("perimeter"))


@query("geo26_faces", f"WITH RECURSIVE {HOLES} SELECT face, CAST(sides AS BIGINT) AS sides, CAST(area AS DOUBLE) AS area, round(perimeter, 6) AS perimeter, CAST(holes AS BIGINT) AS holes FROM face")
def faces_with_holes(spark, sf):
    return faces.faces(ringed(spark, sf), CELL).select("face", "sides", "area", F.round("perimeter", 6).alias("perimeter"), "holes")


@query("stp10_blocks", f"WITH RECURSIVE {HOLES} SELECT face, CAST(area AS DOUBLE) AS area, round(2 * area / perimeter, 6) AS width FROM face WHERE area >= 4000 AND 2 * area / perimeter >= 32")
def blocks(spark, sf):
    found = faces.blocks(faces.faces(ringed(spark, sf), CELL), 4000.0, 32.0)
    return found.select("face", "area", F.round("width", 6).alias("width"))


SIDES = f"""{RINGS}, own AS (SELECT r.ring, r.h, a.next, street, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS d FROM ring r JOIN half USING (h) JOIN ahead a ON a.h = r.h JOIN shape s ON s.ring = r.ring AND area > 0),
  link AS MATERIALIZED (SELECT o.*, CASE WHEN o.street = t.street THEN t.h END AS on_ FROM own o JOIN own t ON t.h = o.next),
  go(h, here, n) AS (SELECT h, h, 0 FROM link UNION ALL SELECT g.h, l.on_, n + 1 FROM go g JOIN link l ON l.h = g.here WHERE l.on_ IS NOT NULL AND l.on_ <> g.h),
  side AS (SELECT g.h, coalesce(max(CASE WHEN l.on_ IS NULL THEN g.here END), min(g.here)) AS side FROM go g JOIN link l ON l.h = g.here GROUP BY 1)"""


@query("stp10_sides", f"WITH RECURSIVE {SIDES} SELECT ring AS face, side, street, CAST(count(*) AS BIGINT) AS edges, round(sum(d), 6) AS length FROM link JOIN side USING (h) GROUP BY 1, 2, 3")
def block_sides(spark, sf):
    return faces.sides(ringed(spark, sf), "street").withColumn("length", F.round("length", 6))
