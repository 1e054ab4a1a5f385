"""Vertical alignments (MTH05, MTH06, STP26): a customer's orders in time are the stations of a profile, 10 days to a metre, their prices
the heights."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import alignments
from kerbline.plans.registry import query, table

TOLERANCE = 2.0
SAMPLES = """sample AS MATERIALIZED (SELECT id, s, z, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY id) AS n
  FROM (SELECT o_custkey AS id, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 10.0::DOUBLE AS s, avg(CAST(o_totalprice AS DOUBLE) / 20000) AS z FROM orders GROUP BY 1, 2))"""
# Hops from the first sample over grades that hold all samples between their ends, then back by the earliest.
KNOTS = f"""{SAMPLES}, grade AS MATERIALIZED (SELECT a.id, a.i AS a, b.i AS b FROM sample a JOIN sample b ON a.id = b.id AND a.i < b.i LEFT JOIN sample c ON c.id = a.id AND c.i > a.i AND c.i < b.i
    GROUP BY ALL HAVING coalesce(max(abs(a.z + (b.z - a.z) * (c.s - a.s) / (b.s - a.s) - c.z)), 0) <= {TOLERANCE}),
  hop(id, i, n) AS (SELECT id, i, 0 FROM sample WHERE i = 0 UNION SELECT h.id, g.b, h.n + 1 FROM hop h JOIN grade g ON g.id = h.id AND g.a = h.i),
  near AS MATERIALIZED (SELECT id, i, min(n) AS hops FROM hop GROUP BY 1, 2),
  came AS MATERIALIZED (SELECT g.id, g.b AS i, min(g.a) AS before FROM grade g JOIN near x ON x.id = g.id AND x.i = g.a JOIN near y ON y.id = g.id AND y.i = g.b WHERE x.hops + 1 = y.hops GROUP BY 1, 2),
  knot(id, i) AS (SELECT id, i FROM sample WHERE i = n - 1 UNION ALL SELECT k.id, c.before FROM knot k JOIN came c USING (id, i))"""


def profiles(spark, sf):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), (days / 10.0).alias("s"), (F.col("o_totalprice").cast("double") / 20000).alias("z"), "o_orderpriority")


@query("mth05_grade_points", f"WITH RECURSIVE {KNOTS} SELECT id, round(s, 9) AS s, round(z, 9) AS z FROM knot JOIN sample USING (id, i)")
def grade_points(spark, sf):
    p = alignments.gathered(profiles(spark, sf), "id")
    return p.select("id", F.explode(alignments.fewest_knots(F.col("samples"), TOLERANCE)).alias("k")).select("id", F.round("k.s", 9).alias("s"), F.round("k.z", 9).alias("z"))


@query("stp26_fitted_profiles", f"""WITH RECURSIVE {KNOTS}, grid AS (SELECT *, lag(s) OVER w AS s0, lag(z) OVER w AS z0, lead(s) OVER w AS s1, lead(z) OVER w AS z1 FROM knot JOIN sample USING (id, i) WINDOW w AS (PARTITION BY id ORDER BY i)),
  curve AS MATERIALIZED (SELECT *, CASE WHEN s0 IS NOT NULL AND s1 IS NOT NULL THEN least(80, 0.9 * least(s - s0, s1 - s)) ELSE 0 END AS len, (z1 - z) / (s1 - s) - (z - z0) / (s - s0) AS bend FROM grid),
  straight AS (SELECT p.id, p.s, p.z, coalesce(k.z + (k.z1 - k.z) * (p.s - k.s) / (k.s1 - k.s), p.z) AS y FROM sample p ASOF JOIN curve k ON p.id = k.id AND p.s >= k.s),
  off AS (SELECT t.id, abs(any_value(y) + coalesce(sum(bend * (len / 2 - abs(t.s - k.s)) ** 2 / (2 * len)) FILTER (len > 0 AND abs(t.s - k.s) < len / 2), 0) - any_value(t.z)) AS e FROM straight t JOIN curve k ON k.id = t.id GROUP BY t.id, t.s)
  SELECT id, (SELECT count(*) FROM knot WHERE knot.id = off.id) AS knots, round(sqrt(avg(e * e)), 6) AS rms, round(max(e), 6) AS worst FROM off GROUP BY 1""")
def fitted_profiles(spark, sf):
    f = alignments.fitted(alignments.gathered(profiles(spark, sf), "id"), TOLERANCE)
    return f.select("id", F.size("knots").cast("long").alias("knots"), F.round("rms", 6).alias("rms"), F.round("worst", 6).alias("worst"))


@query("mth06_smoothed")
def smoothed(spark, sf):
    """Low priority must pass under 2 m, high above 4.5 m, urgent has no height of its own; tested against all sets of active bounds."""
    p = profiles(spark, sf)
    of = lambda kind, then: F.when(F.col("o_orderpriority").startswith(kind), then)
    wish = F.when(~F.col("o_orderpriority").startswith("1"), F.col("z"))
    at = p.select("id", "s", wish.alias("wish"), F.coalesce(of("2", F.lit(4.5)), F.lit(0.0)).alias("low"), F.coalesce(of("5", F.lit(2.0)), F.lit(20.0)).alias("high"))
    return alignments.smoothed(at, "id", grade=0.08, weight=1e-4).select("id", F.round("s", 6).alias("s"), F.round("z", 6).alias("z"))
