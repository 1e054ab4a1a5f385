"""Ground by runs of cells (GEO14, GEO31, PIP23): the orders' boxes as ground, the suppliers' as buildings in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import raster
from kerbline.plans.pipeline import PRICED
from kerbline.plans.registry import query, table

SIZE, RADIUS = 0.25, 2.5
GROUND = f"""{PRICED}, w AS (SELECT DISTINCT CAST(ceil(x0 / {SIZE} - 0.5) AS BIGINT) AS a0, CAST(ceil(x1 / {SIZE} - 0.5) AS BIGINT) AS a1,
    CAST(ceil(y0 / {SIZE} - 0.5) AS BIGINT) AS b0, CAST(ceil(y1 / {SIZE} - 0.5) AS BIGINT) AS b1 FROM b),
  column_ AS (SELECT unnest(range(a0, a1)) AS i, b0, b1 FROM w), cell AS MATERIALIZED (SELECT DISTINCT i, unnest(range(b0, b1)) AS j FROM column_),
  disc AS (SELECT dx, dy FROM range(-3, 4) a(dx), range(-3, 4) c(dy) WHERE dx * dx + dy * dy <= {RADIUS * RADIUS}),
  kept AS MATERIALIZED (SELECT c.i, c.j FROM cell c, disc JOIN cell n ON n.i = c.i + dx AND n.j = c.j + dy GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM disc))"""


def boxes(spark, sf):
    o, x, y = table(spark, sf, "orders"), F.col("o_orderkey") % 701 / 7.0, F.col("o_custkey") % 997 / 11.0
    return o.select(x.alias("x0"), y.alias("y0"), (x + F.col("o_totalprice") / 3e5).alias("x1"), (y + 0.3 + F.col("o_custkey") % 13 / 10.0).alias("y1"))


def counted(found):
    """Cells by column."""
    return found.groupBy("i").agg(F.sum(F.col("j1") - F.col("j0") + 1).alias("n"))


@query("geo14_dilated", f"WITH {GROUND} SELECT i, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT i + dx AS i, j + dy AS j FROM cell, disc) GROUP BY 1")
def dilated(spark, sf):
    return counted(raster.dilated(raster.runs(boxes(spark, sf), SIZE), RADIUS))


@query("geo31_eroded", f"WITH {GROUND} SELECT i, CAST(count(*) AS BIGINT) AS n FROM kept GROUP BY 1")
def eroded(spark, sf):
    return counted(raster.eroded(raster.runs(boxes(spark, sf), SIZE), RADIUS))


@query("geo31_opened", f"WITH {GROUND} SELECT i, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT i + dx AS i, j + dy AS j FROM kept, disc) GROUP BY 1")
def opened(spark, sf):
    return counted(raster.opened(raster.runs(boxes(spark, sf), SIZE), RADIUS))


@query("pip23_plazas")
def plazas(spark, sf):
    """Tested against cells one by one on small ground."""
    s = table(spark, sf, "supplier")
    x, y = F.col("s_suppkey") * 13 % 1000 / 10.0, F.col("s_suppkey") * 71 % 900 / 10.0
    houses = raster.runs(s.select(x.alias("x0"), y.alias("y0"), (x + 6).alias("x1"), (y + 5).alias("y1")), SIZE)
    built = raster.subtracted(raster.runs(boxes(spark, sf), SIZE), houses)
    return raster.plazas(built, houses, RADIUS, 30, 0.1)
