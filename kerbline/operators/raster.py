"""Ground as runs of grid cells along columns: wider, narrower and opened by a disc, its parts, and what their outline runs along.

A run is what one column holds without a gap, so rows grow with outlines and not with ground. A disc of radius r reaches
floor(sqrt(r^2 - d^2)) cells up and down in the column d away: ground grows by each column's runs, stretched so, in its neighbours,
and shrinks by each column's gaps likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators import graph, series
from kerbline.operators.store import cut

#: Beyond all cells.
_FAR = 1 << 40


def _first(low: Column, size: float) -> Column:
    """The first cell whose centre isn't before a coordinate."""
    return F.ceil(low / size - 0.5)


def merged(intervals: DataFrame) -> DataFrame:
    """i, j0, j1 (both included): per column the runs that intervals make together; those that touch are one."""
    by = Window.partitionBy("i").orderBy("j0", "j1")
    before = F.max("j1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("j0") > before + 1), 1).otherwise(0)
    run = F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = intervals.distinct().withColumn("_fresh", fresh).withColumn("_run", run)
    return numbered.groupBy("i", "_run").agg(F.min("j0").alias("j0"), F.max("j1").alias("j1")).select("i", "j0", "j1")


def runs(boxes: DataFrame, size: float) -> DataFrame:
    """Runs of the cells whose centre lies in one of the boxes (x0, y0, x1, y1), lower borders included, upper ones not."""
    of = boxes.select(*[_first(F.col(c), size).alias(c) for c in ("x0", "x1", "y0", "y1")]).filter("x1 > x0 AND y1 > y0")
    return merged(of.select(F.explode(F.sequence("x0", F.col("x1") - 1)).alias("i"), F.col("y0").alias("j0"), (F.col("y1") - 1).alias("j1")))


def _reaches(r: float) -> Column:
    """d and h for each column that a disc around column 0 reaches."""
    most = int(r)
    return F.array(*[F.struct(F.lit(d).alias("d"), F.lit(int((r * r - d * d) ** 0.5)).alias("h")) for d in range(-most, most + 1)])


def dilated(ground: DataFrame, r: float) -> DataFrame:
    """All cells within r cells of the ground."""
    spread = ground.select("i", "j0", "j1", F.inline(_reaches(r)))
    return merged(spread.select((F.col("i") + F.col("d")).alias("i"), (F.col("j0") - F.col("h")).alias("j0"), (F.col("j1") + F.col("h")).alias("j1")))


def _gaps(columns: DataFrame) -> DataFrame:
    """What runs leave free of their columns, without end above and below."""
    by = Window.partitionBy("i").orderBy("j0")
    below = F.coalesce(F.lag("j1").over(by) + 1, F.lit(-_FAR))
    last = F.lead("j0").over(by).isNull()
    gap = F.struct(below.alias("j0"), (F.col("j0") - 1).alias("j1"))
    end = F.when(last, F.struct((F.col("j1") + 1).alias("j0"), F.lit(_FAR).alias("j1")))
    pairs = columns.select("i", gap.alias("gap"), end.alias("end"))
    return pairs.select("i", F.explode(F.array_compact(F.array("gap", "end"))).alias("g")).select("i", "g.j0", "g.j1").filter("j1 >= j0")


def eroded(ground: DataFrame, r: float) -> DataFrame:
    """The cells of the ground all of whose neighbours within r cells are ground."""
    ground = cut(ground)
    held = ground.select("i").distinct()
    reach = F.explode(_reaches(r)).alias("o")
    spread = _gaps(ground).select("i", "j0", "j1", F.inline(_reaches(r)))
    taken = spread.select((F.col("i") + F.col("d")).alias("i"), (F.col("j0") - F.col("h")).alias("j0"), (F.col("j1") + F.col("h")).alias("j1"))
    # A column without ground takes all that it reaches.
    empty = held.select("i", reach).select((F.col("i") + F.col("o.d")).alias("i")).distinct().join(held, "i", "left_anti")
    bare = empty.select("i", reach).select((F.col("i") + F.col("o.d")).alias("i"), F.lit(-_FAR).alias("j0"), F.lit(_FAR).alias("j1"))
    gone = merged(taken.unionAll(bare).join(held, "i", "left_semi").select("i", F.greatest("j0", F.lit(-_FAR)).alias("j0"), F.least("j1", F.lit(_FAR)).alias("j1")))
    return _gaps(gone).filter(f"j0 > -{_FAR} AND j1 < {_FAR}")


def subtracted(ground: DataFrame, other: DataFrame) -> DataFrame:
    """The cells of the ground that the other runs don't hold: in a column, what is neither a gap of the ground nor of the other."""
    ground = cut(ground)
    held = ground.select("i").distinct()
    gone = merged(_gaps(ground).unionAll(other.join(held, "i", "left_semi").select("i", "j0", "j1")))
    return _gaps(gone).filter(f"j0 > -{_FAR} AND j1 < {_FAR}")


def opened(ground: DataFrame, r: float) -> DataFrame:
    """The ground where a disc of radius r fits in: what is left of it after shrinking and growing again."""
    return dilated(eroded(ground, r), r)


def parts(ground: DataFrame) -> DataFrame:
    """part, i, j0, j1: runs by the connected part they belong to; cells hang together by their sides. Parts are called by the number
    of their first run, in order of columns."""
    numbered = cut(series.numbered(ground.select("i", "j0", "j1"), ["i", "j0", "j1"], "run"))
    right = numbered.select((F.col("i") - 1).alias("i"), F.col("j0").alias("k0"), F.col("j1").alias("k1"), F.col("run").alias("b"))
    met = numbered.join(right, "i").filter("j0 <= k1 AND k0 <= j1").select(F.col("run").alias("a"), "b")
    root = graph.components(met).withColumnRenamed("node", "run")
    return numbered.join(root, "run", "left").select(F.coalesce("root", "run").alias("part"), "i", "j0", "j1")


def _shared(a: DataFrame, b: DataFrame, step: int) -> DataFrame:
    """part, n: cells of a's runs that lie beside b's, in the column one step on."""
    other = b.select((F.col("i") - step).alias("i"), F.col("j0").alias("k0"), F.col("j1").alias("k1"))
    both = a.join(other, "i").filter("j0 <= k1 AND k0 <= j1")
    return both.select("part", (F.least("j1", "k1") - F.greatest("j0", "k0") + 1).alias("n"))


def outlines(found: DataFrame, beside: DataFrame) -> DataFrame:
    """part, cells, outline, along: size of each part (part, i, j0, j1), sides of its cells that are its outline, and how many of
    those lie at cells of other ground (runs i, j0, j1 that share no cell with it)."""
    found = cut(found)
    size = found.groupBy("part").agg(F.sum(F.col("j1") - F.col("j0") + 1).alias("cells"), F.count("*").alias("n"))
    inner = _shared(found, found, 1).groupBy("part").agg(F.sum("n").alias("inner"))

    def tips(df: DataFrame, low: Column, high: Column, *keep: str) -> DataFrame:
        """A cell and a side for both ends of a run."""
        both = F.array(F.struct(low.alias("j"), F.lit("low").alias("side")), F.struct(high.alias("j"), F.lit("high").alias("side")))
        return df.select(*keep, "i", F.inline(both))

    # What lies just above a run begins a run of the other ground with its lower end, and the other way round.
    own = tips(found, F.col("j1") + 1, F.col("j0") - 1, "part")
    stacked = own.join(tips(beside, F.col("j0"), F.col("j1")), ["i", "j", "side"]).select("part", F.lit(1).cast("long").alias("n"))
    along = _shared(found, beside, 1).unionAll(_shared(found, beside, -1)).unionAll(stacked).groupBy("part").agg(F.sum("n").alias("along"))
    both = size.join(inner, "part", "left").join(along, "part", "left")
    outline = 2 * F.col("n") + 2 * F.col("cells") - 2 * F.coalesce("inner", F.lit(0))
    return both.select("part", "cells", outline.alias("outline"), F.coalesce("along", F.lit(0)).alias("along"))


def plazas(ground: DataFrame, buildings: DataFrame, r: float, least_cells: int, built: float) -> DataFrame:
    """part, cells, outline, along: the open parts of the ground where a disc of radius r fits in that are large enough and framed:
    at least the share `built` of their outline runs along buildings."""
    made = outlines(parts(opened(ground, r)), buildings)
    return made.filter((F.col("cells") >= least_cells) & (F.col("along") >= built * F.col("outline")))
