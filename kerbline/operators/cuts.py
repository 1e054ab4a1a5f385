"""Sections cut where something changes along them, with least lengths, and what each of their ranges is like.

Positions of many sources lie on one axis per section. Everything is told from places in one order over all sections, so a section
with very many positions is no single task: the first position at or after a probe has the number of positions before it plus one,
and the ranges that positions lie in follow likewise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators import series
from kerbline.operators.pointers import reached
from kerbline.operators.store import cut


def all_changes(samples: DataFrame, differs: dict[str, Column]) -> DataFrame:
    """section, s, kind: where a sample (section, s, ...) differs from the one before it in its section, for each kind by its own
    condition; these compare columns with those before them, named before_<column>. Ties at one position are taken in the order of the
    other columns. The samples are put in order once, whatever the number of kinds."""
    rest = [c for c in samples.columns if c not in ("section", "s")]
    placed = series.numbered(samples, ["section", "s", *rest], "place")
    before = placed.select((F.col("place") + 1).alias("place"), F.col("section").alias("before_section"), *[F.col(c).alias(f"before_{c}") for c in ["s", *rest]])
    both = placed.join(before, "place").filter(F.col("section").eqNullSafe(F.col("before_section")))
    kinds = F.array_compact(F.array(*[F.when(condition, F.lit(kind)) for kind, condition in differs.items()]))
    return both.select("section", "s", F.explode(kinds).alias("kind"))


def changes(samples: DataFrame, differs: Column, kind: str) -> DataFrame:
    """The changes of one kind."""
    return all_changes(samples, {kind: differs})


def _after(positions: DataFrame, probes: DataFrame, at_or_after: bool) -> DataFrame:
    """The probes (id, section, s) with place: the number of the first position (section, s, place from 1 over all sections) at or
    after them, or of the last one at or before them; it may lie in another section."""
    # A probe stands before the positions that equal it where the next one is asked for, and after them where the last one is.
    both = positions.select("section", "s", F.lit(0).alias("side"), F.lit(None).cast("long").alias("id"), F.lit(1).cast("long").alias("n"))
    asked = probes.select("section", "s", F.lit(-1 if at_or_after else 1).alias("side"), "id", F.lit(0).cast("long").alias("n"))
    placed = series.summed(both.unionAll(asked), ["section", "s", "side", "id"], "n", "before").filter("side <> 0")
    return placed.select("id", (F.col("before") + (1 if at_or_after else 0)).alias("place"))


def kept_cuts(sections: DataFrame, cuts: DataFrame, least: float, priority: list[str]) -> DataFrame:
    """section, s, kind: cuts (section, s, kind) of sections (section, length) from the beginning on, each at least so far from the
    one before it and from both ends; of kinds at one position the first by priority."""
    rank = F.array_position(F.lit(priority), F.col("kind"))
    inside = cuts.join(sections, "section").filter((F.col("s") >= least) & (F.col("s") + least <= F.col("length")))
    at = inside.groupBy("section", "s").agg(F.min(F.struct(rank.alias("rank"), "kind")).alias("k"))
    placed = cut(series.numbered(at.select("section", "s", F.col("k.kind").alias("kind")), ["section", "s"], "place"))
    probes = placed.select(F.col("place").alias("id"), "section", (F.col("s") + least).alias("s"))
    ahead = _after(placed, probes, True).join(placed.select("place", F.col("section").alias("there")), "place")
    pointers = ahead.join(placed.select(F.col("place").alias("id"), "section"), "id").filter(F.col("section") == F.col("there"))
    heads = placed.groupBy("section").agg(F.min("place").alias("id"))
    chosen = reached(cut(pointers.select("id", F.col("place").alias("next"))), heads)
    return placed.join(chosen.withColumnRenamed("id", "place"), "place", "left_semi").select("section", "s", "kind")


def ranges(sections: DataFrame, kept: DataFrame) -> DataFrame:
    """section, k, s0, s1, starts_at: the ranges that the cuts make of every section, from 0 to its length, numbered from 1."""
    begins = sections.select("section", F.lit(0.0).alias("s"), F.lit("section end").alias("kind"), "length")
    all_ = begins.unionByName(kept.join(sections, "section").select("section", "s", "kind", "length"))
    placed = cut(series.numbered(all_, ["section", "s"], "place"))
    first = placed.groupBy("section").agg(F.min("place").alias("first"))
    next_ = placed.select((F.col("place") - 1).alias("place"), F.col("section").alias("there"), F.col("s").alias("then"))
    both = placed.join(next_, "place", "left").join(first, "section")
    end = F.when(F.col("there") == F.col("section"), F.col("then")).otherwise(F.col("length"))
    return both.select("section", (F.col("place") - F.col("first") + 1).alias("k"), F.col("s").alias("s0"), end.alias("s1"), F.col("kind").alias("starts_at"))


def described(found: DataFrame, samples: DataFrame, values: list[str]) -> DataFrame:
    """The ranges with the upper median of each value of the samples (section, s, values) in them, both ends included; null where
    fewer than half of the samples have a value."""
    placed = cut(series.numbered(found.select("section", "k", F.col("s0").alias("s")), ["section", "s"], "place"))
    rows = cut(samples.select("section", "s", *values).withColumn("id", F.monotonically_increasing_id()))
    within = _after(placed, rows, False).join(rows.withColumnRenamed("section", "own"), "id").join(placed.withColumnRenamed("s", "s0"), "place")
    within = within.filter(F.col("own") == F.col("section"))
    # A sample at a cut ends the range before it, too.
    ks = F.when((F.col("s") == F.col("s0")) & (F.col("k") > 1), F.array("k", F.col("k") - 1)).otherwise(F.array("k"))
    at = within.select("section", F.explode(ks).alias("k"), *values)
    median = lambda v: F.when(F.count(v) * 2 >= F.count("*"), -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{v}`)"))
    return found.join(at.groupBy("section", "k").agg(*[median(v).alias(v) for v in values]), ["section", "k"], "left")


def united(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)
