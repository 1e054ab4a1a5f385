"""Profiles of tables: facets, samples, tag inventories, votes and medians. Counts are partial before any shuffle; a value list is cut per key after counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values up to which a text column is a choice.
CHOICES = 40


def mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The commonest value of each group; of equally common ones the least."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counted.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), value)).alias("_m")).select(*by, f"_m.{value}")


def upper_median(value: str) -> Column:
    """The middle value of numbers, of an even number the upper one; a group is held as its different values with their counts."""
    return -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{value}`)")


def top_values(value: str, order: list[Column], k: int) -> Column:
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    return F.transform(F.slice(F.array_sort(F.collect_list(F.struct(*keys, F.col(value).alias("v")))), 1, k), lambda s: s["v"])


def profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, kind, value, n, low, high: least and greatest of a number; every value of a choice with its count; text for others."""
    numeric = [f for f in fields if isinstance(df.schema[f].dataType, T.NumericType)]
    rest = [f for f in fields if f not in numeric]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in rest])
    counted = df.select(F.inline(pairs)).filter("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field")
    ranked = counted.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "value"))).filter(F.col("k") <= CHOICES + 1)
    sized = ranked.withColumn("of", F.max("k").over(w))
    none = F.lit(None).cast("double")
    choice = sized.filter(F.col("of") <= CHOICES).select("field", F.lit("choice").alias("kind"), "value", "n", none.alias("low"), none.alias("high"))
    text = sized.filter((F.col("of") > CHOICES) & (F.col("k") == 1)).select("field", F.lit("text").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("n"), none.alias("low"), none.alias("high"))
    ends = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in numeric for n, f in (("low", F.min), ("high", F.max))])
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.lit("number").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("n"), F.col(f"low_{c}").alias("low"), F.col(f"high_{c}").alias("high")) for c in numeric])
    out = choice.unionByName(text)
    return out.unionByName(ends.select(F.inline(each))) if numeric else out


def value_samples(df: DataFrame, fields: list[str], most: int = 31) -> DataFrame:
    """field, samples (its first values, sorted), n (rows of the table)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    values = df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("c"))
    # Each task passes on its first values only; all are counted apart.
    ranked = values.withColumn("k", F.row_number().over(Window.partitionBy("field").orderBy("value"))).filter(F.col("k") <= most)
    first = ranked.groupBy("field").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("samples"))
    return first.join(values.groupBy("field").agg(F.sum("c").alias("n")), "field").select("field", "samples", "n")


def tag_inventory(tagged: DataFrame, k: int) -> DataFrame:
    """key, n, kept, top: how often each key occurs, in how many kept rows, and its k commonest values. tagged: tags (map), kept."""
    c = tagged.select(F.explode("tags"), "kept").groupBy("key", "value").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))
    # As above: a key with very many values is no single task.
    first = c.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "value"))).filter(F.col("k") <= k)
    top = F.array_sort(F.collect_list(F.struct("k", "value")))
    named = first.groupBy("key").agg(F.array_join(F.transform(top, lambda s: s["value"]), ",").alias("top"))
    return c.groupBy("key").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept")).join(named, "key").select("key", "n", "kept", "top")


def peak_hour(df: DataFrame, by: str, at: str) -> DataFrame:
    """Events per hour of the day: the most, its hour (the earliest of equals), and all."""
    h = df.groupBy(by, F.hour(at).cast("long").alias("h")).agg(F.count("*").alias("n"))
    return h.groupBy(by).agg(F.max("n").alias("peak"), F.max_by("h", F.struct("n", -F.col("h"))).alias("peak_hour"), F.sum("n").alias("departures"))
