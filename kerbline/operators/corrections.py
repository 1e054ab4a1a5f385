"""Corrections by hand to tables of tags, with their provenance, and what follows from corrected lane tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corrected(df: DataFrame, key: str, fields: list[str], corrections: DataFrame) -> DataFrame:
    """The table with fields replaced where corrections (key, field, value as text, note) say so; corrected_fields and note tell what
    was. Several corrections of one field: the greatest value counts. A value that does not fit the field's type leaves the field."""
    own = corrections.filter(F.col("field").isin(fields)).groupBy("key", "field").agg(F.max("value").alias("value"), F.max("note").alias("note"))
    by = own.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_new"), F.array_sort(F.collect_list("field")).alias("_of"), F.max("note").alias("_note"))
    kinds = {f.name: f.dataType for f in df.schema}
    j = df.join(by.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left")
    new = {f: F.coalesce(F.get(F.array(F.try_element_at("_new", F.lit(f))), F.lit(0)).try_cast(kinds[f]), F.col(f)) for f in fields}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns], F.coalesce("_of", F.array().cast("array<string>")).alias("corrected_fields"), F.col("_note").alias("note"))


def per_direction(lanes: Column, forward: Column, backward: Column, oneway: Column) -> tuple[Column, Column]:
    """Lanes along a way and against it: all along a one-way road; else as told, else halves, the odd lane along."""
    half = F.floor(lanes / 2)
    return F.when(oneway, lanes).otherwise(F.coalesce(forward, lanes - half)).cast("long"), F.when(oneway, F.lit(0)).otherwise(F.coalesce(backward, half)).cast("long")


def doubled(overrides: DataFrame, ways: DataFrame) -> DataFrame:
    """key, lanes: overrides (key, per_direction) of ways (key, oneway); a two-way road has the number each way."""
    return overrides.join(ways.select("key", "oneway"), "key").select("key", (F.col("per_direction") * F.when(F.col("oneway"), 1).otherwise(2)).cast("long").alias("lanes"))
