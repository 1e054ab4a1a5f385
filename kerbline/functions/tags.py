"""Reading numbers, levels and classes out of tag texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def integer(text: Column) -> Column:
    """A text as a whole number, halves away from zero; null where it is none."""
    return F.round(text.try_cast("double")).cast("long")


def leading_number(text: Column) -> Column:
    """The number at the start of a text, such as 12.5 of '12.5 m'."""
    return F.nullif(F.regexp_extract(text, r"^\s*([0-9]+(?:[.][0-9]+)?)", 1), F.lit("")).cast("double")


def first_integer(text: Column) -> Column:
    """The first integer of a list such as '2;3', with U+2212 read as a minus sign."""
    return F.nullif(F.regexp_extract(F.replace(text, F.lit("−"), F.lit("-")), r"-?[0-9]+", 0), F.lit("")).cast("int")


def metres(text: Column) -> Column:
    """A length in metres: the first number of the text, which is in feet unless (m) stands in the text."""
    number = F.nullif(F.regexp_extract(text, r"([0-9]+(?:[.][0-9]+)?)", 1), F.lit("")).cast("double")
    return F.when(F.contains(text, F.lit("(m)")), number).otherwise(number * 0.3048)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def building_span(levels: Column, underground: Column, lowest: Column, height: Column, is_underground: Column) -> Column:
    """(low, high) levels of a building: its floors above its lowest level, or from its height at three metres a floor; below ground if it lies there."""
    deep = F.struct((-F.coalesce(levels, underground, F.lit(1))).alias("low"), F.lit(-1).cast("long").alias("high"))
    base = F.coalesce(lowest, F.lit(0))
    floors = F.coalesce(levels, F.round(height / 3).cast("long"), F.lit(1))
    usual = F.struct((base - F.coalesce(underground, F.lit(0))).alias("low"), (floors - 1 + base).alias("high"))
    return F.when(is_underground, deep).otherwise(usual)


def road_level(layer: Column, bridge: Column, tunnel: Column) -> Column:
    """The layer tag, else 1 for a bridge, -1 for a tunnel, 0 for others."""
    no = lambda c: F.coalesce(c, F.lit("no")) == "no"
    return F.coalesce(integer(layer).cast("int"), F.when(~no(bridge), 1).when(~no(tunnel), -1).otherwise(0))


def vocabulary(value: Column, groups: dict[str, list[str]], otherwise: str) -> Column:
    """The group that lists a value."""
    out = F.when(F.lit(False), otherwise)
    for name, values in groups.items():
        out = out.when(value.isin(values), name)
    return out.otherwise(otherwise)
