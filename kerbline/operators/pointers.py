"""Lists and rings that are kept as pointers from row to row, followed without gathering any of them in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.store import cut


def followed(pointers: DataFrame) -> DataFrame:
    """id, last, steps, least, ring of pointers (id, next; null at an end). In a list: the last one, how many steps lead there, and
    the least one on the way, itself included. In a ring: its least one; last and steps say nothing there.

    Each round doubles how far a pointer reaches, so rounds grow with the logarithm of the longest list, and only what has come to no
    end takes part. A ring is done when the stretch that follows its least one leads over that one again: all of its rows have then
    seen all of it. Of what has ended, only what is still pointed at is looked up. What leads into a ring ends there."""
    columns = ["id", "next", "last", "least", "steps"]
    first = F.coalesce("next", "id").alias("last"), F.least("id", "next").alias("least"), F.col("next").isNotNull().cast("long").alias("steps")
    now = cut(pointers.select("id", "next", *first))
    open_, ended = now.filter("next IS NOT NULL"), now.filter("next IS NULL")
    lists, rings, into = [ended], [], 0
    while not open_.isEmpty():
        ahead = open_.unionAll(ended).select(
            F.col("id").alias("next"), F.col("next").alias("then"), F.col("last").alias("far"), F.col("least").alias("low"), F.col("steps").alias("more"), F.lit(True).alias("there")
        )
        # The stretch after it leads over itself again, and it is the least of both.
        head = F.coalesce((F.col("low") == F.col("id")) & (F.col("least") >= F.col("id")), F.lit(False))
        after = cut(
            open_.join(ahead, "next", "left").select(
                "id",
                F.col("then").alias("next"),
                F.coalesce("far", "last").alias("last"),
                F.least("least", "low").alias("least"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
                head.alias("head"),
                F.col("there").isNull().alias("out"),
            )
        )
        heads, out = after.agg(F.count_if("head"), F.count_if("out")).first()
        into += out
        on = after.filter("next IS NOT NULL")
        if heads:
            of = after.filter("head").select(F.col("id").alias("least"), F.lit(True).alias("around"))
            on = cut(on.join(of, "least", "left"))
            rings.append(on.filter("around").select("id", "least"))
            on = on.filter("around IS NULL")
        closed = after.filter("next IS NULL").select(*columns)
        lists.append(closed)
        open_ = on.select(*columns)
        ended = cut(ended.unionAll(closed).join(open_.select(F.col("next").alias("id")).distinct(), "id", "left_semi"))
    found = reduce(DataFrame.unionAll, lists).select("id", "last", "steps", "least", F.lit(False).alias("ring"))
    if not rings:
        return found
    around = reduce(DataFrame.unionAll, rings)
    if into:
        entered = around.select(F.col("id").alias("last"), F.col("least").alias("_least"))
        found = found.join(entered, "last", "left").select("id", "last", "steps", F.least("least", "_least").alias("least"), F.col("_least").isNotNull().alias("ring"))
    none = F.lit(None).cast(pointers.schema["id"].dataType)
    return found.unionAll(around.select("id", none.alias("last"), F.lit(None).cast("long").alias("steps"), "least", F.lit(True).alias("ring")))


def reached(pointers: DataFrame, heads: DataFrame) -> DataFrame:
    """id: what can be reached from the heads (id) over pointers (id, next), the heads included. Each round doubles how far it is
    looked ahead; the rounds end when one finds nothing new."""
    jump = pointers.filter("next IS NOT NULL").select("id", "next")
    seen = cut(heads.select("id").distinct())
    n, before = seen.count(), -1
    while n > before:
        seen = cut(seen.unionAll(seen.join(jump, "id").select(F.col("next").alias("id"))).distinct())
        before, n = n, seen.count()
        jump = cut(jump.join(jump.select(F.col("id").alias("next"), F.col("next").alias("then")), "next").select("id", F.col("then").alias("next")))
    return seen
