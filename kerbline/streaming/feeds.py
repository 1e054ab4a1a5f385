"""Incremental forms: observations without repeats, counts in event time, registry merges by batch, periods of presence as state."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators import matching


def files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the Parquet files of one name in a folder; the schema is that of what is there."""
    return spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder)


def without_repeats(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each key once within the lateness that is waited for; state for older ones is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def counted(stream: DataFrame, by: list[str], at: str, width: str, late: str) -> DataFrame:
    """Events per window of event time, closed when the watermark has passed it."""
    g = stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("begin"), *by, "n")


def merge_registry(read, write, now):
    """For foreachBatch: merges the batch's things (kind, key) into the registry. `read` gives the registry as it is, `write` puts a
    new version beside it; a batch that is repeated changes nothing, as ids follow from kind and key."""

    def merge(batch: DataFrame, number: int) -> None:
        write(matching.register(read(), batch.select("kind", "key").distinct(), now(number)), number)

    return merge


def periods(stream: DataFrame, key: str, at: str, gap: timedelta, late: str) -> DataFrame:
    """key, first, last: an object's times of presence; a pause of more than the gap begins a new one. A period is given once, when
    the watermark shows that nothing can join it any more, and its state ends then. Rows later than the lateness that is waited for
    are left out; rows in time that come out of order join the periods they lie in or beside, and may join two into one. Rows
    without a time are left out; those without a key are the periods of one that is null."""
    width = f"{gap // timedelta(microseconds=1)} microseconds"
    g = stream.withWatermark(at, late).groupBy(key, F.session_window(at, width)).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    return g.select(key, "first", "last")
