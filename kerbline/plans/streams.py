"""Streaming forms, each run to the end of what is there (available-now) and read back from its sink."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline.plans.registry import query
from kerbline.plans.sources import place
from kerbline.streaming import feeds


def ran(spark, stream, name, mode="append"):
    """What a stream writes: rows of a Parquet folder, with its checkpoint beside it."""
    path = place(spark, name)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("stream_without_repeats", "SELECT DISTINCT event_id, user_id FROM events")
def without_repeats(spark, sf):
    s = feeds.files(spark, sf, "events.parquet")
    s = s.withColumn("ts", F.col("ts").cast("timestamp")).select(F.explode(F.array(F.struct("event_id", "user_id", "ts"), F.struct("event_id", "user_id", "ts"))).alias("e")).select("e.*")
    return ran(spark, feeds.without_repeats(s, "event_id", "ts", "60 days"), "repeats").select("event_id", "user_id")


@query("stream_windowed_counts", "WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT strftime(day, '%Y-%m-%d') AS day, event_type, CAST(n AS BIGINT) AS n FROM c WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)")
def windowed_counts(spark, sf):
    s = feeds.files(spark, sf, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    c = ran(spark, feeds.counted(s, ["event_type"], "ts", "1 day", "0 seconds"), "counts")
    return c.select(F.date_format("begin", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("stream_registry", "SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS key, md5(event_type || '|' || user_id) AS uid FROM events GROUP BY ALL")
def registry(spark, sf):
    path = place(spark, "registry")
    versions = [spark.createDataFrame([], "kind string, key string, uid string, first_seen long, last_seen long")]

    def write(df, number):
        df.write.mode("overwrite").parquet(f"{path}/{number}")
        versions.append(spark.read.schema(df.schema).parquet(f"{path}/{number}"))

    things = feeds.files(spark, sf, "events.parquet").select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("key"))
    merge = feeds.merge_registry(lambda: versions[-1], write, lambda n: F.lit(n).cast("long"))
    things.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return versions[-1].select("kind", "key", "uid")


@query("stream_periods", """WITH g AS (SELECT *, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000 AS INT) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  p AS (SELECT *, 1 + coalesce(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts), 0) AS period FROM g),
  c AS (SELECT user_id, CAST(period AS BIGINT) AS period, min(ts) AS first, max(ts) AS last FROM p GROUP BY 1, 2)
  SELECT user_id, period, round(epoch(first), 3) AS first, round(epoch(last), 3) AS last FROM c
  WHERE ceil(epoch_us(last) / 1e3) + 43200000 <= (SELECT epoch_ms(max(ts)) FROM events)""")
def periods(spark, sf):
    s = feeds.files(spark, sf, "events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    p = ran(spark, feeds.periods(s, "user_id", "ts", timedelta(hours=12), "0 seconds"), "periods")
    seconds = lambda c: F.round(F.col(c).cast("double"), 3).alias(c)
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("first")).cast("long")
    return p.select("user_id", number.alias("period"), seconds("first"), seconds("last"))
