"""Ordered series: moving medians, runs and their smoothing, change points, numbering without a single sorting task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.store import cut


def moving_median(value: str, by: list[str], order: list[str], k: int) -> Column:
    """Median of a row with the k rows before and after it."""
    return F.percentile(value, 0.5).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-k, k))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A global number from 1 in the given order: ranges are sorted side by side, and each is shifted by the sizes of those before."""
    # Written down: ranges that were drawn again after a loss would number some rows twice.
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    # The range is in the upper bits of that id, the place in it in the lower 33.
    part, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition.
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return ranged.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, own + 1 + F.col("_start")).drop("_part", "_start", "_at")


def summed(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The sum of a whole number over all rows before each in the given order, ranges side by side as in `numbered`."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.sum(value).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.coalesce(own, F.lit(0)) + F.col("_start")).drop("_part", "_start")


def _run(by: list[str], order: list[str], category: str) -> tuple[Column, Column]:
    w = Window.partitionBy(*by).orderBy(*order)
    changed = (~F.col(category).eqNullSafe(F.lag(category).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    return changed, w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_runs(df: DataFrame, by: list[str], order: list[str], category: str) -> DataFrame:
    changed, w = _run(by, order, category)
    return df.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w)).drop("_changed")


def runs(df: DataFrame, by: list[str], order: list[str], category: str) -> DataFrame:
    """One row per stretch of one category: its number, category and length."""
    return with_runs(df, by, order, category).groupBy(*by, "run").agg(F.first(category).alias(category), F.count("*").alias("n"))


def smoothed(df: DataFrame, by: list[str], order: list[str], category: str, least: int) -> DataFrame:
    """Adds smoothed: the category, or in runs shorter than `least` that of the last long run before."""
    r = with_runs(df, by, order, category).withColumn("_n", F.count("*").over(Window.partitionBy(*by, "run")))
    w = Window.partitionBy(*by).orderBy("run").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kept = F.last(F.when(F.col("_n") >= least, F.col(category)), ignorenulls=True).over(w)
    return r.withColumn("smoothed", F.coalesce(kept, category)).drop("_n")


def change_points(df: DataFrame, key: str, order: list[str], value: str, step: float, ahead: int) -> DataFrame:
    """key, at (position of the change), level: where the median of the next values leaves the level kept since the last change by
    more than the step. Medians are a window's; the level is reset at each change, which no window can express, so it is carried
    along the sorted rows of a partition, batch by batch: memory holds one batch, however long a series is."""
    w = Window.partitionBy(key).orderBy(*order)
    medians = df.select(key, *order, (F.row_number().over(w) - 1).cast("long").alias("at"), F.percentile(value, 0.5).over(w.rowsBetween(0, ahead - 1)).alias("median"))
    ready = medians.sortWithinPartitions(key, "at").select(key, "at", "median")
    kind = df.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, level = None, None
        for batch in batches:
            changes, levels = [], []
            keys = batch.column(0).to_pylist()
            for i, (k, median) in enumerate(zip(keys, batch.column(2).to_pylist(), strict=True)):
                if (k,) != now:
                    now, level = (k,), None
                if median is None:
                    continue
                if level is None:
                    level = median
                elif abs(median - level) > step:
                    changes.append(i)
                    levels.append(median)
                    level = median
            some = pa.array(changes, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(levels, pa.float64())], names=[key, "at", "level"])

    return ready.mapInArrow(walk, f"{key} {kind}, at long, level double")


def suffixed(df: DataFrame, name: str, order: list[str], mark: str) -> DataFrame:
    """Adds id: the name, and name + mark + 2, 3 ... for further rows of one name."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("id", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(mark), n.cast("string"))))


def top(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k per group before the shuffle."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")
