"""What the corpus operators share: shared-folder tables, word patterns, fold columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators import store

#: A word of the corpus contracts, as a Java pattern: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that driver and executors share."""
    return f"{store.shared_dir(spark).rstrip('/')}/kerbline/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def commonest(counts: DataFrame, count: str, most: int) -> DataFrame:
    """Rows with the highest counts, at most so many: all above a level that a histogram over powers of the eighth root of two
    gives. The histogram has some hundred rows at any size, and nothing is sorted."""
    step = F.floor(F.log2(count) * 8)
    rows = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min(count).alias("least")).orderBy(F.desc("step")).collect()
    level, taken = None, 0
    for r in rows:
        taken += r["n"]
        if taken > most:
            break
        level = r["least"]
    return counts.filter(F.col(count) >= level) if level is not None else counts.limit(0)


def hash_sample(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """About nine tenths of `most` rows, chosen by a hash of their id, and never more than `most`; all rows of a smaller table.
    No row but the chosen ones is moved."""
    n = df.count()
    if n <= most:
        return df
    span = 1 << 40
    return df.filter(F.pmod(F.xxhash64(id_col), F.lit(span)) < int(span * 0.9 * most / n)).orderBy(F.xxhash64(id_col), F.xxhash64(*df.columns)).limit(most)


def bounded(rows: DataFrame, id_col: str, most_chars: int) -> DataFrame:
    """Rows (id_col, text, ...) of a sample of some thousands, in the order of a hash of id and text as long as their texts hold no more
    than `most_chars` characters in all; copies of a row are one. Only hashes and lengths come to the driver."""
    key = F.xxhash64(id_col, "text")
    told = stored(rows.distinct())
    total, level = 0, None
    for h, n in sorted((r["h"], r["n"]) for r in told.select(key.alias("h"), F.coalesce(F.length("text"), F.lit(0)).alias("n")).collect()):
        total += n
        if total > most_chars:
            return told.filter(key <= level) if level is not None else told.limit(0)
        level = h
    return told
