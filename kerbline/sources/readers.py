"""Reading feature collections, timetables in archives, XML networks and tables by box; clipping a set of tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "struct<features: array<struct<id: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>>"


def feature_collections(spark: SparkSession, path: str) -> DataFrame:
    """id, properties, kind, coordinates (JSON text) of every feature; one file holds one collection."""
    text = spark.read.text(path, wholetext=True)
    f = text.select(F.explode(F.from_json("value", FEATURES)["features"]).alias("f"))
    return f.select("f.id", "f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def archived_csv(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """Columns, as text, of a CSV file with a header inside zip archives; a column that a file lacks is null. Archives are read side by side."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    for part in pd.read_csv(f, dtype=str, keep_default_na=False, na_values=[""], encoding="utf-8-sig", chunksize=50_000):
                        part = part.reindex(columns=columns).astype(object)
                        yield part.where(part.notna(), None)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(read, ", ".join(f"`{c}` string" for c in columns))


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def in_box(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rows with x and y in the box: plain comparisons, which reach the Parquet row groups' statistics."""
    return df.filter((F.col("x") >= x0) & (F.col("x") <= x1) & (F.col("y") >= y0) & (F.col("y") <= y1))


def clipped(tables: dict[str, DataFrame], first: str, keep: DataFrame, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """The tables cut to what hangs together with `keep`, the rows kept of the first; links (table, key, parent, parent key) in order."""
    out = dict(tables) | {first: keep}
    for name, key, parent, parent_key in links:
        out[name] = out[name].join(out[parent].select(F.col(parent_key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_semi")
    return out


def correction_documents(spark: SparkSession, path: str) -> DataFrame:
    """key, field, value, note of JSON lines {"key": ..., "note": ..., "set": {field: value}}."""
    read = spark.read.schema("key long, note string, set map<string, string>").json(path)
    return read.select("key", F.explode("set").alias("field", "value"), "note")


def members(df: DataFrame, group: str, of: str) -> DataFrame:
    """group, k, member: one row for each member of the groups' lists, in their order; empty lists have none."""
    return df.select(group, F.posexplode(of).alias("k", "member"))


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """name, bytes, modified of every file that a build reads; listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
