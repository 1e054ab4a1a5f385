"""Writing typed tables, shapes with their measures, JSON documents and check rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.functions import shapes as g


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema, cast; those that are missing are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def measured(df: DataFrame, ring: str) -> DataFrame:
    """Adds __len, __area, __x, __y and the box of a ring, for readers without spatial functions."""
    r = F.col(ring)
    d = df.withColumns({"__len": g.length(r), "__area": g.signed_area(r), "__c": g.centroid(r), "__b": g.box(r)})
    return d.select("*", F.col("__c.x").alias("__x"), F.col("__c.y").alias("__y"), F.col("__b.x0").alias("__w"), F.col("__b.y0").alias("__s"), F.col("__b.x1").alias("__e"), F.col("__b.y1").alias("__n")).drop("__c", "__b")


def documents(df: DataFrame, path: str) -> None:
    """One JSON document per row, as text files."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def replace(df: DataFrame, path: str) -> None:
    """A table as it is after this run, in place of that of the run before."""
    df.write.mode("overwrite").parquet(path)


def described(df: DataFrame, path: str, about: dict[str, str]) -> None:
    """A Parquet table whose schema carries key-value metadata (versions, reference system) in its first column's field."""
    first = df.columns[0]
    df.withMetadata(first, {"about": about}).write.mode("overwrite").parquet(path)


def about(df: DataFrame) -> dict[str, str]:
    """The metadata that described() gave a table read from its files."""
    return df.schema.fields[0].metadata.get("about", {})


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """The table as it is now, stored; readers of the result do not see later changes of the source."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cross_sections(strips: DataFrame, section: str) -> DataFrame:
    """section, value: the strips (t: offset from the left, kind, width) of each section as a JSON document, left to right; neighbours
    of one kind are one strip."""
    strip = F.array_sort(F.collect_list(F.struct("t", "kind", "width")))

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["kind"].alias("kind"), (last["width"] + s["width"]).alias("width"))))
        return F.when(last["kind"] == s["kind"], joined).otherwise(F.concat(done, F.array(F.struct(s["kind"].alias("kind"), s["width"].alias("width")))))

    none = F.array().cast("array<struct<kind: string, width: double>>")
    whole = strips.select(section, "t", F.col("kind").cast("string").alias("kind"), F.col("width").cast("double").alias("width")).groupBy(section).agg(strip.alias("_s"))
    return whole.select(section, F.to_json(F.struct(F.aggregate("_s", none, step).alias("strips"))).alias("value"))
