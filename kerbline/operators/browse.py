"""Reading the model: children of a node, search over layers, features with totals, schemas, levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def children(nodes: DataFrame, below: DataFrame, parent: object) -> DataFrame:
    """id, label, n_children of the nodes (id, label, parent) under a parent; below: parent of each node one rank down."""
    own = nodes.filter(F.col("parent") == F.lit(parent)).select("id", "label")
    n = below.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    return own.join(n, "id", "left").select("id", "label", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def features(points: DataFrame, most: int) -> DataFrame:
    """The first rows by id as GeoJSON points, each with the total over all rows."""
    number = lambda c: F.col(c).cast("string")
    shape = F.concat(F.lit('{"type":"Point","coordinates":['), number("x"), F.lit(","), number("y"), F.lit("]}"))
    first = points.orderBy("id").limit(most).withColumn("geometry", shape)
    return first.crossJoin(F.broadcast(points.agg(F.count("*").alias("total"))))  # one row


def search(layers: dict[str, tuple[DataFrame, str, list[str]]], text: str, per_layer: int) -> DataFrame:
    """layer, id of rows of which the id or a search column holds the text, whatever its case."""
    found = []
    for name, (df, key, fields) in layers.items():
        hit = reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False)) for c in [key, *fields]])
        found.append(df.filter(hit).select(F.lit(name).alias("layer"), F.col(key).cast("string").alias("id")))
    w = Window.partitionBy("layer").orderBy("id")
    return reduce(DataFrame.unionByName, found).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_layer).drop("_n")


def schema(tables: dict[str, DataFrame]) -> DataFrame:
    """relation, field, type, n: what a reader may query, with row counts."""
    out = []
    for name, df in tables.items():
        fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(kind).alias("type")) for f, kind in df.dtypes])
        out.append(df.agg(F.count("*").cast("int").alias("n")).select(F.lit(name).alias("relation"), F.inline(fields), "n").select("relation", "field", "type", "n"))
    return reduce(DataFrame.unionByName, out)


def levels(spans: DataFrame) -> DataFrame:
    """Every level that some span (low, high) touches."""
    steps = F.when(F.col("low") <= F.col("high"), F.sequence("low", "high")).otherwise(F.array().cast("array<bigint>"))
    return spans.select(F.explode(steps).alias("level")).distinct()
