"""Constraint queries: each check is a DataFrame of violations (item); the suite counts them and keeps examples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Violations named in a result row.
EXAMPLES = 50


@dataclass
class Check:
    id: str
    text: str
    violations: DataFrame
    hard: bool = True


def where(df: DataFrame, item: str, broken: Column) -> DataFrame:
    return df.filter(F.coalesce(broken, F.lit(False))).select(F.col(item).cast("string").alias("item"))


def missing(df: DataFrame, item: str, key: str, of: DataFrame, of_key: str) -> DataFrame:
    """Rows whose key is not in another table."""
    return df.join(of.select(F.col(of_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti").select(F.col(item).cast("string").alias("item"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).cast("string").alias("item"))


def suite(checks: list[Check]) -> DataFrame:
    """id, text, n, status (PASS, FAIL for a broken hard check, INFO), examples. Each check's violations are read twice: counted, and for their
    least items; store them first where they are dear."""
    out = None
    for c in checks:
        first = F.slice(F.array_sort(F.collect_set("item")), 1, EXAMPLES)
        # Examples are the least items; only they are gathered.
        least = c.violations.select("item").distinct().orderBy("item").limit(EXAMPLES).agg(F.array_join(first, ",").alias("examples"))
        n = c.violations.agg(F.count("*").alias("n"))
        status = F.when(F.col("n") == 0, "PASS").when(F.lit(c.hard), "FAIL").otherwise("INFO")
        row = n.crossJoin(F.broadcast(least)).select(F.lit(c.id).alias("id"), F.lit(c.text).alias("text"), "n", status.alias("status"), "examples")
        out = row if out is None else out.unionByName(row)
    return out


def failed(results: DataFrame) -> bool:
    return not results.filter("status = 'FAIL'").isEmpty()
