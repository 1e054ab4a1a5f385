"""Benchmark decontamination over the Wu-Manber search: digests per document, and the clean documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm import wu_manber

_P = "__wm_"
#: A document is contaminated if hit words are at least one in this many.
SHARE = 20


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document; see wu_manber for the defined cases."""
    found = wu_manber.find(docs.select("doc_id", "text"), benchmark, _P)
    n_hit, n = F.size(f"{_P}hits").cast("long"), F.col(f"{_P}n_words")
    ids = F.array_join(F.sort_array(F.transform(f"{_P}items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", n.alias("n_words"), n_hit.alias("n_hit"), F.size(f"{_P}items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), _contaminated(n_hit, n).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    found = wu_manber.find(docs, benchmark, _P)
    return found.filter(~_contaminated(F.size(f"{_P}hits").cast("long"), F.col(f"{_P}n_words"))).select(*docs.columns)
