"""All queries of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.plans import aggregates, alignments, api, blocks, checks, geometry, graph, joins, junctions, lanes, matching, network, outlines, pipeline, projections, rasters, registry, scalars, sections, sources, streams, windows  # noqa: F401  each registers its queries


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: classes of the parts."""
    return registry.QUERIES["prj02_first_rule"](spark, sf_dir)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
