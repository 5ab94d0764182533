"""All queries of the library, one or more per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark import registry
from quillspark.plans import gateway, layout, relational, search, sources, text, trace, workflows  # noqa: F401


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.agg2_session_summary(spark, sf_dir)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
