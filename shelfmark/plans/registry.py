"""All queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.plans import catalogue, messages, retrieval, views
from shelfmark.plans.base import Query

_PARTS = (retrieval.query, catalogue.query, messages.query, views.query)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: dense and BM25 legs for every passage, fused by reciprocal ranks."""
    return retrieval.hybrid_rrf(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for part in _PARTS for name, query in part.found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.sql.items()}
