"""The registered queries of the engine's own operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engram.plans import ablation_queries, consolidation_queries, delivery_queries, governance_queries, graph_queries, iterative_queries, lifecycle_queries, representation_queries, retrieval_queries

_PARTS = (retrieval_queries, graph_queries, governance_queries, consolidation_queries, lifecycle_queries, iterative_queries, delivery_queries, ablation_queries, representation_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid recall."""
    return retrieval_queries.hybrid_rrf(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in _PARTS for name, text in part.SQL.items()}
