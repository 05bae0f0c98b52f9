"""Catalogue of the driver's queries: one entry per operator, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexivec.plans import flow_queries, retrieval_queries, stats_queries, study_queries, text_queries

_PARTS = (retrieval_queries, text_queries, stats_queries, flow_queries, study_queries)
QUERIES = {k: f for m in _PARTS for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _PARTS for k, s in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of the stated queries over all chunks."""
    return retrieval_queries.hybrid_search(spark, sf_dir)
