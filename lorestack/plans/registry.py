"""The registered queries of the reference's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorestack.plans import job_queries, markup_queries, table_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**text_queries.QUERIES, **table_queries.QUERIES, **markup_queries.QUERIES, **job_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**text_queries.ORACLE_SQL, **table_queries.ORACLE_SQL, **markup_queries.ORACLE_SQL, **job_queries.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of all conversations, from chunked and embedded documents, history and recalled turns."""
    return QUERIES["r14_assemble_prompts"](spark, sf_dir)
