"""All queries of the library by name, with the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.plans import library_queries, library_sql, reading_queries, relational_queries, relational_sql, text_queries

QUERIES = text_queries.QUERIES | relational_queries.QUERIES | library_queries.QUERIES | reading_queries.QUERIES
ORACLE_SQL = text_queries.ORACLE_SQL | relational_sql.ORACLE_SQL | library_sql.ORACLE_SQL | reading_queries.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval with guaranteed places."""
    return relational_queries.hybrid_guaranteed_slots(spark, sf_dir)
