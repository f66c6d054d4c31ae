"""Registered queries for the library's own operators, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import data, models

QUERIES = {**data.QUERIES, **models.QUERIES}
SQL = {**data.SQLS, **models.SQLS}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Score the pool, pick the next rows to label, put the user's labels in, evaluate."""
    return QUERIES["classification_metrics"](spark, d)
