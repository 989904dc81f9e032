"""Queries of the timestamp problem: p4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebench.operators.timestamps import normalise_timestamps
from sievebench.session import table


def p4_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of production_queries with its instant, null where none can be known."""
    return normalise_timestamps(
        table(spark, folder, "production_queries"), table(spark, folder, "collectors"), keep=["ord", "query_id", "collector_id"]
    ).select("ord", "query_id", "collector_id", "utc_us", F.timestamp_micros("utc_us").alias("utc"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """``ord, utc_us`` of the rows whose text denotes an instant."""
    return normalise_timestamps(
        table(spark, folder, "production_queries"), table(spark, folder, "collectors"), keep=["ord"]
    ).filter(F.col("utc_us").isNotNull())


QUERIES = {"p4_found": p4_found, "p4_normalised": p4_normalised}
SQL: dict[str, str] = {}
