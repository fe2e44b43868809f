"""Readers, validation and small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one Parquet table of a folder; Catalyst prunes columns and pushes filters down."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_ms(col):
    """Epoch milliseconds of a timestamp column."""
    return F.unix_millis(col)
