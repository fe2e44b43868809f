"""Joins by membership, integrity reports and validation."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = {
    "products": ["parent_asin", "title", "average_rating", "rating_number", "images"],
    "reviews": ["asin", "parent_asin", "rating", "title", "text", "user_id", "timestamp", "verified_purchase"],
}


def rows_of_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Left semi join: rows whose key is in ``keys``; repeats there change nothing, null matches nothing."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def orphans(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows with a non-null key that ``keys`` doesn't have."""
    return rows.where(F.col(key).isNotNull()).join(keys.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def orphan_summary(rows: DataFrame, keys: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """(n_orphans, examples): their number and the first few distinct keys; made per key first, so hot keys cost little."""
    missing = orphans(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), keys, key)
    few = missing.select(key).orderBy(key).limit(examples).agg(F.array_sort(F.collect_list(key)).alias("examples"))
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_orphans")).crossJoin(F.broadcast(few))


def missing_columns(df: DataFrame, kind: str) -> list[str]:
    """Required columns that are absent; ``ts`` may stand for ``timestamp``."""
    have = set(df.columns) | ({"timestamp"} if "ts" in df.columns else set())
    return [c for c in REQUIRED[kind] if c not in have]


def check_table(spark: SparkSession, path: str, kind: str) -> int:
    """Number of rows of a Parquet table after checks of its path and columns; raises ValueError otherwise.

    Schema and count come from file footers; no column is read.
    """
    if not path.endswith(".parquet"):
        raise ValueError(f"{path}: not a .parquet path")
    if "://" not in path and not Path(path).exists():
        raise ValueError(f"{path}: no such path")
    df = spark.read.parquet(path)
    if gone := missing_columns(df, kind):
        raise ValueError(f"{path}: missing columns {', '.join(gone)}")
    return df.count()


def check_request(query: str | None, top_k: int) -> str:
    """The trimmed query; raises ValueError unless it has 1 to 500 characters and top_k is 1 to 50."""
    text = (query or "").strip()
    if not text or len(query or "") > 500:
        raise ValueError("the query must have 1 to 500 characters")
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be 1 to 50")
    return text
