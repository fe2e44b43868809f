"""Queries p2 and p4 over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.references import dangling
from ..operators.skew import heavy_keys, per_key_stats
from ..sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Products that hold at least 4% of all review rows."""
    return heavy_keys(table(spark, folder, "reviews").select("parent_asin"), "parent_asin", 0.04).select("parent_asin")


def p2_product_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Row count and rating figures of every product, each review counted once per review_id."""
    once = table(spark, folder, "reviews").select("review_id", "parent_asin", "rating").distinct()
    return per_key_stats(once, "parent_asin", F.col("rating")).drop("is_heavy").withColumn("sum_value", F.round("sum_value", 6))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Dangling references of reviews and vector_index per table, month and reason."""
    reviews = table(spark, folder, "reviews").select(F.lit("reviews").alias("src_table"), F.col("review_id").cast("string").alias("row_key"), F.col("parent_asin").alias("key"), F.try_multiply(F.col("ts"), F.lit(1000)).alias("at_us"))
    index = table(spark, folder, "vector_index").select(F.lit("vector_index").alias("src_table"), F.col("id").alias("row_key"), F.col("id").alias("key"), F.unix_micros("indexed_at").alias("at_us"))
    parents = table(spark, folder, "metadata").select(F.col("parent_asin").alias("key"), F.unix_micros("first_seen").alias("first_us"))
    gone = table(spark, folder, "delisted").select(F.col("parent_asin").alias("key"), F.unix_micros("delisted_at").alias("gone_us"))
    return dangling(reviews.unionByName(index), parents, gone)


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Number of dangling rows per table, month and reason."""
    return p4_found(spark, folder).groupBy("src_table", "period", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p2_found": p2_found, "p2_product_stats": p2_product_stats, "p4_found": p4_found, "p4_report": p4_report}

_P4 = """
WITH refs AS (
  SELECT DISTINCT 'reviews' AS src_table, CAST(review_id AS VARCHAR) AS row_key, parent_asin AS k, ts * 1000 AS at_us
  FROM reviews WHERE parent_asin IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'vector_index', id, id, epoch_us(indexed_at) FROM vector_index WHERE id IS NOT NULL),
first AS (SELECT parent_asin AS k, min(epoch_us(first_seen)) AS f FROM metadata WHERE parent_asin IS NOT NULL GROUP BY 1),
gone AS (SELECT parent_asin AS k, min(epoch_us(delisted_at)) AS g FROM delisted WHERE parent_asin IS NOT NULL GROUP BY 1),
judged AS (
  SELECT refs.src_table, refs.row_key,
    CASE WHEN at_us IS NULL THEN 'unknown' ELSE strftime(make_timestamp(at_us), '%Y-%m') END AS period,
    CASE WHEN first.k IS NULL THEN 'missing' WHEN at_us < f THEN 'late' WHEN at_us >= g THEN 'deleted' END AS reason
  FROM refs LEFT JOIN first USING (k) LEFT JOIN gone USING (k))
"""

ORACLE = {
    "p2_found": """
SELECT parent_asin FROM reviews WHERE parent_asin IS NOT NULL
GROUP BY parent_asin HAVING count(*) >= 0.04 * (SELECT count(*) FROM reviews)""",
    "p2_product_stats": """
SELECT parent_asin, count(*) AS n_rows, count(rating) AS n_values, round(sum(rating), 6) AS sum_value, min(rating) AS min_value, max(rating) AS max_value
FROM (SELECT DISTINCT review_id, parent_asin, rating FROM reviews) GROUP BY parent_asin""",
    "p4_found": _P4 + "SELECT DISTINCT src_table, period, row_key, reason FROM judged WHERE reason IS NOT NULL",
    "p4_report": _P4 + "SELECT src_table, period, reason, count(*) AS n FROM (SELECT DISTINCT * FROM judged WHERE reason IS NOT NULL) GROUP BY ALL",
}
