"""Queries of this subpackage over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .leakage import cut_passages, leaks, remove_leaks
from .neardup import near_duplicates
from .pii import personal_information, redact
from .products import product_pairs, same_product
from .spans import shared_amount, shared_spans
from .tokens import decode, encode
from .topn import top_n


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of listings of the same product."""
    return product_pairs(same_product(table(spark, folder, "metadata")))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every listing, named by its least key, and the number of keys in the class."""
    told = same_product(table(spark, folder, "metadata"))
    classes = told.groupBy("product").agg(F.min("parent_asin").alias("class"), F.count(F.lit(1)).alias("n_listings"))
    return told.join(classes, "product").select("parent_asin", "class", "n_listings")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of reviews whose words are similar to 0.7 and more."""
    return near_duplicates(table(spark, folder, "reviews"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Personal information in review texts."""
    found = personal_information(table(spark, folder, "reviews").where("review_id is not null"))
    return found.select("review_id", "pii_kind", "pii_text").distinct()


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Review texts with placeholders, where something was replaced."""
    reviews = table(spark, folder, "reviews").where("review_id is not null").select("review_id", "text")
    done = redact(reviews).where("redacted rlike '\\\\[(EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME)\\\\]'")
    return done.distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Three leading reviews of every product."""
    reviews = table(spark, folder, "reviews").where("parent_asin is not null and review_id is not null")
    return top_n(reviews, "parent_asin", ["helpful_vote", "rating"], "review_id", 3)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, folder, "documents"))


def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose decoded ids differ from their text: none."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    back = decode(encode(docs)).withColumnRenamed("text", "decoded")
    return docs.na.fill("", ["text"]).join(back, "doc_id", "left").where("decoded is null or decoded <> text").select("doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that share a passage of twelve words with an evaluation item."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the documents that stay when every leaking one is removed."""
    docs = table(spark, folder, "documents")
    return remove_leaks(docs.select("doc_id"), leaks(docs, table(spark, folder, "eval_items")))


def p8_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that lose words when shared passages are cut out, and how many words."""
    return cut_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items")).where("words_cut > 0").select("doc_id", "words_cut")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of 300 characters and more that another document holds too."""
    return shared_spans(table(spark, folder, "documents"))


def p9_amount(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of every document, and how many of them stand elsewhere."""
    docs = table(spark, folder, "documents")
    return shared_amount(docs, shared_spans(docs))


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p3_found": p3_found, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_found": p6_found, "p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip, "p8_found": p8_found, "p8_clean": p8_clean, "p8_cut": p8_cut, "p9_found": p9_found, "p9_amount": p9_amount}

_P8 = """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
d AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda j: array_to_string(w[j:j + 11], ' '))) AS g FROM dw WHERE len(w) >= 12),
i AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda j: array_to_string(w[j:j + 11], ' '))) AS g FROM iw WHERE len(w) >= 12)
"""

ORACLE = {
    "p6_found": """
SELECT parent_asin, place, review_id FROM (
  SELECT parent_asin, review_id, row_number() OVER (PARTITION BY parent_asin ORDER BY helpful_vote DESC NULLS LAST, rating DESC NULLS LAST, review_id) AS place
  FROM (SELECT DISTINCT review_id, parent_asin, rating, helpful_vote FROM reviews WHERE parent_asin IS NOT NULL))
WHERE place <= 3""",
    "p7_roundtrip": "SELECT doc_id FROM documents WHERE doc_id IS NULL AND doc_id IS NOT NULL",
    "p8_found": _P8 + "SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)",
    "p8_cut": """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
d AS (SELECT doc_id, j, array_to_string(w[j:j + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS j FROM dw WHERE len(w) >= 12)),
i AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 10), lambda j: array_to_string(w[j:j + 11], ' '))) AS g FROM iw WHERE len(w) >= 12)
SELECT doc_id, count(DISTINCT p) AS words_cut FROM (SELECT doc_id, unnest(range(j, j + 12)) AS p FROM d WHERE g IN (SELECT g FROM i)) GROUP BY doc_id""",
    "p8_clean": _P8 + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d JOIN i USING (g))",
}
