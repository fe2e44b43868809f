"""Review analysis: scored, selected per product and rating bucket, summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import reviews as R
from ..session import spread

#: No product keeps more reviews than this per bucket, whatever its count.
MOST = 3


def scored(reviews: DataFrame) -> DataFrame:
    """(review_id, parent_asin, rating, score, bucket, sentiment), each review once, without its text.

    The text is read for the score and left behind before anything is shuffled.
    """
    ts = F.col("ts") if "ts" in reviews.columns else F.unix_millis("timestamp")
    used = ["review_id", "parent_asin", "rating", "text", "helpful_vote", "verified_purchase", "ts" if "ts" in reviews.columns else "timestamp"]
    return spread(reviews.where("review_id is not null").select(*used)).select(
        "review_id",
        "parent_asin",
        "rating",
        F.round(R.score(F.col("text"), F.col("helpful_vote"), F.col("verified_purchase"), ts), 6).alias("score"),
        R.rating_bucket(F.col("rating")).alias("bucket"),
        R.rating_sentiment(F.col("rating")).alias("sentiment"),
    ).distinct()


def counts(rows: DataFrame) -> DataFrame:
    """(parent_asin, n_rated, keep): rated reviews of each product and how many it keeps per bucket."""
    return rows.where("parent_asin is not null").groupBy("parent_asin").agg(F.count("rating").alias("n_rated")).withColumn("keep", R.keep_per_bucket(F.col("n_rated")).cast("int"))


def rated(reviews: DataFrame) -> DataFrame:
    """What counts() needs of raw reviews, each once; the text stays unread."""
    return reviews.where("review_id is not null").select("review_id", "parent_asin", "rating").distinct()


def top_reviews(rows: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """scored() rows kept per product and bucket, with their place; rows of no bucket are dropped.

    Order: score descending, then review_id. The constant bound is applied first, so tasks
    cut every group to MOST rows before the shuffle; the product's own bound follows. With
    ``raw`` reviews the counts come from them, which spares scoring twice.
    """
    order = Window.partitionBy("parent_asin", "bucket").orderBy(F.desc("score"), F.asc("review_id"))
    few = rows.where("parent_asin is not null and bucket is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST)
    return few.join(counts(rows if raw is None else rated(raw)), "parent_asin").where(F.col("place") <= F.col("keep"))


def majority_sentiment(rows: DataFrame) -> DataFrame:
    """(parent_asin, overall_sentiment): the most frequent sentiment, the alphabetically first on ties."""
    return rows.groupBy("parent_asin").agg(F.mode("sentiment", True).alias("overall_sentiment"))


def highlights(rows: DataFrame, texts: DataFrame, share: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """(parent_asin, review_highlights): texts mixed by sentiment, missing ones made up by positive ones.

    rows: selected reviews, a few per product. Within a sentiment the order is score
    descending, then review_id; the list runs positive, neutral, negative. texts:
    (review_id, text); a null text counts as empty.
    """
    text = texts.select("review_id", F.coalesce("text", F.lit("")).alias("text"))
    with_text = rows.select("parent_asin", "review_id", "score", "sentiment").join(text, "review_id")
    listed = with_text.groupBy("parent_asin").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.array_sort(F.collect_list(F.when(F.col("sentiment") == s, F.struct((-F.col("score")).alias("o"), "review_id", "text")))).alias(s) for s in ("positive", "neutral", "negative")],
    )
    quota = {s: F.greatest(F.bround(F.lit(p) * F.col("total")).cast("int"), F.lit(1 if s == "positive" else 0)) for s, p in zip(("positive", "neutral", "negative"), share)}
    missing = sum((F.greatest(quota[s] - F.size(s), F.lit(0)) for s in quota), F.lit(0))
    mixed = F.concat(F.slice("positive", 1, quota["positive"] + missing), F.slice("neutral", 1, quota["neutral"]), F.slice("negative", 1, quota["negative"]))
    return listed.select("parent_asin", F.transform(mixed, lambda r: r["text"]).alias("review_highlights"))


def product_reviews(reviews: DataFrame) -> DataFrame:
    """(parent_asin, overall_sentiment, review_highlights) of every product with a kept review."""
    kept = top_reviews(scored(reviews), reviews)
    texts = reviews.where("review_id is not null").select("review_id", "text")
    wanted = kept.select("review_id").distinct()
    once = texts.join(wanted, "review_id", "left_semi").dropDuplicates(["review_id"])
    return majority_sentiment(kept).join(highlights(kept, once), "parent_asin")


def sentiment_counts(rows: DataFrame) -> DataFrame:
    """(overall_sentiment, n_products)."""
    return majority_sentiment(rows).groupBy("overall_sentiment").agg(F.count(F.lit(1)).alias("n_products"))


__all__ = ["counts", "highlights", "majority_sentiment", "product_reviews", "rated", "scored", "sentiment_counts", "top_reviews"]
