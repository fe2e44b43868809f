"""Scores and classes of single reviews, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

#: Fixed value: the instant ages are counted back from, 2023-09-01 UTC in epoch milliseconds.
REFERENCE_MS = 1693526400000
DAY_MS = 86400000


def aspect_count(text: Column) -> Column:
    """How often a text names an aspect of a garment, in any letter case."""
    return F.regexp_count(text, F.lit(r"(?iU)\b(" + "|".join(vocab.ASPECTS) + r")\b"))


def score(text: Column, helpful: Column, verified: Column, ts_ms: Column) -> Column:
    """Usefulness of a review: votes, purchase, aspects, length and recency; nulls count as nothing, a null time as the reference."""
    body = F.coalesce(text, F.lit(""))
    length = F.length(body)
    days = F.greatest(F.floor((F.lit(REFERENCE_MS) - F.coalesce(ts_ms, F.lit(REFERENCE_MS))) / F.lit(float(DAY_MS))), F.lit(0))
    return (
        F.log1p(F.coalesce(helpful, F.lit(0)).cast("double"))
        + F.lit(0.5) * F.coalesce(verified, F.lit(False)).cast("int")
        + F.lit(0.2) * F.least(aspect_count(body), F.lit(4))
        + F.lit(0.5) * F.least(length, F.lit(400)) / F.lit(400.0)
        - F.lit(0.5) * (length > 1500).cast("int")
        + F.lit(0.3) / (F.lit(1.0) + days / F.lit(365.0))
    )


def rating_bucket(rating: Column) -> Column:
    """low up to 2.5, middle up to 3.5, high up to 5; null outside [0, 5]."""
    return F.when((rating >= 0) & (rating <= 2.5), "low").when((rating > 2.5) & (rating <= 3.5), "middle").when((rating > 3.5) & (rating <= 5), "high")


def keep_per_bucket(n: Column) -> Column:
    """Reviews kept per bucket of a product with n rated reviews; never more than 3."""
    return F.when(n <= 3, n).when(n <= 10, F.lit(2)).otherwise(F.lit(3))


def star_label(label: Column) -> Column:
    """Sentiment of a label such as '4 stars': the least digit of 1 to 5 in it decides; none is neutral."""
    low = F.lower(label)
    return F.when(low.rlike("[12]"), "negative").when(low.contains("3"), "neutral").when(low.rlike("[45]"), "positive").otherwise("neutral")


def rating_sentiment(rating: Column) -> Column:
    """Stand-in for a model: the sentiment of the rounded rating as a star label; null is neutral."""
    return star_label(F.coalesce(F.concat(F.round(rating).cast("int").cast("string"), F.lit(" stars")), F.lit("")))


def lexicon_sentiment(text: Column) -> Column:
    """Stand-in for a model on text: great or love, else bad, else neutral."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.contains("great") | low.contains("love"), "positive").when(low.contains("bad"), "negative").otherwise("neutral")
