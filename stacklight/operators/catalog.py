"""The enriched catalogue: attributes, review results, text, index rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import attributes, images, vocab


def one_per_key(products: DataFrame, key: str = "parent_asin") -> DataFrame:
    """One row per non-null key: the one with most ratings, then the highest price, then the first title."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("rating_number"), F.desc_nulls_last("price"), F.asc_nulls_last("title"))
    return products.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def plain_description(products: DataFrame) -> Column:
    """The description as one text, null if nothing is left; a list's parts are trimmed and joined."""
    kind = products.schema["description"].dataType.typeName()
    text = F.concat_ws(" ", F.filter(F.transform("description", lambda p: F.trim(p)), lambda p: p != "")) if kind == "array" else F.trim("description")
    return F.when(text != "", text)


def with_attributes(products: DataFrame) -> DataFrame:
    title = F.coalesce("title", F.lit(""))
    return products.select("*", *[f(title).alias(name) for name, f in attributes.ALL.items()])


def combined_text() -> Column:
    """Title, description, colour, gender, size, style, category and sentiment, trimmed, without the empty ones."""
    names = ["title", "description", "color", "gender", "size", "style", "category", "overall_sentiment"]
    return F.concat_ws(" ", *[F.when(F.trim(n) != "", F.trim(n)) for n in names])


def candidate_text() -> Column:
    """What a reranker reads of a candidate."""
    return F.concat_ws(" ", *[F.when(F.trim(n) != "", F.trim(n)) for n in ("title", "description", "category", "color", "style", "gender")])


def enrich(products: DataFrame, review_results: DataFrame) -> DataFrame:
    """Products with attributes, sentiment and highlights, defaults where unknown, and their combined text.

    products: one row per parent_asin. review_results: (parent_asin, overall_sentiment,
    review_highlights), at most one row per key. Size stays null where unknown.
    """
    described = with_attributes(products.withColumn("description", plain_description(products)))
    joined = described.join(review_results, "parent_asin", "left")
    filled = joined.select(
        "parent_asin", "title", "average_rating", "rating_number", "images", "size",
        *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in vocab.DEFAULTS.items()],
        F.coalesce("review_highlights", F.array().cast("array<string>")).alias("review_highlights"),
    )
    return filled.withColumn("combined_text", combined_text())


def embeddable(enriched: DataFrame) -> DataFrame:
    """Rows that can be embedded: a key and a text that isn't blank."""
    return enriched.where("parent_asin is not null and trim(combined_text) <> ''")


def encode_rows(enriched: DataFrame) -> DataFrame:
    """Index metadata: lists as JSON text, nulls left null."""
    return enriched.select(
        F.col("parent_asin").alias("id"), "title", "description", "gender", "color", "style", "size", "category", "overall_sentiment", "average_rating",
        F.col("rating_number").cast("long").alias("rating_number"), F.to_json("images").alias("images"), F.to_json("review_highlights").alias("review_highlights"),
    )


def json_strings(raw: Column) -> Column:
    """A JSON list as strings; text that is no JSON becomes a list of itself, null and blank an empty one."""
    text = F.trim(raw)
    listed = F.from_json(text, "array<string>")
    return F.when(raw.isNull() | (text == ""), F.array().cast("array<string>")).when(text.startswith("[") & listed.isNotNull(), listed).otherwise(F.array(F.when(text.startswith('"') & text.endswith('"'), F.get_json_object(F.concat(F.lit('{"a":'), text, F.lit("}")), "$.a")).otherwise(raw)))


def image_addresses(raw: Column) -> Column:
    """Addresses of stored images: display order for image records, as listed for plain addresses."""
    shown = images.display_urls(images.parse(raw))
    return F.when(F.size(shown) > 0, shown).otherwise(F.filter(json_strings(raw), lambda u: ~u.startswith("{")))


def decode_rows(index: DataFrame) -> DataFrame:
    """Products from index rows: default title, whole rating counts, images and highlights parsed."""
    return index.select(
        "id", F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit("Unknown Title")).alias("title"), "gender", "color", "style", "size", "category", "overall_sentiment",
        "average_rating", F.col("rating_number").cast("long").alias("rating_number"), image_addresses(F.col("images")).alias("image_urls"), json_strings(F.col("review_highlights")).alias("review_highlights"),
    )


def latest_rows(index: DataFrame, key: str = "id", at: str = "indexed_at") -> DataFrame:
    """The current state of an append-only index: for each key its last written row.

    Rows written at the same time are ordered by their text form, so a repeated delivery
    changes nothing.
    """
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(at), F.desc_nulls_last("title"), F.desc_nulls_last("rating_number"), F.desc_nulls_last("average_rating"))
    return index.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
