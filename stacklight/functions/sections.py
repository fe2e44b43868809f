"""Storefront sections and small rules over catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import attributes, vocab


def _names(title: Column, pattern: str) -> Column:
    return F.coalesce(title, F.lit("")).rlike("(?iU)" + pattern)


def is_footwear(category: Column, title: Column) -> Column:
    return F.lower(F.coalesce(category, F.lit(""))).isin(vocab.FOOTWEAR_CATEGORIES) | _names(title, vocab.FOOTWEAR_PATTERN)


def is_accessory(category: Column, title: Column) -> Column:
    """Accessory by category or title; footwear never is."""
    named = F.lower(F.coalesce(category, F.lit(""))).isin(vocab.ACCESSORY_CATEGORIES) | _names(title, vocab.ACCESSORY_PATTERN)
    return ~is_footwear(category, title) & named


def effective_gender(gender: Column, category: Column, title: Column) -> Column:
    """The stored gender if it is one, else the title's, else women for garments only women wear, else null."""
    stored = F.lower(gender)
    garment = F.coalesce(F.when(category != "", category), attributes.category(title))
    return F.coalesce(F.when(stored.isin(list(vocab.GENDERS)), stored), attributes.gender(title), F.when(garment.isin(vocab.WOMEN_ONLY), "women"))


def garment_region(category: Column, title: Column) -> Column:
    """Body region of a garment by its category; the title's only where no category is stored at all."""
    garment = F.lower(F.coalesce(F.when(category != "", category), attributes.category(title)))
    return F.try_element_at(attributes.literal_map(vocab.lookup(vocab.GARMENT_REGIONS)), garment)


def allowed_image(url: Column) -> Column:
    """https, and the host is an allowed one or below it. Null and malformed addresses are not allowed."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    fits = [(host == h) | host.endswith("." + h) for h in vocab.IMAGE_HOSTS]
    ok = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https"
    return F.coalesce(ok & (fits[0] | fits[1] | fits[2]), F.lit(False))


def in_tab(tab: str, gender: Column, footwear: Column, accessory: Column) -> Column:
    """Whether a result belongs under a tab: all, men, women, kids, footwear or accessories."""
    if tab == "all":
        return F.lit(True)
    if tab in ("footwear", "accessories"):
        return footwear if tab == "footwear" else accessory
    own = gender == tab
    return F.coalesce(own if tab == "kids" else own | (gender == "unisex"), F.lit(False))


def star_fill(rating: Column) -> Column:
    """Five words, full, half or empty, for a rating; a null rating is empty."""
    r = F.coalesce(rating, F.lit(0.0))
    return F.array(*[F.when(r >= n - 0.25, "full").when(r >= n - 0.75, "half").otherwise("empty") for n in range(1, 6)])


def card(row_id: Column, title: Column, gender: Column, category: Column, images: Column, rating: Column, highlights: Column) -> Column:
    """A result as shown: struct of (product_id, title, images, average_rating, review_highlights, garment_type, gender, is_accessory, is_footwear)."""
    return F.struct(
        row_id.alias("product_id"), title.alias("title"), images.alias("images"), rating.alias("average_rating"), highlights.alias("review_highlights"),
        garment_region(category, title).alias("garment_type"), effective_gender(gender, category, title).alias("gender"),
        is_accessory(category, title).alias("is_accessory"), is_footwear(category, title).alias("is_footwear"),
    )
