"""What a search query asks for, as Column expressions; the same rules serve single texts and tables of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import attributes, vocab

# The patterns of numbers, praise, persons and general clothing words, and those of prices and ratings below.
_NUMBER = r"(\d+(?:\.\d+)?)"
_RATED = r"(?iU)\b(" + "|".join(vocab.RATING_PHRASES) + r")\b"
_PERSON = r"(?iU)\s*\b(?:for\s+)?(?:my|his|her|our)\s+(?:" + "|".join(vocab.RELATION_NOUNS) + r")(?:'s)?\b"
_GENERAL = rf"(?iU)\b(?:{vocab.GENERAL_TERMS})\b"


def _number(query: Column, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(query, pattern, group)
    return F.when(got != "", got).cast("double")


def price_range(query: Column) -> Column:
    """Struct (price_min, price_max): a range, else an upper, else a lower bound; null where none is named."""
    span = r"(?iU)\$?\s*" + _NUMBER + r"\s*(?:-|to)\s*\$?\s*" + _NUMBER
    one, two = _number(query, span, 1), _number(query, span, 2)
    below = _number(query, r"(?iU)\b(?:under|below|less than|<)\s*\$?\s*" + _NUMBER)
    above = _number(query, r"(?iU)\b(?:over|above|more than|>)\s*\$?\s*" + _NUMBER)
    low = F.when(one.isNotNull(), F.least(one, two)).when(below.isNull(), above)
    high = F.when(one.isNotNull(), F.greatest(one, two)).otherwise(below)
    return F.struct(low.alias("price_min"), high.alias("price_max"))


def min_rating(query: Column) -> Column:
    """Stars named as a number, else 4.0 for phrases of praise."""
    pattern = r"(?iU)\b(\d(?:\.\d)?)\s*\+?\s*stars?\b|\brated?\s*(\d(?:\.\d)?)\s*\+"
    told = F.coalesce(_number(query, pattern, 1), _number(query, pattern, 2))
    return F.coalesce(told, F.when(query.rlike(_RATED), F.lit(4.0)))


def sentiment(query: Column) -> Column:
    return F.when(query.rlike(_RATED), "positive")


def gender(query: Column) -> Column:
    """A gender word, else what relatives imply; both genders cancel out."""
    hits = {g: query.rlike(r"(?iU)\b(" + "|".join(words) + r")\b") for g, words in vocab.RELATIONS.items()}
    implied = F.when(hits["women"] & ~hits["men"], "women").when(hits["men"] & ~hits["women"], "men")
    return F.coalesce(attributes.gender(query), implied)


def category(query: Column) -> Column:
    """The garment; "dress" next to another garment only describes it."""
    plain = attributes.category(query)
    other = attributes.category(F.regexp_replace(query, r"(?iU)\bdress(es)?\b", " "))
    return F.when(plain == "dress", F.coalesce(other, plain)).otherwise(plain)


def without_relations(query: Column) -> Column:
    """The query without "for my husband" and the like; unchanged if nothing else is left."""
    left = F.trim(F.regexp_replace(F.regexp_replace(query, _PERSON, ""), r"(?U)\s{2,}", " "))
    return F.when(left != "", left).otherwise(query)


def filters(query: Column) -> Column:
    """Struct of all that the rules find in a query."""
    price = price_range(query)
    return F.struct(
        gender(query).alias("gender"), category(query).alias("category"), attributes.color(query).alias("color"), attributes.style(query).alias("style"), attributes.size(query).alias("size"),
        price["price_min"].alias("price_min"), price["price_max"].alias("price_max"), min_rating(query).alias("min_rating"), sentiment(query).alias("sentiment"),
    )


def has_fashion_term(query: Column) -> Column:
    """Whether a word, bare of a final s or es, belongs to fashion."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"([^\W\d_]+)"), F.lit(1))
    terms = F.array(*[F.lit(t) for t in vocab.FASHION_TERMS])
    known = lambda w: F.array_contains(terms, w)
    return F.exists(words, lambda w: known(w) | known(F.regexp_replace(w, "s+$", "")) | known(F.regexp_replace(w, "es$", "")))


def is_outfit(query: Column) -> Column:
    """A general clothing word and no garment."""
    return query.rlike(_GENERAL) & category(query).isNull()


def group_text(query: Column, noun: str | Column) -> Column:
    """The query with its first general clothing word replaced by a noun, or the noun appended."""
    noun = F.lit(noun) if isinstance(noun, str) else noun
    word = F.regexp_substr(query, F.lit(_GENERAL))
    at = F.regexp_instr(query, F.lit(_GENERAL))
    swapped = F.concat(F.substring(query, F.lit(1), at - 1), noun, F.substring(query, at + F.length(word), F.length(query)))
    return F.when(word.isNull(), F.concat(query, F.lit(" "), noun)).otherwise(swapped)


#: Fields a model may fill in, with the values it may name; None means a number.
MODEL_FIELDS = {"gender": list(vocab.GENDERS), "category": [*vocab.CATEGORIES, *vocab.CATEGORY_ALIASES], "color": list(vocab.COLORS), "style": list(vocab.STYLES), "size": list(vocab.SIZES), "price_min": None, "price_max": None, "min_rating": None, "sentiment": vocab.SENTIMENTS}


def valid_choice(value: Column, name: str) -> Column:
    """A model's answer for a field if it is one of the field's values, stored names applied; else null."""
    allowed = MODEL_FIELDS[name]
    if allowed is None:
        return F.expr("CAST(NULL AS DOUBLE)") if value is None else value.try_cast("double")
    word = F.lower(F.trim(value))
    known = F.when(word.isin(allowed), word)
    if name == "category":
        return F.coalesce(F.try_element_at(attributes.literal_map(vocab.CATEGORY_ALIASES), known), known)
    return known


def merged(rule: Column, model: Column, name: str) -> tuple[Column, Column]:
    """(value, source) of a field: what the rules found, else the model's valid answer."""
    answer = valid_choice(model, name)
    return F.coalesce(rule, answer), F.when(rule.isNotNull(), "regex").when(answer.isNotNull(), "llm")
