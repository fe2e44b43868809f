"""Product attributes from titles, as Column expressions."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

#: White space, hyphens of all kinds, underscores and slashes part a title.
SPLIT = r"(?U)[\s\-_/‐-―]+"


def literal_map(words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])


def tokens(title: Column) -> Column:
    """Lower-cased parts of a title without what is neither a-z nor 0-9 at their ends."""
    return F.transform(F.split(title, SPLIT), lambda t: F.regexp_replace(F.lower(t), "^[^a-z0-9]+|[^a-z0-9]+$", ""))


def first_value(words: Column, values: dict[str, list[str]]) -> Column:
    """The value of the first word that stands for one; null if none does."""
    table = literal_map(vocab.lookup(values))
    return F.get(F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda v: v.isNotNull()), 0)


def gender(title: Column) -> Column:
    plain = F.transform(tokens(title), lambda t: F.regexp_replace(t, "'s?$", ""))
    return first_value(plain, vocab.GENDERS)


def category(title: Column) -> Column:
    low = F.lower(title)
    shirt = low.contains("t-shirt") | low.contains("t shirt") | low.contains(" tee")
    return F.when(shirt, "t-shirt").otherwise(first_value(tokens(title), vocab.CATEGORIES))


def color(title: Column) -> Column:
    low = F.lower(title)
    return F.when(low.contains("navy blue") | low.contains("navy-blue"), "navy").otherwise(first_value(tokens(title), vocab.COLORS))


def size(title: Column) -> Column:
    low = F.lower(title)
    any_of = lambda names: F.array_max(F.array(*[low.contains(n) for n in names]))
    told = F.lower(F.regexp_extract(title, r"(?iU)\bsize\s*[:\-]?\s*([a-z0-9]+)\b", 1))
    labelled = F.try_element_at(literal_map(vocab.lookup(vocab.SIZES)), told)
    return (
        F.when(any_of(["extra-large", "extra large", "x-large"]), "xl")
        .when(any_of(["extra-small", "extra small", "x-small"]), "xs")
        .otherwise(F.coalesce(labelled, first_value(tokens(title), vocab.SIZES)))
    )


def style(title: Column) -> Column:
    return first_value(tokens(title), vocab.STYLES)


ALL = {"gender": gender, "category": category, "color": color, "style": style, "size": size}


def all_attributes(title: Column) -> Column:
    """Struct of the five attributes; a null or empty title has none."""
    return F.struct(*[f(title).alias(name) for name, f in ALL.items()])


#: The named entities of HTML 5 that end in a semicolon, from the standard library's table.
ENTITIES = {name: char for name, char in html.entities.html5.items() if name.endswith(";")}


def unescape(text: Column) -> Column:
    """Named, decimal and hexadecimal entities resolved, once; what is none stays, as do entities without a semicolon.

    Numbers that are no character become the replacement character.
    """
    names = literal_map(ENTITIES)
    parts = F.split(text, "&")
    body = lambda p: F.regexp_extract(p, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)

    def resolved(p: Column) -> Column:
        name = body(p)
        number = F.when(name.startswith("#x") | name.startswith("#X"), F.conv(F.substring(name, F.lit(3), F.lit(6)), 16, 10).cast("int")).when(name.startswith("#"), F.substring(name, F.lit(2), F.lit(7)).cast("int"))
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        # a character beyond the basic plane is two UTF-16 units
        high, low = F.floor((number - 0x10000) / 0x400) + 0xD800, (number - 0x10000) % 0x400 + 0xDC00
        unit = lambda n: F.lpad(F.hex(n), 4, "0")
        char = F.decode(F.unhex(F.when(number < 0x10000, unit(number)).otherwise(F.concat(unit(high), unit(low)))), "UTF-16BE")
        made = F.when(name == "", None).when(name.startswith("#"), F.when(valid, char).otherwise(F.lit("\ufffd"))).otherwise(F.try_element_at(names, F.concat(name, F.lit(";"))))
        rest = F.substring(p, F.length(name) + 2, F.length(p))
        return F.when(made.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(made, rest))

    tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), resolved)
    return F.when(text.contains("&"), F.concat(parts[0], F.array_join(tail, ""))).otherwise(text)


def normalize_title(title: Column) -> Column:
    """Entities resolved, white space collapsed, punctuation at the ends dropped (not &), lower case."""
    out = F.regexp_replace(unescape(title), r"(?U)\s+", " ")
    out = F.regexp_replace(F.trim(out), r"(?U)^[^\w&]+|[^\w&]+$", "")
    return F.lower(out)
