"""Display images of a product."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

SCHEMA = "array<struct<variant:string,thumb:string,large:string,hi_res:string>>"


def parse(raw: Column) -> Column:
    """Images of a JSON list, of one JSON object, or of a bare address taken as the main image."""
    text = F.trim(raw)
    listed = F.from_json(text, SCHEMA)
    single = F.from_json(F.concat(F.lit("["), text, F.lit("]")), SCHEMA)
    bare = F.array(F.struct(F.lit("MAIN").alias("variant"), F.lit(None).cast("string").alias("thumb"), raw.alias("large"), F.lit(None).cast("string").alias("hi_res")))
    return F.when(raw.isNull() | (text == ""), F.from_json(F.lit("[]"), SCHEMA)).when(text.startswith("["), listed).when(text.startswith("{"), single).otherwise(bare)


def _code_like(code, pattern: str):
    return lambda i: code(i).rlike(pattern)


def display_urls(images: Column) -> Column:
    """Addresses in display order: main (or first), PT01, then one per angle; large, else hi_res, else thumb; each once."""
    known = F.filter(F.coalesce(images, F.from_json(F.lit("[]"), SCHEMA)), lambda i: i.isNotNull())
    code = lambda i: F.upper(F.trim(F.coalesce(i["variant"], F.lit(""))))
    first = lambda test: F.get(F.filter(known, test), 0)
    slots = [F.coalesce(first(lambda i: code(i) == "MAIN"), F.get(known, 0)), first(lambda i: code(i) == "PT01")]
    for starts in vocab.IMAGE_ANGLES.values():
        pattern = "^(" + "|".join(s.upper() for s in starts) + ")"
        slots.append(F.get(F.filter(known, _code_like(code, pattern)), 0))
    filled = lambda c: F.when(c != "", c)
    url = lambda i: F.coalesce(filled(i["large"]), filled(i["hi_res"]), filled(i["thumb"]))
    return F.array_distinct(F.array_compact(F.transform(F.array(*slots), url)))
