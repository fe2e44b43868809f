"""Exchangeable models: what the engine asks of an embedder, a reranker, a sentiment model and a language model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import query_text, vocab
from ..functions.reviews import lexicon_sentiment
from .retrieval import query_words, word_score
from .vector import hashed_embedding

#: Texts a sentiment model gets at a time.
CHUNK = 128


@dataclass(frozen=True)
class Models:
    """Each part can be replaced; the defaults are deterministic stand-ins without a model behind them.

    embed: (rows, text column) -> rows with ``vec``. rerank: (query, candidate text) -> score column.
    classify: list of texts -> list of positive, neutral or negative; None keeps the stand-in, a column expression.
    extract: query column -> struct column of the language model's answer (is_fashion, language, english_query and the
    fields of a query), null where it gave none; None means no language model.
    """

    embed: Callable[[DataFrame, str], DataFrame] = hashed_embedding
    rerank: Callable[[Column, Column], Column] = lambda query, text: word_score(query_words(query), text)
    classify: Callable[[list[str]], list[str]] | None = None
    extract: Callable[[Column], Column] | None = None


def sentiments(df: DataFrame, text: str, models: Models | None = None, chunk: int = CHUNK) -> DataFrame:
    """The rows with ``sentiment``: positive, neutral or negative.

    The model gets the texts of a task in chunks; a chunk that fails, or comes back in another length or with another
    label, is neutral and the rest goes on. Null texts are neutral without being sent.
    """
    model = (models or Models()).classify
    if model is None:
        return df.withColumn("sentiment", lexicon_sentiment(F.col(text)))
    if chunk < 1:
        raise ValueError("chunk must be at least 1")
    at = df.columns.index(text)
    names = [*df.columns, "sentiment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            some = [i for i, t in enumerate(texts) if t is not None]
            out = ["neutral"] * len(texts)
            for a in range(0, len(some), chunk):
                part = some[a : a + chunk]
                try:
                    labels = model([texts[i] for i in part])
                    good = len(labels) == len(part) and all(x in vocab.SENTIMENTS for x in labels)
                except Exception:  # noqa: BLE001
                    good = False
                if good:
                    for i, label in zip(part, labels):
                        out[i] = label
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("sentiment", T.StringType())]))


def understand(queries: DataFrame, query: str = "q", models: Models | None = None) -> DataFrame:
    """The queries with is_fashion, message, language, english and search_query.

    A language model's verdict decides if it gave one; otherwise a fashion word must occur. A refused query gets the
    message and no search text. Accepted ones are searched in English, without phrases about persons. Null queries are refused.
    """
    extract = (models or Models()).extract
    asked = queries.withColumn("__m", extract(F.col(query)) if extract else F.lit(None).cast("struct<is_fashion:boolean,language:string,english_query:string>"))
    fashion = F.coalesce(F.col("__m.is_fashion"), query_text.has_fashion_term(F.col(query)), F.lit(False))
    english = F.coalesce(F.when(F.col("__m.english_query") != "", F.col("__m.english_query")), F.col(query))
    return asked.select(
        *queries.columns, fashion.alias("is_fashion"), F.when(~fashion, F.lit(vocab.NOT_FASHION_MESSAGE)).alias("message"), F.col("__m.language").alias("language"),
        F.when(fashion, english).alias("english"), F.when(fashion, query_text.without_relations(english)).alias("search_query"),
    )


def guarded(understood: DataFrame, query: str, results: DataFrame) -> DataFrame:
    """(query, message, results' other columns): the results of accepted queries, one row with the message for refused ones.

    Results of a refused query, should there be any, are dropped; an accepted query without results gives one row of nulls.
    """
    told = understood.select(query, "is_fashion", "message")
    hits = told.where("is_fashion").join(results, query, "left")
    refused = told.where("not is_fashion")
    return hits.unionByName(refused, allowMissingColumns=True).drop("is_fashion")
