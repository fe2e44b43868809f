"""Held-out passages inside a corpus: word n-grams of the items against all document windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import sketch_candidates
from ..session import cut, spread
from .bitmap import build, holds, width
from .text import fold_words, prefix_hash, span_hash

#: Words of a shared passage.
WORDS = 12
#: Parts into which the hits of a passage are dealt that holds a hundredth of all hits.
PARTS = 64


def word_grams(text: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """(hashes, starts, ends, word hashes, lower-cased text) of all n-word windows of a text."""
    codes, starts, ends, lower = fold_words(text)
    words = span_hash(prefix_hash(codes), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    words = words ^ (ends - starts).astype(np.uint64)
    if len(words) < n:
        return np.zeros(0, np.uint64), starts, ends, words, lower
    at = np.arange(len(words) - n + 1)
    return span_hash(prefix_hash(words), at, at + n), starts, ends, words, lower


def _gram_rows(key: str, n: int, keep_text: bool):
    """mapInArrow body: (key, gram, at, passage) for every window of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, grams, at, passages = [], [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                hashes, starts, ends, _, lower = word_grams(text, n)
                _, first = np.unique(hashes, return_index=True)
                for i in np.sort(first):
                    keys.append(k)
                    grams.append(int(hashes[i].view(np.int64)))
                    at.append(int(i))
                    passages.append(passage(lower, starts, ends, int(i), n) if keep_text else None)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(grams, pa.int64()), pa.array(at, pa.int64()), pa.array(passages, pa.string())], [key, "gram", "at", "passage"])

    return run


def passage(lower: str, starts: np.ndarray, ends: np.ndarray, at: int, n: int) -> str:
    """The n words from number ``at`` on, joined by blanks."""
    return " ".join(lower[a:b] for a, b in zip(starts[at : at + n].tolist(), ends[at : at + n].tolist()))


def gram_table(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, gram, at, passage): the distinct n-word windows of each text; null and short texts give none."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_gram_rows("key", n, True), "key long, gram long, at long, passage string")


_HITS = "doc long, body long, gram long, passage string, word_from int, char_from int, char_to int"


def _scan(shared, n: int):
    """mapInArrow body: (doc, text) -> the windows whose hash may be an item's, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        names = [c.split()[0] for c in _HITS.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for doc, body, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                hashes, starts, ends, _, lower = word_grams(text, n)
                if not len(hashes):
                    continue
                signed = hashes.view(np.int64)
                for i in np.flatnonzero(holds(shared.value, signed)).tolist():
                    row = (doc, body, int(signed[i]), passage(lower, starts, ends, i, n), i, int(starts[i]), int(ends[i + n - 1]))
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], names)

    return run


def shared_windows(documents: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(windows of documents that may be an item's, windows of items (gram, passage, item)).

    Only a bitmap of the items' window hashes travels to the tasks: its size follows the number of distinct hashes up to
    32 MB and no further, whatever the items; a fuller one lets more windows pass, and the join on hash and words that
    follows drops them. The corpus is scanned once where it lies; only its possible hits move.
    """
    owned = cut(gram_table(items, item_key, text, n).select("gram", "passage", F.col("key").alias("item")).distinct())
    grams = owned.select("gram").distinct()
    shared = documents.sparkSession.sparkContext.broadcast(build(grams, "gram", width(grams.count())))
    docs = spread(documents.where(F.col(doc_key).isNotNull() & (F.length(text) > 0)).select(F.col(doc_key).cast("long").alias("doc"), F.xxhash64(text).alias("body"), F.col(text).alias("text")))
    return cut(docs.mapInArrow(_scan(shared, n), _HITS)), owned


def leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """(doc_id, item_id): every document and item that share n consecutive words.

    Words are the runs of a-z and 0-9 of the lower-cased text. Null, empty and shorter texts share nothing; rows with a
    null key are left out; repeated rows count once.

    A bitmap of the items' n-grams is broadcast, each document is scanned where it lies, and possible hits meet the
    items' n-grams in a join on hash and words. A passage that holds a hundredth of all hits is dealt over 64 parts, so
    boilerplate shared by many documents and items is no single task's work.
    """
    windows, owned = shared_windows(documents, items, doc_key, item_key, text, n)
    found = windows.select("doc", "gram", "passage").distinct()
    hot = sketch_candidates(windows, "gram").select("gram", F.lit(True).alias("hot"))  # at most 201 rows
    left = found.join(F.broadcast(hot), "gram", "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(PARTS))).otherwise(F.lit(0).cast("long"))).drop("hot")
    parts = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = owned.join(F.broadcast(hot), "gram", "left").select("gram", "passage", "item", F.explode(parts).alias("part"))
    return left.join(right, ["gram", "passage", "part"]).select(F.col("doc").alias(doc_key), F.col("item").alias(item_key)).distinct()


def remove_leaks(documents: DataFrame, found: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """The documents without those in ``found``; documents with a null key stay."""
    return documents.join(found.select(doc_key).distinct(), doc_key, "left_anti")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        clean, characters, words = [], [], []
        for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            lower = (body or "").lower()
            drop, covered = np.zeros(len(lower), bool), set()
            for span in spans or []:
                drop[span["char_from"] : span["char_to"]] = True
                covered.update(range(span["word_from"], span["word_to"]))
            if spans:
                base = body if len(body) == len(lower) else lower
                body = "".join(np.array(list(base), object)[~drop])
            clean.append(body)
            characters.append(int(drop.sum()))
            words.append(len(covered))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(characters, pa.int64()), pa.array(words, pa.int64())], ["doc", "clean_text", "n_cut", "words_cut"])


def cut_passages(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """(doc_id, clean_text, n_cut, words_cut): each text without the words that stand in a shared n-word passage.

    n_cut counts characters, the punctuation between cut words among them; words_cut counts words. Offsets are taken in
    the lower-cased text; texts whose lower-casing changes their length (a few letters do) are cut from the lower-cased
    form. Null texts stay null with 0 cut, rows with a null key are left out, repeated rows stay.
    Any number of items is taken: hits come as in ``leaks``; the places of a text's hits, fewer than its words, meet it
    in a join.
    """
    windows, owned = shared_windows(documents, items, doc_key, item_key, text, n)
    true = windows.join(owned.select("gram", "passage").distinct(), ["gram", "passage"], "left_semi")
    place = F.struct("char_from", "char_to", "word_from", (F.col("word_from") + n).alias("word_to"))
    spans = cut(true.groupBy(F.col("doc").alias("at_doc"), F.col("body").alias("at_body")).agg(F.collect_set(place).alias("spans")))
    docs = documents.where(F.col(doc_key).isNotNull()).select(F.col(doc_key).cast("long").alias("doc"), F.col(text).alias("text"))
    placed = docs.join(spans, (F.col("doc") == F.col("at_doc")) & (F.xxhash64("text") == F.col("at_body")), "left").select("doc", "text", "spans")
    return spread(placed).mapInArrow(_without, "doc long, clean_text string, n_cut long, words_cut long").withColumnRenamed("doc", doc_key)
