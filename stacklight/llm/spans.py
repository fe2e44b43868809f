"""Long exact stretches shared between documents: winnowed seeds, extension, maximal spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut, spread
from .text import codepoints, mix, prefix_hash, sliding_min, span_hash

#: Characters of a seed; any shared stretch of the least length holds a common selected seed.
SEED = 64
#: Characters handled at once in a task; longer texts are cut into overlapping blocks.
BLOCK = 4_000_000
#: Distinct contexts of one seed that a single task compares; seeds with more are spread by window.
GROUP = 1000

_POS = np.uint64((1 << 24) - 1)


def _blocks(keys: list, texts: list[str | None], least: int) -> Iterator[list[tuple[object, int, str]]]:
    """Lists of (key, offset, piece) of about BLOCK characters; pieces of one text overlap by least - 1."""
    out, have = [], 0
    for key, text in zip(keys, texts):
        if text is None or len(text) < least:
            continue
        for a in range(0, len(text) - least + 1, BLOCK):
            piece = text[a : a + BLOCK + least - 1]
            out.append((key, a, piece))
            have += len(piece)
            if have >= BLOCK:
                yield out
                out, have = [], 0
    if out:
        yield out


def _inside(lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, start) of all windows of ``least`` characters that lie within one of the joined texts."""
    count = np.maximum(lengths - least + 1, 0)
    which = np.repeat(np.arange(len(lengths)), count)
    base = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    skip = np.concatenate([[0], np.cumsum(count)])[:-1]
    return which, np.arange(len(which)) + np.repeat(base - skip, count)


def seeds(block: list[tuple[object, int, str]], least: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text number, seed hash, context hash, first start, number of starts, distance to the seed).

    Every window of ``least`` characters selects its least seed hash, leftmost on ties, so equal
    windows select the same seed. The windows that select one seed are consecutive; together
    they are the seed's context.
    """
    lengths = np.fromiter((len(t) for _, _, t in block), np.int64, len(block))
    codes = codepoints("".join(t for _, _, t in block))
    prefix = prefix_hash(codes)
    at = np.arange(len(codes) - seed + 1)
    grams = mix(span_hash(prefix, at, at + seed))
    chosen = sliding_min((grams & ~_POS) | at.astype(np.uint64), least - seed + 1) & _POS
    which, start = _inside(lengths, least)
    place = chosen[start].astype(np.int64)
    head = np.ones(len(start), bool)
    head[1:] = (place[1:] != place[:-1]) | (which[1:] != which[:-1])
    h = np.flatnonzero(head)
    n = np.diff(np.append(h, len(start)))
    s1 = start[h]
    context = mix(span_hash(prefix, s1, s1 + n - 1 + least)) ^ mix((n * 4096 + place[h] - s1).astype(np.uint64))
    base = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    return which[h], grams[place[h]], context, s1 - base[which[h]], n, place[h] - s1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _seed_rows(least: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), least):
                which, grams, context, first, n, _ = seeds(block, least, seed)
                keys = np.array([k for k, _, _ in block], np.int64)[which]
                offset = np.array([a for _, a, _ in block], np.int64)[which]
                yield pa.RecordBatch.from_arrays([pa.array(keys), _signed(grams), _signed(context), pa.array((first + offset).astype(np.int32)), pa.array(n.astype(np.int32))], ["doc", "seed", "context", "first", "n"])

    return run


def _windows(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every window of the texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    prefix = prefix_hash(codepoints("".join(texts)))
    which, start = _inside(lengths, least)
    return which, mix(span_hash(prefix, start, start + least))


def shared_windows(texts: list[str], low: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, from, to): runs of windows of each text that another document holds too.

    low and high are the least and greatest document of each text; a window is shared if
    those that hold it are not all the same document.
    """
    which, hashes = _windows(texts, least)
    if not len(which):
        return which, which, which
    order = np.argsort(hashes, kind="stable")
    sorted_hash = hashes[order]
    heads = np.flatnonzero(np.append(True, sorted_hash[1:] != sorted_hash[:-1]))
    lo = np.minimum.reduceat(low[which[order]], heads)
    hi = np.maximum.reduceat(high[which[order]], heads)
    hit = np.zeros(len(which), bool)
    hit[order] = np.repeat(lo != hi, np.diff(np.append(heads, len(order))))
    first = np.searchsorted(which, which)  # index of the text's first window
    edge = hit.copy()
    edge[1:] &= ~(hit[:-1] & (which[1:] == which[:-1]))
    stop = hit.copy()
    stop[:-1] &= ~(hit[1:] & (which[1:] == which[:-1]))
    a, b = np.flatnonzero(edge), np.flatnonzero(stop)
    return which[a], a - first[a], b - first[a]


def _compare(least: int):
    """mapInArrow body over rows sorted by seed: (seed, context, low, high, body) -> shared runs per context."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        low, high = (np.array([r[k] for r in rows], np.int64) for k in (2, 3))
        which, a, b = shared_windows([r[4] for r in rows], low, high, least)
        seed, context = (np.array([r[k] for r in rows], np.int64)[which] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(seed), pa.array(context), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["seed", "context", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, have, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if have >= BLOCK // 4 and row[0] != last:
                    yield flush(rows)
                    rows, have = [], 0
                rows.append(row)
                have += len(row[4])
                last = row[0]
        if rows:
            yield flush(rows)

    return run


def _explode(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seed, context, low, high = (batch.column(k).to_numpy() for k in range(4))
            which, hashes = _windows(batch.column(4).to_pylist(), least)
            first = np.searchsorted(which, which)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seed[which], context[which], low[which], high[which])] + [_signed(hashes), pa.array((np.arange(len(which)) - first).astype(np.int32))], ["seed", "context", "low", "high", "win", "at"])

    return run


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = 300, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(doc_id, span_start, span_end): per document, its stretches of at least ``least`` characters
    that stand verbatim in another document; overlapping or adjoining ones are joined.

    Offsets are 0-based code points, the end exclusive. Null, empty and shorter texts and rows
    with a null key give nothing; repeats within one document alone are not shared; rows that
    repeat a key count as one document.

    1. Each text yields winnowed seeds with the context of all windows that select the seed.
    2. Equal contexts collapse in a pre-aggregated group: one row for any number of copies. A
       context of two documents is shared as a whole.
    3. Only contexts of a single document whose seed occurs elsewhere are extended: their
       characters are fetched and compared window by window with the other contexts of the seed.
       Seeds with more than ``group`` contexts are compared by window hash over all tasks.
    4. Shared runs go back to all documents of the context and are joined per document.
    """
    if not 0 < seed <= least:
        raise ValueError("seed must be between 1 and least")
    docs = documents.where(F.col(key).isNotNull() & (F.length(text) >= least)).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("body"))
    rows = cut(spread(docs).mapInArrow(_seed_rows(least, seed), "doc long, seed long, context long, first int, n int"))
    contexts = rows.groupBy("seed", "context").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min(F.struct("doc", "first")).alias("at"), F.first("n").alias("n"))
    per_seed = contexts.groupBy("seed").agg(F.min("low").alias("seed_low"), F.max("high").alias("seed_high"), F.count(F.lit(1)).alias("n_contexts"), F.count_if(F.col("low") == F.col("high")).alias("n_single"))
    live = per_seed.where("seed_low <> seed_high").select("seed", "n_contexts", "n_single")
    shared = cut(contexts.join(live, "seed"))
    whole = shared.where("low <> high").select("seed", "context", F.lit(0).alias("from"), (F.col("n") - 1).alias("to"))
    compared = (
        shared.where("n_contexts > 1 and n_single > 0")
        .join(docs.withColumnRenamed("doc", "d"), F.col("at.doc") == F.col("d"))
        .select("seed", "context", "low", "high", F.expr(f"substring(body, at.first + 1, n + {least - 1})").alias("body"), "n_contexts")
    )
    some = compared.where(F.col("n_contexts") <= group).drop("n_contexts")
    runs = some.repartition("seed").sortWithinPartitions("seed").mapInArrow(_compare(least), "seed long, context long, from int, to int")
    many = compared.where(F.col("n_contexts") > group).drop("n_contexts").mapInArrow(_explode(least), "seed long, context long, low long, high long, win long, at int")
    hits = many.groupBy("win").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("win")
    by_context = Window.partitionBy("seed", "context").orderBy("at")
    islands = many.join(hits, "win", "left_semi").withColumn("g", F.col("at") - F.row_number().over(by_context))
    spread_runs = islands.groupBy("seed", "context", "g").agg(F.min("at").alias("from"), F.max("at").alias("to")).drop("g")
    part = runs.unionByName(spread_runs)
    # contexts shared as a whole need no partial runs; joining both is harmless
    found = rows.join(whole.unionByName(part), ["seed", "context"]).select("doc", (F.col("first") + F.col("from")).alias("a"), (F.col("first") + F.col("to") + least).alias("b"))
    return join_spans(found, "doc", "a", "b").select(F.col("doc").alias(key), F.col("a").cast("long").alias("span_start"), F.col("b").cast("long").alias("span_end"))


def join_spans(spans: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """The spans of each key with overlapping and adjoining ones joined."""
    w = Window.partitionBy(key).orderBy(a, b)
    reach = F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(a) <= F.col("__reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return spans.distinct().withColumn("__reach", reach).withColumn("__island", island).groupBy(key, "__island").agg(F.min(a).alias(a), F.max(b).alias(b)).drop("__island")


def shared_amount(documents: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_shared, n_spans) of every document; null texts have 0 characters."""
    sums = spans.groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"), F.count(F.lit(1)).alias("n_spans"))
    base = documents.where(F.col(key).isNotNull()).select(F.col(key), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))
    return base.join(sums, key, "left").na.fill(0, ["n_shared", "n_spans"])
