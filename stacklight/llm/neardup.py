"""Near-duplicate records: banded signatures, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import class_pairs
from ..session import cut, shuffle_parts, spread
from .bitmap import build, holds
from .text import codepoints, mix, prefix_hash, span_hash


@dataclass(frozen=True)
class Settings:
    """Parameters of the search; the defaults suit a similarity of 0.7."""

    similarity: float = 0.7
    least_words: int = 30
    #: Bands of ``rows`` min-hashes each over the record's neighbouring word pairs.
    bands: int = 48
    rows: int = 5
    #: A candidate is dropped once its chance of reaching the similarity falls below this.
    miss: float = 1e-4
    #: Signature bits compared at a time, of 116.
    batch_bits: int = 16
    #: Records of one bucket that a task compares at once; larger buckets are tiled over tasks.
    tile: int = 512
    #: Bits of the fixed-size filter that spares the shuffle records without a candidate.
    filter_bits: int = 1 << 25


#: Sketch bits in the first and in the second long of a row; the rest of the second is the word count.
FIRST, SECOND, COUNT_BITS = 64, 52, 12
#: Records handled at once in a task, and min-hash functions worked out at once.
CHUNK, FUNCTIONS = 256, 8


def record_text(title: str, text: str) -> Column:
    """Title, a blank and text; null counts as empty."""
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit("")))


@lru_cache(maxsize=2)
def _multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(seed)
    return g.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), g.integers(0, 2**32, n, dtype=np.uint32)


def _minhash(values: np.ndarray, heads: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(records, n) least hashes; values lie record by record, heads are the records' first positions."""
    a, b = _multipliers(n, seed)
    values = values.astype(np.uint32)
    least = np.empty((n, len(heads)), np.uint32)
    # a few functions at a time over contiguous values: the scratch stays in the cache, and is small for long records
    scratch = np.empty((2, min(n, FUNCTIONS), len(values)), np.uint32)
    for k in range(0, n, FUNCTIONS):
        part = slice(k, min(k + FUNCTIONS, n))
        table, high = scratch[:, : part.stop - k]
        np.multiply(a[part, None], values, out=table)
        table += b[part, None]
        # an affine map alone orders values too regularly; one xor-shift round breaks that
        table ^= np.right_shift(table, np.uint32(15), out=high)
        table *= np.uint32(0x2C1B3C6D)
        np.minimum.reduceat(table, heads, axis=1, out=least[part])
    return least.T


def _words(bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(record number, word hash) of all words of all records, in order."""
    lowered = [b.lower() for b in bodies]
    codes = codepoints("\n".join(lowered) + "\n")
    word = ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    limits = np.cumsum(np.fromiter((len(x) + 1 for x in lowered), np.int64, len(lowered)))
    which = np.searchsorted(limits, starts, side="right")
    return which, mix(span_hash(prefix_hash(codes), starts, ends) ^ (ends - starts).astype(np.uint64))


def signatures(bodies: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(record number, sketch, rest of the sketch and word count, band keys) of the records with enough words.

    The sketch holds one bit of each of 116 min-hashes over the words counted with repetition
    (the n-th occurrence of a word is an element of its own), so two sketches agree in a bit
    with probability (1 + similarity) / 2. Band keys come from word pairs, which chance
    shares far less than words.
    """
    which, words = _words(bodies)
    count = np.bincount(which, minlength=len(bodies))
    keep = count >= max(s.least_words, 2)
    use = keep[which]
    which, words = which[use], words[use]
    if not len(which):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((0, s.bands), np.int64)
    heads = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
    records = which[heads]
    # occurrence number of each word within its record
    order = np.lexsort((words, which))
    sw, sr = words[order], which[order]
    new = np.append(True, (sw[1:] != sw[:-1]) | (sr[1:] != sr[:-1]))
    run = np.flatnonzero(new)
    nth = np.arange(len(sw)) - np.repeat(run, np.diff(np.append(run, len(sw))))
    tokens = mix(sw + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least = _minhash(tokens >> np.uint64(32), heads, FIRST + SECOND, 1)
    bits = (least * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint64)
    sketch = (bits[:, :FIRST] << np.arange(FIRST, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    more = (bits[:, FIRST:] << np.arange(COUNT_BITS, 64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    more |= np.minimum(count[records], (1 << COUNT_BITS) - 1).astype(np.uint64)
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])
    within = which[:-1] == which[1:]
    pw, pairs = which[:-1][within], pairs[within]
    ph = np.flatnonzero(np.append(True, pw[1:] != pw[:-1]))
    mins = _minhash(pairs >> np.uint64(32), ph, s.bands * s.rows, 2).astype(np.uint64).reshape(-1, s.bands, s.rows)
    keys = np.arange(s.bands, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    for r in range(s.rows):
        keys = mix(keys ^ mins[:, :, r]) + mins[:, :, r]
    return records, sketch.view(np.int64), more.view(np.int64), mix(keys).view(np.int64)


@lru_cache(maxsize=8)
def least_matches(similarity: float, miss: float, bits: int) -> int:
    """The fewest agreeing bits of ``bits`` with P(similarity is reached | agreement) >= miss.

    Bits agree with probability (1 + s) / 2; the prior of s is uniform, and the posterior is
    integrated numerically. Agreement below this prunes the pair.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = (1 + s) / 2
    for m in range(bits + 1):
        log = m * np.log(p) + (bits - m) * np.log1p(-p)
        weight = np.exp(log - log.max())
        if weight[s >= similarity].sum() / weight.sum() >= miss:
            return m
    return bits


def survivors(x: np.ndarray, y: np.ndarray, mx: np.ndarray, my: np.ndarray, s: Settings) -> np.ndarray:
    """Positions of the pairs that word counts and, batch by batch, the sketches don't rule out.

    x and y are the first longs of both sides, mx and my the second ones. Counts are capped
    at 4095, which never rules out a pair that the true counts allow.
    """
    cap = np.uint64((1 << COUNT_BITS) - 1)
    nx, ny = (mx & cap).astype(np.int64), (my & cap).astype(np.int64)
    lo, hi = np.minimum(nx, ny), np.maximum(nx, ny)
    at = np.flatnonzero(lo >= s.similarity * hi)  # the similarity can't exceed lo / hi
    differ = x[at] ^ y[at]
    for bits in range(s.batch_bits, FIRST + 1, s.batch_bits):
        mask = np.uint64((1 << bits) - 1)
        ok = bits - np.bitwise_count(differ & mask) >= least_matches(s.similarity, s.miss, bits)
        at, differ = at[ok], differ[ok]
    known = FIRST - np.bitwise_count(differ).astype(np.int64)
    more = (mx[at] ^ my[at]) >> np.uint64(COUNT_BITS)
    for bits in [*range(s.batch_bits, SECOND, s.batch_bits), SECOND]:
        mask = np.uint64((1 << bits) - 1)
        ok = known + bits - np.bitwise_count(more & mask) >= least_matches(s.similarity, s.miss, FIRST + bits)
        at, more, known = at[ok], more[ok], known[ok]
    return at


#: Counters by which a task notices that a band key is frequent, and the id of the row that announces one.
SLOTS, MARK = 1 << 20, -(2**63)


def _band_rows(s: Settings):
    """mapInArrow body: (id, body) -> a row per band; a task sends equal texts once.

    Rows have chunk -1 and are shuffled by key, until the task has counted about ``tile`` rows of a key. From
    then on its rows of that key are numbered by chunks of their own, which spreads them over the shuffle, and a row
    with an id of its own announces them to the bucket. Counters are shared by keys, so a key may be taken for frequent early; that
    changes the way its rows take, not the pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_part = ((TaskContext.get().partitionId() if TaskContext.get() else 0) + 1) << 32
        seen: set[int] = set()
        counts, frequent, turn = np.zeros(SLOTS, np.uint32), {}, 0
        for batch in batches:
            ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if len(seen) > 1_000_000:
                seen.clear()
            fresh = []
            for i, k in enumerate(ids):
                if k not in seen:
                    seen.add(k)
                    fresh.append(i)
            for a in range(0, len(fresh), CHUNK):
                part = fresh[a : a + CHUNK]
                records, sketch, more, keys = signatures([bodies[i] for i in part], s)
                own = np.array([ids[i] for i in part], np.int64)[records]
                keys = keys.ravel()
                slots = keys & (SLOTS - 1)
                hot = np.flatnonzero(counts[slots] > s.tile)
                if turn % 4 == 0:  # every fourth part stands for four
                    np.add.at(counts, slots, 4)
                turn += 1
                chunk = np.full(len(keys), -1, np.int64)
                new = []
                for i, k in zip(hot.tolist(), keys[hot].tolist()):
                    if k not in frequent:
                        new.append(k)
                    frequent[k] = n = frequent.get(k, -1) + 1
                    chunk[i] = own_part + n // s.tile
                columns = [keys, np.repeat(own, s.bands), np.repeat(sketch, s.bands), np.repeat(more, s.bands), chunk]
                if new:
                    marks = [new, [MARK] * len(new), [0] * len(new), [0] * len(new), [-1] * len(new)]
                    columns = [np.concatenate([c, np.array(m, np.int64)]) for c, m in zip(columns, marks)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "sketch", "more", "chunk"])

    return run


_BUCKET = "a long, b long, key long, sketch long, more long, chunk long"


def _bucket_pairs(s: Settings):
    """mapInArrow body over rows sorted by key: surviving pairs, and the members of oversized buckets.

    Pairs have a null key. A bucket of more than ``tile`` records, or with an announcement of further rows, isn't
    compared here; its members pass on, numbered by chunks of ``tile``. Rows that have a chunk already pass on as they are.
    """

    def emit(a, b, key=None, sketch=None, n=None, chunk=None):
        m = len(a)
        null = lambda kind: pa.nulls(m, kind)
        cols = [pa.array(a), pa.array(b) if b is not None else null(pa.int64()), pa.array(key) if key is not None else null(pa.int64()), pa.array(sketch) if key is not None else null(pa.int64()), pa.array(n) if key is not None else null(pa.int64()), pa.array(chunk) if key is not None else null(pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", "key", "sketch", "more", "chunk"])

    def work(key, ids, sketch, n):
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.repeat(np.diff(np.append(heads, len(key))), np.diff(np.append(heads, len(key))))
        some = size > 1
        key, ids, sketch, n = key[some], ids[some], sketch[some], n[some]
        out_a, out_b, d = [], [], 1
        while True:  # neighbours at distance 1, 2, ... within a bucket
            at = np.flatnonzero(key[d:] == key[:-d]) if d < len(key) else []
            if not len(at):
                break
            at = at[ids[at] != ids[at + d]]
            got = at[survivors(sketch[at].view(np.uint64), sketch[at + d].view(np.uint64), n[at].view(np.uint64), n[at + d].view(np.uint64), s)]
            out_a.append(ids[got])
            out_b.append(ids[got + d])
            d += 1
        if not out_a:
            return None
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return emit(both[0], both[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        big, passed = None, 0  # the oversized bucket under way and its members so far
        for batch in batches:
            rows = tuple(batch.column(k).to_numpy() for k in range(5))
            numbered = rows[4] >= 0
            if numbered.any():
                key, ids, sketch, n, chunk = (c[numbered] for c in rows)
                yield emit(ids, None, key, sketch, n, chunk)
                rows = tuple(c[~numbered] for c in rows)
                if not len(rows[0]):
                    continue
            held.append(rows[:4])
            rows = tuple(np.concatenate(c) for c in zip(*held)) if len(held) > 1 else held[0]
            last = rows[0][-1]
            start = int(np.flatnonzero(rows[0] != last)[-1]) + 1 if rows[0][0] != last else 0
            done, tail = tuple(c[:start] for c in rows), tuple(c[start:] for c in rows)
            if len(done[0]):
                yield from finish(done, big, passed)
                big, passed = None, 0
            elif last != big:  # the batch begins with another key: the bucket under way ended at the boundary
                big, passed = None, 0
            if big is None and (len(tail[0]) > s.tile or (tail[1] == MARK).any()):
                big, passed = last, 0
            if big is not None:
                tail = tuple(c[tail[1] != MARK] for c in tail)
                yield emit(tail[1], None, tail[0], tail[2], tail[3], (passed + np.arange(len(tail[0]))) // s.tile)
                passed += len(tail[0])
                held = []
            else:
                held = [tail]
        if held:
            yield from finish(held[0] if len(held) == 1 else tuple(np.concatenate(c) for c in zip(*held)), big, passed)

    def finish(rows, big, passed):
        key, ids, sketch, n = rows
        if big is not None and len(key) and key[0] == big:  # the rest of the bucket under way
            key, ids, sketch, n = (c[(ids != MARK) | (key != big)] for c in rows)
            k = int((key == big).sum())
            yield emit(ids[:k], None, key[:k], sketch[:k], n[:k], (passed + np.arange(k)) // s.tile)
            key, ids, sketch, n = key[k:], ids[k:], sketch[k:], n[k:]
        if not len(key):
            return
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(heads, len(key)))
        large = np.repeat((size > s.tile) | np.logical_or.reduceat(ids == MARK, heads), size)
        if large.any():
            rank = np.arange(len(key)) - np.repeat(heads, size)
            out = large & (ids != MARK)
            yield emit(ids[out], None, key[out], sketch[out], n[out], rank[out] // s.tile)
            key, ids, sketch, n = key[~large], ids[~large], sketch[~large], n[~large]
        if len(key) and (out := work(key, ids, sketch, n)) is not None:
            yield out

    return run


def _tile_pairs(s: Settings):
    """mapInArrow body over rows sorted by tile (key, p, q): every pair of a chunk p and a chunk q row."""

    def flush(rows) -> pa.RecordBatch:
        chunk, ids, sketch, n, p, q = (np.array([r[k] for r in rows]) for k in (3, 4, 5, 6, 1, 2))
        left, right = np.flatnonzero(chunk == p), np.flatnonzero(chunk == q)
        out = [np.zeros((2, 0), np.int64)]
        for i in left:
            to = right[ids[right] > ids[i]] if p[0] == q[0] else right[ids[right] != ids[i]]
            got = to[survivors(np.full(len(to), sketch[i]).view(np.uint64), sketch[to].view(np.uint64), np.full(len(to), n[i]).view(np.uint64), n[to].view(np.uint64), s)]
            out.append(np.stack([np.minimum(ids[i], ids[got]), np.maximum(ids[i], ids[got])]))
        both = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if rows and row[:3] != rows[0][:3]:
                    yield flush(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield flush(rows)

    return run


def candidates(records: DataFrame, s: Settings) -> DataFrame:
    """(a, b), a < b: distinct candidate pairs of record ids. records: (id long, body string)."""
    rows = records.mapInArrow(_band_rows(s), "key long, id long, sketch long, more long, chunk long")
    # a record becomes some four times its bytes; its share of a task stays the same at any size of the table
    sorted_rows = rows.repartition(shuffle_parts(records, 4), "key", "chunk").sortWithinPartitions("key")
    found = cut(sorted_rows.mapInArrow(_bucket_pairs(s), _BUCKET).groupBy("a", "b", "key", "sketch", "more", "chunk").agg(F.count(F.lit(1)).alias("c")).drop("c"))
    big = found.where("key is not null").select("key", "a", "sketch", "more", "chunk")
    chunks = big.select("key", "chunk").distinct()
    # every chunk meets every chunk of its bucket: tile (p, q) has at most 2 * tile rows, which come by chunk, not by key
    tiles = chunks.withColumnRenamed("chunk", "p").join(chunks.withColumnRenamed("chunk", "q"), "key").where("p <= q")
    sides = [big.join(tiles.where(w).withColumn("chunk", F.col(c)), ["key", "chunk"]) for c, w in (("p", "true"), ("q", "p < q"))]
    dealt = sides[0].unionByName(sides[1]).select("key", "p", "q", "chunk", "a", "sketch", "more").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return found.where("key is null").select("a", "b").unionByName(dealt.mapInArrow(_tile_pairs(s), "a long, b long")).distinct()


def wanted_bodies(records: DataFrame, ids: DataFrame, s: Settings) -> DataFrame:
    """(id, body) of the records whose id is in ``ids``, or shares its slot in a bitmap of fixed size.

    The bitmap (filter_bits / 8 bytes, whatever the data) is broadcast. When it fills up, more records pass and the
    join that follows still drops them; nothing is lost.
    """
    shared = records.sparkSession.sparkContext.broadcast(build(ids, "id", s.filter_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            own = batch.column(0).to_numpy()
            hit = np.flatnonzero(holds(shared.value, own))
            if len(seen) > 1_000_000:
                seen.clear()
            take = []
            for i, k in zip(hit.tolist(), own[hit].tolist()):
                if k not in seen:
                    seen.add(k)
                    take.append(i)
            yield batch.take(pa.array(take, pa.int64()))

    return records.mapInArrow(run, "id long, body string")


def multiset_similarity(x: Counter, y: Counter) -> float:
    """Common words counted with repetition over the sum of both counts less the common ones; 0 for no words."""
    common = sum((x & y).values())
    total = x.total() + y.total() - common
    return common / total if total else 0.0


def _verify(s: Settings):
    """mapInArrow body: (a, b, body_a, body_b) -> (a, b, similarity) of the pairs that reach it."""
    import re

    word = re.compile("[a-z0-9]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Counter] = {}

        def bag(key: int, body: str) -> Counter:
            if key not in known:
                if len(known) > 5000:
                    known.clear()
                known[key] = Counter(word.findall(body.lower()))
            return known[key]

        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4))):
                p, q = bag(a, x), bag(b, y)
                common = sum(min(n, q[w]) for w, n in p.items() if w in q)
                total = p.total() + q.total() - common
                if min(p.total(), q.total()) >= s.least_words and common >= s.similarity * total - 1e-9:
                    for col, v in zip(out, (a, b, common / total)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["a", "b", "similarity"])

    return run


def text_pairs(records: DataFrame, s: Settings) -> DataFrame:
    """(a, b, similarity): every verified pair of different texts. records: (id long, body string)."""
    pairs = cut(candidates(records, s))
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    bodies = wanted_bodies(records, ids, s)
    first = bodies.select(F.col("id").alias("a"), F.col("body").alias("body_a"))
    second = bodies.select(F.col("id").alias("b"), F.col("body").alias("body_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "body_a", "body_b").mapInArrow(_verify(s), "a long, b long, similarity double").distinct()


def _records(df: DataFrame, key: str, title: str, text: str, s: Settings) -> DataFrame:
    body = record_text(title, text)
    # n words need at least 2 n - 1 characters of the lower-cased text, which is at most twice as long as the text
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), body.alias("body")).where(2 * F.length("body") >= 2 * s.least_words - 1).withColumn("id", F.xxhash64("body"))


def near_duplicates(df: DataFrame, key: str = "review_id", title: str = "title", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """(key_a, key_b), key_a < key_b: the pairs of records whose words are similar enough.

    Words are the runs of a-z and 0-9 of the lower-cased title, a blank and text (null counts
    as empty); similarity is the number of common words with repetition over the sum of both
    counts less it. Records with fewer than ``least_words`` words or a null key are left out;
    repeated rows of a key count once; word order doesn't matter to the similarity.

    Equal texts collapse to one record (64-bit hash of the text) before anything is
    compared, and come back at the end. Candidates share a band; the sketch rules out most
    of them without their texts; the rest are verified on the words themselves. Bands and
    sketch may miss a few pairs near the limit; the README gives the measured recall.
    """
    s = settings or Settings()
    rows = _records(df, key, title, text, s)
    pairs = text_pairs(spread(rows.select("id", "body")), s)
    members = rows.select("id", "key").distinct()
    x, y = (members.select(F.col("id").alias(c), F.col("key").alias(f"key_{c}")) for c in "ab")
    across = pairs.join(x, "a").join(y, "b").select("key_a", "key_b")
    # words are counted in the copied texts alone
    copied = rows.groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("id")
    copied = cut(copied)
    enough = F.regexp_count(F.lower("body"), F.lit("[a-z0-9]+")) >= s.least_words
    long = wanted_bodies(spread(rows.select("id", "body")), copied, s).where(enough).select("id").distinct()
    same = class_pairs(members.join(copied, "id", "left_semi").join(long, "id", "left_semi"), "id", "key")
    return across.unionByName(same).select(F.least("key_a", "key_b").alias(f"{key}_a"), F.greatest("key_a", "key_b").alias(f"{key}_b")).where(F.col(f"{key}_a") < F.col(f"{key}_b")).distinct()
