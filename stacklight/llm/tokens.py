"""Byte-level BPE of whole texts: boundaries by array scans, cached merging of the pieces."""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .text import codepoints

#: Default folder of the vocabulary files; a parameter everywhere.
FOLDER = os.environ.get("STACKLIGHT_TOKENIZERS", "/opt/tokenizers")
#: Pieces kept with their ids per Python worker; the cache is emptied when full, ids never change.
CACHE = 400_000

# Code point classes.
LETTER, NUMBER, OTHER, BLANK, SPACE = 0, 1, 2, 3, 4
# The code points of Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_classes = np.full(0x110000, 255, np.uint8)
_classes[WHITE_SPACE] = SPACE
_classes[32] = BLANK


def classes_of(codes: np.ndarray) -> np.ndarray:
    """Class of each code point; the table fills as code points turn up."""
    out = _classes[codes]
    if (out == 255).any():
        for c in np.unique(codes[out == 255]).tolist():
            kind = unicodedata.category(chr(c))[0]
            _classes[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
        out = _classes[codes]
    return out


# States after a character: a new piece must begin next; inside a run of letters, numbers or
# others (a blank that leads the next piece counts as begun others until told apart); one or
# two more letters belong to a contraction.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_MORE, TWO_MORE = range(6)
_SHORT = np.array([ONE_MORE, ONE_MORE, ONE_MORE, IN_OTHERS, FRESH, ONE_MORE], np.uint8)
_LONG = np.array([TWO_MORE, TWO_MORE, TWO_MORE, IN_OTHERS, FRESH, ONE_MORE], np.uint8)
_LETTERS = np.array([IN_LETTERS, IN_LETTERS, IN_LETTERS, IN_LETTERS, FRESH, ONE_MORE], np.uint8)


def piece_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sorted starts of all pieces of concatenated texts; ``first`` are the texts' own starts.

    Every character is a function from state to state. Most functions are constant, which
    fixes the state there. Only an apostrophe that could open a contraction, and the letters
    behind it, depend on what came before; those short stretches are composed by an
    associative scan (doubling), so no character is visited one by one.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes_of(codes)
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    # neighbours within the same text
    nxt = np.full(n, 255, np.uint8)
    nxt[:-1] = np.where(opens[1:n], 255, kind[1:])
    prev = np.full(n, 255, np.uint8)
    prev[1:] = np.where(opens[1:n], 255, kind[:-1])
    white = kind >= BLANK
    nxt_white = (nxt == BLANK) | (nxt == SPACE)
    prev_white = (prev == BLANK) | (prev == SPACE)
    nxt_solid = ~nxt_white & (nxt != 255)
    leads = (kind == BLANK) & nxt_solid
    starts = opens[:n].copy()
    # a run of white space is one piece, but its last character stands alone before a solid one
    starts |= white & (~prev_white | nxt_solid)
    # solid characters after a lead blank belong to its piece, after other white space they open one
    after_lead = np.zeros(n, bool)
    after_lead[1:] = leads[:-1]
    solid = ~white
    starts |= solid & prev_white & ~after_lead
    # changes of class inside solid runs
    starts |= solid & ~prev_white & (prev != 255) & (prev != kind)

    # apostrophes before s t m d, or re ve ll
    quote = codes == 39
    if quote.any():
        c1 = np.zeros(n + 2, np.uint32)
        c1[:n] = codes
        same1, same2 = ~opens[1 : n + 1], np.zeros(n, bool)
        same1[n - 1] = False
        same2[: n - 1] = same1[: n - 1] & same1[1:n]
        a, b = c1[1 : n + 1], c1[2 : n + 2]
        short = quote & same1 & np.isin(a, [115, 116, 109, 100])
        long = quote & same2 & (((b == 101) & ((a == 114) | (a == 118))) | ((a == 108) & (b == 108)))
        opener = short | long
        if opener.any():
            depends = opener.copy()
            depends[1:] |= opener[:-1]
            depends[2:] |= long[:-2]
            at = np.flatnonzero(depends)
            maps = np.empty((len(at), 6), np.uint8)
            maps[:] = _LETTERS
            maps[short[at]] = _SHORT
            maps[long[at]] = _LONG
            # the state before each stretch is known
            head = np.ones(len(at), bool)
            head[1:] = at[1:] != at[:-1] + 1
            head |= opens[at]
            before = np.full(len(at), FRESH, np.uint8)
            p = prev[at]
            before[p == LETTER], before[p == NUMBER], before[p == OTHER] = IN_LETTERS, IN_NUMBERS, IN_OTHERS
            before[(p == BLANK) & after_lead[at]] = IN_OTHERS
            maps[head] = maps[head][np.arange(int(head.sum())), before[head]][:, None]
            # prefix composition: after step k each row holds the function of its last 2**k characters
            reach = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            step = 1
            while step <= int(reach.max(initial=0)):
                rows = np.flatnonzero(reach >= step)
                maps[rows] = np.take_along_axis(maps[rows], maps[rows - step].astype(np.intp), 1)
                step *= 2
            after = maps[:, 0]
            prior = np.where(head, before, np.concatenate([[FRESH], after[:-1]]).astype(np.uint8))
            inside = (prior == ONE_MORE) | (prior == TWO_MORE)
            starts[at[inside]] = False
            contraction = opener[at] & (after >= ONE_MORE) & ~inside
            starts[at[contraction]] = True
            # an apostrophe that stays within a run of others, and the letters after a contraction
            fresh = at[after == FRESH] + 1
            fresh = fresh[fresh < n]
            starts[fresh[solid[fresh]]] = True
    return np.flatnonzero(starts)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of least rank is merged, leftmost first, until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here, 0 once merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two parts has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes batches of texts with one vocabulary; pieces already seen are looked up."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.cache: dict[str, list[int]] = {}

    def ids_of(self, piece: str) -> list[int]:
        if (ids := self.cache.get(piece)) is None:
            ids = merge(piece.encode("utf-8"), self.ranks)
            if len(self.cache) >= CACHE:
                self.cache.clear()
            if len(piece) <= 64:
                self.cache[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text as offsets, start in its text of the piece of every id).

        The slices are cut from the joined bytes without a copy and reduced to distinct
        pieces by Arrow's dictionary encoding; only those are looked up or merged.
        """
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        codes = codepoints(joined)
        starts = piece_starts(codes, bounds[:-1][lengths > 0])
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
        width = 1 + (codes > 0x7F).astype(np.int32) + (codes > 0x7FF) + (codes > 0xFFFF)
        byte_at = np.concatenate([[0], np.cumsum(width)])[np.append(starts, len(codes))].astype(np.int32 if joined.isascii() or len(joined) < 500_000_000 else np.int64)
        kind = pa.string() if byte_at.dtype == np.int32 else pa.large_string()
        pieces = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(byte_at), pa.py_buffer(joined.encode("utf-8"))]).dictionary_encode()
        which = pieces.indices.to_numpy()
        known = [self.ids_of(p) for p in pieces.dictionary.to_pylist()]
        size = np.fromiter(map(len, known), np.int64, len(known))
        begin = np.concatenate([[0], np.cumsum(size)])
        pool = np.fromiter((i for ids in known for i in ids), np.int32, int(begin[-1]))
        counts = size[which]
        total = np.concatenate([[0], np.cumsum(counts)])
        flat = pool[np.arange(total[-1]) + np.repeat(begin[which] - total[:-1], counts)]
        cuts = total[np.searchsorted(starts, bounds)]
        at = np.repeat(starts, counts) - np.repeat(bounds[:-1], np.diff(cuts))
        return flat, cuts, at


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _chunks(values: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters, so a batch of long texts stays small in memory."""
    a, have = 0, 0
    for i, v in enumerate(values):
        have += len(v)
        if have >= most:
            yield a, i + 1
            a, have = i + 1, 0
    if a < len(values):
        yield a, len(values)


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, offsets: bool = False) -> DataFrame:
    """(key, ids array<int>[, offsets array<int>]): every row's token ids, without special tokens.

    Null and empty texts give an empty list. ``offsets`` are the code point at which the piece
    of each id starts. Rows stay where they lie: no shuffle, one pass, any text length.
    """
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            keys = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                flat, cuts, at = enc.encode(texts[a:b])
                arrays = [keys.slice(a, b - a), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32()))]
                if offsets:
                    arrays.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(at, pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, [key, "ids", "offsets"][: 2 + offsets])

    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, ids array<int>" + ", offsets array<int>" * offsets
    return spread(documents.select(key, text)).mapInArrow(run, schema)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, text): the inverse of ``encode``; an empty or null list gives the empty text.

    Bytes that are no UTF-8 become the replacement character; unknown ids are an error.
    """
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {v: k for k, v in load_ranks(path).items()}
        for batch in batches:
            texts = [b"".join(parts[i] for i in row or []).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, text string")
