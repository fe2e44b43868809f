"""Personal information in free text: candidate spans, boosted trees, calibrated redaction."""

from __future__ import annotations

import hashlib
import inspect
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .boosting import Boosted
from .pii_spans import KINDS, Span, Words, around, features, propose
from .pii_training import labelled

#: Generated texts the classifier is trained on (about six candidates each); the bound of its sample.
TRAINING_TEXTS = 12000
#: A word is ordinary if at least this share of the distinct texts (and five of them) use it. With an average
#: of w distinct words a text, at most w / ORDINARY_SHARE words can be: the bound of what is broadcast.
ORDINARY_SHARE = 0.0015


@dataclass(frozen=True)
class Model:
    trees: Boosted
    thresholds: tuple[float, ...]


def fit(n_texts: int, seed: int) -> Model:
    """Fit on generated texts; calibrate and set each kind's threshold on others that took no part.

    The threshold of a kind is the probability with the best F1 on the held-out texts.
    """
    none: frozenset[str] = frozenset()
    x, y, _ = labelled(n_texts, seed, none, mixed=True)
    trees = Boosted().fit(x, y)
    x, y, kinds = labelled(max(n_texts // 2, 200), seed + 1, none, mixed=True)
    trees.calibrate(x, y)
    p, limits = trees.probability(x), []
    for k in range(len(KINDS)):
        pk, yk = p[kinds == k], y[kinds == k]
        grid = np.linspace(0.2, 0.8, 25)
        scores = [2 * (yk * (pk >= t)).sum() / max((pk >= t).sum() + yk.sum(), 1) for t in grid]
        best = [t for t, f in zip(grid, scores) if f >= max(scores) - 1e-9]
        limits.append(float(best[len(best) // 2]))
    return Model(trees, tuple(limits))


#: The fitted model, kept with the code that made it: written by ``python -m stacklight.llm.pii``.
STORED = Path(__file__).with_name("pii_model.json")


def fingerprint(n_texts: int, seed: int) -> str:
    """Of all that decides the fit: training sentences, candidates, features, trees and settings."""
    parts = [Path(__file__).with_name(f"{name}.py").read_bytes() for name in ("boosting", "pii_spans", "pii_training")]
    return hashlib.sha256(b"\0".join([*parts, inspect.getsource(fit).encode(), f"{n_texts} {seed}".encode()])).hexdigest()


@lru_cache(maxsize=2)
def train(n_texts: int = TRAINING_TEXTS, seed: int = 11) -> Model:
    """The stored model if it was made by this code with these settings, else a fresh fit: both are the same."""
    if STORED.exists():
        kept = json.loads(STORED.read_text())
        if kept["fingerprint"] == fingerprint(n_texts, seed):
            trees = Boosted(depth=kept["depth"])
            trees.bias, trees.scale = kept["bias"], tuple(kept["scale"])
            trees.trees = [(np.array(f, np.int64), np.array([np.inf if c is None else c for c in cut_]), np.array(v)) for f, cut_, v in kept["trees"]]
            return Model(trees, tuple(kept["thresholds"]))
    return fit(n_texts, seed)


def store(n_texts: int = TRAINING_TEXTS, seed: int = 11) -> None:
    model = fit(n_texts, seed)
    trees = [[f.tolist(), [None if np.isinf(c) else float(c) for c in cut_], v.tolist()] for f, cut_, v in model.trees.trees]
    kept = {"fingerprint": fingerprint(n_texts, seed), "depth": model.trees.depth, "bias": model.trees.bias, "scale": model.trees.scale, "thresholds": model.thresholds, "trees": trees}
    STORED.write_text(json.dumps(kept) + "\n")


def select(spans: list[Span], probability: np.ndarray, thresholds: tuple[float, ...]) -> list[tuple[Span, float]]:
    """Of the candidates over their threshold, the surest first and no two that overlap; the longer on ties."""
    order = sorted(range(len(spans)), key=lambda i: (-round(float(probability[i]), 2), -(spans[i].end - spans[i].start), spans[i].start))
    chosen: list[tuple[int, int, int]] = []  # (start, end, number), sorted and free of overlaps
    for i in order:
        s = spans[i]
        if probability[i] < thresholds[KINDS.index(s.kind)]:
            continue
        at = bisect_left(chosen, (s.start, s.end, -1))
        if (at == 0 or chosen[at - 1][1] <= s.start) and (at == len(chosen) or chosen[at][0] >= s.end):
            chosen.insert(at, (s.start, s.end, i))
    return [(spans[i], float(probability[i])) for _, _, i in chosen]


def find_in(texts: list[str | None], words: Words, model: Model) -> list[list[tuple[Span, float]]]:
    """Chosen spans of every text; the candidates of all texts are scored at once."""
    proposed = [propose(t, words) if t else [] for t in texts]
    rows = [features(t, s, near, words) for t, spans in zip(texts, proposed) for s, near in zip(spans, around(spans))]
    p = model.trees.probability(np.array(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for spans in proposed:
        out.append(select(spans, p[at : at + len(spans)], model.thresholds))
        at += len(spans)
    return out


_WORD = re.compile(r"[^\W\d_]++(?:['’\-‐‑][^\W\d_]++)*+")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per word and those that have it in lower case, summed in the task; the null word counts all texts."""
    seen: Counter[str | None] = Counter()
    high: Counter[str] = Counter()  # texts that have the word, but not in lower case

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([0 if w is None else seen[w] - high[w] for w in seen], pa.int64())], ["word", "n", "low"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            used = set(_WORD.findall(text))
            lowered = set(map(str.lower, used))
            seen.update(lowered)
            high.update(lowered - used)
            seen[None] += 1
        if len(seen) > 500_000:
            yield flush()
            seen.clear()
            high.clear()
    yield flush()


def word_use(df: DataFrame, text: str, share: float = ORDINARY_SHARE) -> tuple[frozenset[str], frozenset[str]]:
    """(words that at least ``share`` of the distinct non-null texts, and five, use; those of them mostly capitalised).

    All texts count, but copies and redelivered rows only once, so that a copied name doesn't become ordinary.
    """
    docs = spread(df.where(F.col(text).isNotNull()).select(text)).distinct()
    counts = cut(docs.mapInArrow(_count_words, "word string, n long, low long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("low").alias("low")))
    total = sum(r["n"] for r in counts.where("word is null").collect())
    rows = counts.where(F.col("word").isNotNull() & (F.col("n") >= 5) & (F.col("n") >= share * total)).collect()
    return frozenset(r["word"] for r in rows), frozenset(r["word"] for r in rows if 2 * r["low"] < r["n"])


def ordinary_words(df: DataFrame, text: str, share: float = ORDINARY_SHARE) -> frozenset[str]:
    """Words that at least ``share`` of the distinct non-null texts, and five, use."""
    return word_use(df, text, share)[0]


def personal_information(df: DataFrame, key: str = "review_id", text: str = "text", n_texts: int = TRAINING_TEXTS) -> DataFrame:
    """(key, pii_kind, pii_text, start, end, probability): every span selected for redaction.

    Offsets are code points of the text. Null and empty texts have none; rows with a null key
    are kept under null. Rows stay where they lie but for the word counts, for which equal texts
    are brought together first.
    """
    shared = df.sparkSession.sparkContext.broadcast((word_use(df, text), train(n_texts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, model = shared.value
        words = Words(*use)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(k, s.kind, t[s.start : s.end], s.start, s.end, p) for k, t, found in zip(keys, texts, find_in(texts, words, model)) for s, p in found]
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [key, "pii_kind", "pii_text", "start", "end", "probability"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, pii_kind string, pii_text string, `start` long, `end` long, probability double")


def redact(df: DataFrame, key: str = "review_id", text: str = "text", n_texts: int = TRAINING_TEXTS) -> DataFrame:
    """(key, redacted): each text with its spans replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME].

    One row per input row; null stays null; texts without personal information are unchanged.
    """
    shared = df.sparkSession.sparkContext.broadcast((word_use(df, text), train(n_texts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, model = shared.value
        words = Words(*use)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = []
            for t, found in zip(texts, find_in(texts, words, model)):
                for s, _ in reversed(found):
                    t = f"{t[: s.start]}[{s.kind.upper()}]{t[s.end :]}"
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "redacted"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, redacted string")


if __name__ == "__main__":
    from stacklight.llm import pii

    pii.store()
