"""Listings of the same product: bipartite term-pair reinforcement, threshold, clusters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import class_pairs, split_join
from ..session import cut, forget, spread
from .listing_terms import Phrases, listing, ngrams, whole_phrases


@dataclass(frozen=True)
class Settings:
    #: A pair whose every difference is explained to at least this degree is a match.
    threshold: float = 0.5
    #: Share of its pairs at which a wording counts as half explained by another, and weight at which a word counts as half binding.
    alias_half: float = 0.12
    weight_half: float = 0.5
    #: Pairs of doubt added to every share.
    doubt: float = 2.0
    #: The rounds end when no term weight moves by more than this; if ``rounds`` don't suffice, that is an error.
    tolerance: float = 0.01
    rounds: int = 40
    #: A phrase enters the vocabulary if at least this share of the listings state it; so it holds at most about 10 / share phrases.
    phrase_share: float = 5e-5
    #: Words of titles are one phrase if they occur this often, and a side of it in this share of its occurrences.
    support: int = 5
    together: float = 0.3
    #: A word one slip away from another that is at least this many times as frequent is a misspelling of it.
    slip_ratio: int = 10
    #: Millimetres by which lengths of one product may differ (rounding to a tenth of an inch).
    slack: float = 1.3


#: Share of the rows from which a block or class is cut into parts.
HOT = 0.005
#: Facing phrases that are looked at together, which bounds the memory.
FACINGS = 1 << 20

_READ = "key string, length double, pieces int, size string, runs array<string>, said array<string>"
_TERMS = "key string, length double, pieces int, size string, phrases array<string>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text = pa.list_(pa.string())
    for batch in batches:
        told = [listing(t, d) for t, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        columns = [
            batch.column(0), pa.array([m.length for m, _, _ in told], pa.float64()), pa.array([m.pieces for m, _, _ in told], pa.int32()),
            pa.array([m.size for m, _, _ in told], pa.string()), pa.array([r for _, r, _ in told], text), pa.array([s for _, _, s in told], text),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["key", "length", "pieces", "size", "runs", "said"])


def _sequences(vocabulary):
    """mapInArrow body: (phrase, n), the word sequences in what stated phrases leave of titles, counted per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, seen = Phrases(vocabulary.value), Counter()
        for batch in batches:
            for told in batch.column(0).to_pylist():
                seen.update(gram for run in told for rest in phrases.rest(run) for gram in ngrams(rest))
            if len(seen) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["phrase", "n"])
                seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["phrase", "n"])

    return run


def _split(vocabulary):
    """mapInArrow body: the distinct phrases of a listing, in order of their letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(vocabulary.value)
        for batch in batches:
            found = [sorted({p for run in [*r, *s] for p, _ in phrases.split(run)}) for r, s in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(pa.string()))], ["key", "length", "pieces", "size", "phrases"])

    return run


def listing_terms(listings: DataFrame, key: str, title: str, description: str, s: Settings) -> DataFrame:
    """(key, length, pieces, size, phrases) of every listing with a key.

    Phrases of several words come from the listings themselves: values stated in descriptions, and sequences of
    title words between those that belong together. Both lists hold only phrases with ``phrase_share``
    of the listings, so what the driver collects and broadcasts is bounded at any size.
    """
    spark = listings.sparkSession
    some = listings.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(title).alias("t"), F.col(description).alias("d"))
    told = cut(spread(some).mapInArrow(_read, _READ))
    least = s.phrase_share * told.count()
    stated = told.select(F.explode("said").alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    said = {r["phrase"] for r in stated.where("length(phrase) - length(replace(phrase, ' ', '')) < 4").collect()}
    shared = spark.sparkContext.broadcast(said)
    counted = told.select("runs").mapInArrow(_sequences(shared), "phrase string, n long").groupBy("phrase").agg(F.sum("n").alias("n"))
    counts = {r["phrase"]: r["n"] for r in counted.where(F.col("n") >= max(least, s.support)).collect()}
    known = spark.sparkContext.broadcast({p for p in said | whole_phrases(counts, s.together) if " " in p})
    return told.mapInArrow(_split(known), _TERMS)


def learning_pairs(forms: DataFrame, df: DataFrame) -> DataFrame:
    """(a, b), a < b: all the pairs of forms that are equal in measures (lengths to the centimetre) and in one of their three rarest shared phrases, each once.

    The forms with measures and a rare phrase in common are a block; a heavy block is met in tiles, so no task has one
    whole. Pairs grow with the square of a block. forms: (form, length, pieces, size, ids).
    """
    rare = (
        forms.select("form", "length", "pieces", "size", F.explode("ids").alias("id")).join(df.where("n > 1"), "id")
        .groupBy("form").agg(F.first("length").alias("length"), F.first("pieces").alias("pieces"), F.first("size").alias("size"), F.slice(F.array_sort(F.collect_list(F.struct("n", "id"))), 1, 3).alias("rare"))
    )
    keyed = rare.select("form", F.explode("rare.id").alias("id"), "length", "pieces", "size").select("form", F.xxhash64("id", F.round(F.col("length") / 10), "pieces", "size").alias("block"))
    return class_pairs(keyed, "block", "form", HOT).select(F.col("form_a").alias("a"), F.col("form_b").alias("b")).distinct()


def _hill(value: np.ndarray, half: float) -> np.ndarray:
    return value**3 / (value**3 + half**3)


@dataclass(frozen=True)
class Vocabulary:
    """Phrases by number: sorted ids, and how many forms hold each. Any other phrase has the number -1."""

    ids: np.ndarray
    n: np.ndarray

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        return _places(self.ids, ids)


def _places(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value stands in a sorted array, -1 if it doesn't."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _numbered(vocabulary):
    """mapInArrow body: the phrases of pairs by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for column in batch.columns:
                offsets, values = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
                out.append(pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(vocabulary.value.numbers(values), pa.int32())))
            yield pa.RecordBatch.from_arrays(out, ["s", "u", "v"])

    return run


class _Pairs:
    """A batch of pairs, flattened: shared phrases, and phrases of one side (those of u, then those of v)."""

    def __init__(self, batch: pa.RecordBatch):
        s, u, v = ((c.offsets.to_numpy(), c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)) for c in batch.columns)
        rows = np.arange(batch.num_rows)
        n_s, n_u, n_v = (np.diff(o) for o, _ in (s, u, v))
        self.n = batch.num_rows
        self.shared, self.shared_row = s[1], np.repeat(rows, n_s)
        self.alone, self.alone_row = np.concatenate([u[1], v[1]]), np.concatenate([np.repeat(rows, n_u), np.repeat(rows, n_v)])
        self.first = (3 + n_s) / (3 + n_s + np.maximum(n_u, n_v))
        known = np.flatnonzero(self.alone >= 0)
        self.left_known, self.right_known = known[known < len(u[1])], known[known >= len(u[1])]
        rights = np.bincount(self.alone_row[self.right_known], minlength=self.n)
        row = self.alone_row[self.left_known]
        self.width, self.start = rights[row], (np.cumsum(rights) - rights)[row]

    def facings(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of phrases of u, places of phrases of v, codes): every known phrase of u beside every known one of v, about ``FACINGS`` at a time."""
        part = (np.cumsum(self.width) - self.width) // FACINGS
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            width = self.width[lo:hi]
            left = np.repeat(self.left_known[lo:hi], width)
            within = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width)
            right = self.right_known[np.repeat(self.start[lo:hi], width) + within]
            x, y = self.alone[left], self.alone[right]
            yield left, right, np.minimum(x, y) * size + np.maximum(x, y)


def _facings(size: int):
    """mapInArrow body: (code, n), how often two phrases face each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, code in _Pairs(batch).facings(size):
                codes, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

    return run


def _contributions(state, size: int, s: Settings):
    """mapInArrow body: (term, agree, hold, lack, face) summed over the task's pairs; facing phrases follow the single ones.

    state: (sorted codes of facing phrases, weights of phrases, shares of facing phrases), the last two None at first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, weights, shares = state.value
        sums = np.zeros((4, size + len(codes)))
        for batch in batches:
            p = _Pairs(batch)
            found = [np.zeros((3, 0), np.int64)]
            for left, right, code in p.facings(size):
                term = _places(codes, code)
                found.append(np.stack([left, right, term])[:, term >= 0])
            left, right, term = np.concatenate(found, axis=1)
            row = p.alone_row[left]
            e = np.zeros(len(p.alone))
            if weights is None:
                score, alone = p.first, p.first[p.alone_row]
                face = p.first[row]
            else:
                degree = _hill(shares, s.alias_half)[term]
                np.maximum.at(e, left, degree)
                np.maximum.at(e, right, degree)
                binding = np.where(p.alone >= 0, _hill(weights, s.weight_half)[p.alone], _hill(np.ones(1), s.weight_half))
                f = 1 - binding * (1 - e)
                # the three least explained differences of every pair
                order = np.lexsort((f, p.alone_row))
                place = np.arange(len(order)) - np.searchsorted(p.alone_row[order], p.alone_row[order])
                lows = np.ones((3, p.n))
                for k in range(3):
                    at = order[place == k]
                    lows[k, p.alone_row[at]] = f[at]
                score = lows[0]
                low, second, third = lows[:, p.alone_row]
                alone = np.where(f <= low, second, low)
                low, second, third = lows[:, row]
                fu, fv = f[left], f[right]
                face = np.where(np.maximum(fu, fv) <= second, third, np.where(np.minimum(fu, fv) <= low, second, low))
            lack = alone.copy()
            np.maximum.at(lack, left, face)
            np.maximum.at(lack, right, face)
            both, one = p.shared >= 0, p.alone >= 0
            for k, (of_shared, of_alone) in enumerate(((score, alone * e), (score, alone), (score, lack))):
                sums[k, :size] += np.bincount(p.shared[both], of_shared[p.shared_row[both]], size) + np.bincount(p.alone[one], of_alone[one], size)
            sums[3, size:] += np.bincount(term, face, len(codes))
        some = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c[some]) for c in sums)], ["term", "agree", "hold", "lack", "face"])

    return run


def reinforce(pairs: DataFrame, forms: DataFrame, phrases: DataFrame, s: Settings) -> tuple[Vocabulary, np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary, weights, facing pairs as (2, n) numbers, shares), from alternate updates until they rest.

    A pair's score is the least of its differences' explanations: a phrase that only one side has is explained by a
    phrase that only the other has, as far as the two stand for each other, or by its own lack of weight. A phrase's
    weight is the part of the score of all pairs that hold it which falls to pairs where both sides have it or its
    counterpart; slogans fade, words that good pairs share stay. How far two phrases stand for each other is
    the part of the score of all pairs that hold the commoner one which falls to pairs where they face each other.
    Every update leaves the difference in question out of the score it uses.

    The terms are the phrases that ``phrase_share`` of the forms hold (at least two), and their facings that as large a
    share of the pairs show. So all the terms together are at most about 30 / phrase_share, whatever the data; they are
    joined to the pairs by number once, and after that only their weights travel: out by broadcast, back as
    sums that each task has added up. Rarer phrases bind fully and stand for nothing. pairs: (a, b); forms: (form, ids); phrases: (id, n).
    """
    spark = pairs.sparkSession
    kept = phrases.where(F.col("n") >= max(2.0, s.phrase_share * forms.count())).select("id", "n").toPandas().sort_values("id")
    vocabulary = Vocabulary(kept["id"].to_numpy(np.int64), kept["n"].to_numpy(np.int64))
    size = len(vocabulary.ids)
    x, y = (forms.select(F.col("form").alias(c), F.col("ids").alias(f"i{c}")) for c in "ab")
    sides = pairs.join(x, "a").join(y, "b").select(F.array_intersect("ia", "ib").alias("s"), F.array_except("ia", "ib").alias("u"), F.array_except("ib", "ia").alias("v"))
    base = cut(sides.mapInArrow(_numbered(spark.sparkContext.broadcast(vocabulary)), "s array<int>, u array<int>, v array<int>"))
    counted = base.mapInArrow(_facings(size), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    # a single meeting gives a share of nought whatever its score
    codes = np.sort(counted.where(F.col("n") >= max(2.0, s.phrase_share * base.count())).select("code").toPandas()["code"].to_numpy(np.int64))
    at = np.stack([codes // max(size, 1), codes % max(size, 1)])

    def update(weights: np.ndarray | None, shares: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        state = spark.sparkContext.broadcast((codes, weights, shares))
        rows = base.mapInArrow(_contributions(state, size, s), "term long, agree double, hold double, lack double, face double")
        got = rows.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("agree", "hold", "lack", "face")]).toPandas()
        state.destroy()
        sums = np.zeros((4, size + len(codes)))
        sums[:, got["term"].to_numpy(np.int64)] = got[["agree", "hold", "lack", "face"]].to_numpy().T
        agree, hold, lack = sums[:3, :size]
        face = sums[3, size:]
        return (agree + s.doubt) / (hold + s.doubt), np.maximum((face - np.sqrt(face) / 2 - 1) / (lack[at].max(axis=0) + s.doubt) if len(codes) else face, 0.0)

    weights, shares = update(None, None)
    for _ in range(s.rounds):
        new_weights, new_shares = update(weights, shares)
        # half way to the update, so that two terms cannot swap their values for ever
        new_weights, new_shares = (weights + new_weights) / 2, (shares + new_shares) / 2
        moved = max(np.abs(new_weights - weights).max(initial=0.0), np.abs(new_shares - shares).max(initial=0.0))
        weights, shares = new_weights, new_shares
        if moved <= s.tolerance:
            break
    else:
        raise RuntimeError(f"a term weight still moved by more than {s.tolerance} after {s.rounds} rounds; allow more")
    forget(base)
    return vocabulary, weights, at, shares


def united(vocabulary: Vocabulary, weights: np.ndarray, at: np.ndarray, shares: np.ndarray, s: Settings) -> list[tuple[int, int, bool]]:
    """(id, class, fades) of the phrases that change: their class is the least id of the connected wordings; a class fades with its commonest wording."""
    up = np.arange(len(vocabulary.ids))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in at[:, _hill(shares, s.alias_half) >= s.threshold].T.tolist():
        i, j = find(i), find(j)
        up[max(i, j)] = min(i, j)
    classes = np.array([find(i) for i in range(len(up))], np.int64)
    lead: dict[int, int] = {}
    for i in np.lexsort((vocabulary.ids, vocabulary.n)).tolist():
        lead[int(classes[i])] = i
    fades = _hill(weights, s.weight_half) < s.threshold
    return [(int(vocabulary.ids[i]), int(vocabulary.ids[c]), bool(fades[lead[int(c)]])) for i, c in enumerate(classes) if c != i or fades[lead[int(c)]]]


def misspelled(phrases: DataFrame, s: Settings) -> DataFrame:
    """(u, v): phrases u of 5 to 64 letters and the most frequent v one slip away that is ``slip_ratio`` times as frequent.

    A slip loses, adds, changes or moves one letter, so both keep a form with one letter taken out (or none); they meet
    in a join on those forms, which grows with the distinct phrases. phrases: (id, phrase, n).
    """
    some = phrases.where("length(phrase) between 5 and 64")
    shorn = "transform(sequence(0, length(phrase)), i -> xxhash64(if(i = 0, phrase, concat(substring(phrase, 1, i - 1), substring(phrase, i + 1)))))"
    keyed = some.select("id", "n", F.explode(F.array_distinct(F.expr(shorn))).alias("form"))
    most = keyed.groupBy("form").agg(F.max_by("id", F.struct("n", "id")).alias("v"), F.max("n").alias("nv"))
    met = keyed.join(most, "form").where(F.col("nv") >= s.slip_ratio * F.col("n"))
    return met.groupBy(F.col("id").alias("u")).agg(F.max_by("v", F.struct("nv", "v")).alias("v"))


def same_product(listings: DataFrame, key: str = "parent_asin", title: str = "title", description: str = "description", settings: Settings | None = None) -> DataFrame:
    """(key, product): the class of every listing with a key; a class's name is a number that only means identity.

    Rows with a null key are left out; repeated rows and repeated keys are allowed (a key whose rows differ may lie in
    two classes). Null, empty and long titles and descriptions are read whole; listings that tell nothing are one class.

    Listings become measures and phrases. Reinforcement over pairs of like listings learns which phrases stand for each
    other and which bind at all. Two listings match if every difference between them is explained to ``threshold``; as
    a pair's score is its least explained difference, that is the case just where both reduce to the same
    phrases once explained wordings are united (connected components of wordings) and fading phrases dropped. So clusters come
    from one grouping on the reduced listing, linear in the rows; lengths within ``slack`` of the next are one.
    """
    s = settings or Settings()
    told = cut(listing_terms(listings, key, title, description, s).withColumn("ids", F.expr("transform(phrases, p -> xxhash64(p))")).withColumn("form", F.xxhash64("length", "pieces", "size", "ids")))
    forms = told.groupBy("form").agg(F.first("length").alias("length"), F.first("pieces").alias("pieces"), F.first("size").alias("size"), F.first("ids").alias("ids"), F.first("phrases").alias("phrases"))
    forms = cut(forms)
    phrases = cut(forms.select(F.explode(F.arrays_zip("ids", "phrases")).alias("p")).groupBy(F.col("p.ids").alias("id")).agg(F.first("p.phrases").alias("phrase"), F.count(F.lit(1)).alias("n")))
    learned = reinforce(learning_pairs(forms.select("form", "length", "pieces", "size", "ids"), phrases.select("id", "n")), forms, phrases.select("id", "n"), s)
    change = forms.sparkSession.createDataFrame(united(*learned, s), "id2 long, to long, fades boolean")  # no more rows than the vocabulary
    slips = cut(misspelled(phrases, s).withColumnRenamed("u", "id"))
    right = split_join(forms.select("form", "length", "pieces", "size", F.explode_outer("ids").alias("id")), slips, "id", "left").withColumn("id2", F.coalesce("v", "id"))
    reduced = (
        right.join(F.broadcast(change), "id2", "left")
        .groupBy("form").agg(F.first("length").alias("length"), F.first("pieces").alias("pieces"), F.first("size").alias("size"), F.array_sort(F.collect_set(F.when(~F.coalesce("fades", F.lit(False)), F.coalesce("to", "id2")))).alias("ids"))
        .select("form", "length", F.xxhash64("ids", "pieces", "size").alias("rest"))
    )
    reduced = cut(reduced)
    lengths = reduced.select("rest", "length").distinct()
    here = "PARTITION BY rest ORDER BY length"
    steps = lengths.withColumn("step", F.expr(f"if(length - lag(length) OVER ({here}) <= {s.slack}, 0, 1)"))
    product = steps.select("rest", "length", F.xxhash64("rest", F.expr(f"sum(step) OVER ({here})")).alias("product"))
    classed = reduced.join(product, (reduced["rest"] == product["rest"]) & reduced["length"].eqNullSafe(product["length"])).select("form", "product")
    return told.select(F.col("key").alias(key), "form").join(classed, "form").select(key, "product").distinct()


def product_pairs(classes: DataFrame, key: str = "parent_asin") -> DataFrame:
    """(key_a, key_b), key_a < key_b by code points: every pair of different keys of one class."""
    return class_pairs(classes, "product", key, HOT).distinct()
