import random
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stacklight.llm import components, listing_terms, neardup, products


# --- components --------------------------------------------------------------


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    g = random.Random(seed)
    edges = [(g.randrange(60), g.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(30)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3), (3, None), edges[0]], "a long, b long")
    want = union_find([e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["class"] for r in components.components(df).collect()} == want
    assert components.components(df.limit(0)).count() == 0


# --- listings ----------------------------------------------------------------

# an invented vocabulary: no word of it occurs in the test tables
GARMENTS = [["zorp", "zorp coat"], ["flim", "long flim"], ["quib"], ["dask", "open dask", "round dask"], ["mulk", "twin mulk"], ["sneve"], ["grolt", "flat grolt"], ["prand"]]
SHADES = [["vosk", "pale vosk"], ["jurn", "deep jurn", "jrn"], ["wexel"], ["oblin", "oblin tint"], ["kref", "mirek"], ["tolva"], ["hasp", "bosp"], ["yint", "cold yint"]]
MAKERS = ["Ackerby", "Brontel Lane", "Cuvick", "Dorset Quo", "Eltham & Ruse", "Fennick", "Gorm Supply", "Hexley", "Isko", "Jantry", "Kolb", "Lummoth", "Morvane", "Nubbin Co", "Ostrel", "Pavick"]
SLOGANS = ["buy now", "star pick", "mega deal", "wow", "last chance", "editors love it", "one of a kind", "just in", "our choice", "back again"]


def catalogue(seed, products_wanted=900):
    g = random.Random(seed)
    ranges = ["".join(g.choice("bdfglmnprstv") + g.choice("aeiou") for _ in range(4)) + g.choice("klnrs") for _ in range(12)]
    rows, truth = [], {}
    made = []
    for _ in range(products_wanted):
        if made and g.random() < 0.3:  # another product that differs in one thing
            p = list(g.choice(made))
            i = g.randrange(6)
            p[i] = [g.randrange(len(MAKERS)), g.choice(ranges), g.randrange(len(GARMENTS)), g.randrange(len(SHADES)), g.randrange(30, 110), g.choice("SML")][i]
        else:
            p = [g.randrange(len(MAKERS)), g.choice(ranges), g.randrange(len(GARMENTS)), g.randrange(len(SHADES)), g.randrange(30, 110), g.choice("SML")]
        made.append(p)
    for p in dict.fromkeys(map(tuple, made)):
        for _ in range(g.randrange(1, 5)):
            at = g.randrange(1, 7)
            name = p[1] if g.random() < 0.95 else p[1][:at] + p[1][at + 1] + p[1][at] + p[1][at + 2 :]
            length = g.choice([f"{p[4]} cm", f"{p[4] * 10}mm", f"{p[4] / 2.54:.1f} inches"])
            size = {"S": ["S", "Small"], "M": ["M", "Medium"], "L": ["Size: L", "Large"]}[p[5]]
            shade, words = g.choice(SHADES[p[3]]), [f"{name} {g.choice(GARMENTS[p[2]])}", length]
            said = []
            (words if g.random() < 0.5 else said).append(shade)
            words.append(g.choice(size))
            words += g.sample(SLOGANS, g.randrange(0, 3))
            g.shuffle(words)
            said = [g.choice([f"Shade: {x}", f"{x} (shade)", f"<ul><li>Shade {x}</li></ul>"]) for x in said]
            key = f"k{len(rows):05}"
            rows.append((key, f"{MAKERS[p[0]]} " + g.choice([" - ", " / ", ", "]).join(words), [*said, "Dry in the shade, never in the sun."]))
            truth.setdefault(p, []).append(key)
    return rows, {(a, b) for keys in truth.values() for a, b in combinations(sorted(keys), 2)}


@pytest.fixture(scope="module")
def classed(spark):
    rows, want = catalogue(3)
    odd = [(None, rows[0][1], None), ("zz1", None, None), ("zz2", "", [""]), ("zz3", "word " * 3000, [None]), rows[0]]
    df = spark.createDataFrame([*rows, *odd], "parent_asin string, title string, description array<string>").withColumn("key", F.lit(1)).withColumn("form", F.lit("x"))
    return df, products.same_product(df).cache(), want


def test_wordings_are_learned_from_the_listings_alone(classed):
    _, found, want = classed
    got = {tuple(r) for r in products.product_pairs(found).collect()} - {("zz1", "zz2")}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.95 * len(got)


def test_listings_without_words_and_tables_without_rows(spark, classed):
    df, found, _ = classed
    classes = {r["parent_asin"]: r["product"] for r in found.collect()}
    assert None not in classes and classes["zz1"] == classes["zz2"] != classes["zz3"]
    assert products.product_pairs(products.same_product(df.limit(0))).count() == 0


def test_pairs_of_a_hot_class_come_from_tiles(spark):
    df = spark.createDataFrame([(1, f"k{i:04}") for i in range(1500)] + [(2, "x"), (2, "y")], "product long, parent_asin string")
    got = products.product_pairs(df)
    assert got.count() == 1500 * 1499 // 2 + 1 and got.distinct().count() == got.count()


def test_scores_decide(spark, classed):
    """Without a threshold on the learned degrees everything that ever faced each other would be one product."""
    df, _, want = classed
    loose = {tuple(r) for r in products.product_pairs(products.same_product(df, settings=products.Settings(threshold=0.0))).collect()}
    assert len(loose & want) < 0.5 * len(loose)


def test_measures_and_statements():
    told, title, said = listing_terms.listing("Wickerman zq 5301 EU 42 Pack of 5 Hot Sale, 21.7 in", ["39 (depth)", "0.55 m (length)", "Shade: Pale Vosk", "See our other goods."])
    assert (told.length, told.pieces, told.size) == (551.18, 5, "42") and title == ["wickerman", "hot sale"] and said == ["depth 39", "pale vosk"]
    told, title, said = listing_terms.listing("a One-Piece Suit x3", ["As follows: XX-Large; Ladies; Shade: Mirek; 8.7\".", "<ul><li>Pack 5pk</li></ul>"])
    assert (told.length, told.pieces, told.size) == (220.98, 3, "2xl") and title == ["a onecut suit"] and said == ["ladies", "mirek"]
    told, title, said = listing_terms.listing(None, None)
    assert (told.length, told.pieces, told.size, title, said) == (None, 1, None, [], [])


def test_words_that_belong_together():
    counts = {"long flim": 9, "long": 9, "flim": 20, "tadak flim": 5, "tadak": 40, "rare pair": 2}
    assert listing_terms.whole_phrases(counts, 0.3) == {"long flim", "rare pair"}


def test_misspelled_words(spark):
    phrases = spark.createDataFrame([(1, "bayarlor", 50), (2, "bayralor", 2), (3, "bayarlors", 5), (4, "bayarl", 1), (5, "mens", 90), (6, "men", 1), (7, "bayarlox", 30)], "id long, phrase string, n long")
    assert {tuple(r) for r in products.misspelled(phrases, products.Settings()).collect()} == {(2, 1), (3, 1)}


def test_reinforcement_that_does_not_converge_is_an_error(spark):
    forms = spark.createDataFrame([(i, [i % 3, 10 + i % 2, 20 + i % 5]) for i in range(30)], "form long, ids array<long>")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(29)], "a long, b long")
    with pytest.raises(RuntimeError, match="rounds"):
        products.reinforce(pairs, forms, forms.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")), products.Settings(rounds=1, tolerance=1e-9))


def test_every_two_forms_of_a_block_are_learned_from(spark):
    """Blocks of 10 and, met in tiles, of 1,100 forms; another length, another size or no rare phrase in common parts forms."""
    small = [(i, 500.0, 1, "m", [7, 1000 + i]) for i in range(10)]
    hot = [(100 + i, 800.0, 2, None, [8]) for i in range(1100)]
    apart = [(50, 700.0, 1, "m", [7]), (51, 500.0, 1, "l", [7]), (52, 500.0, 1, "m", [9])]
    forms = spark.createDataFrame(small + hot + apart, "form long, length double, pieces int, size string, ids array<long>")
    counts = forms.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    got = products.learning_pairs(forms, counts).collect()
    assert len(got) == 45 + 1100 * 1099 // 2
    assert {tuple(r) for r in got} == set(combinations(range(10), 2)) | set(combinations(range(100, 1200), 2))


def test_pairs_of_long_listings_are_learned_from(spark):
    """Two pairs whose sides differ in 21 phrases each: all of these face each other."""
    forms = spark.createDataFrame([(i, [1, *range(100 * (1 + i // 2), 100 * (1 + i // 2) + 21)]) for i in range(4)], "form long, ids array<long>")
    counts = forms.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    vocabulary, _, at, _ = products.reinforce(spark.createDataFrame([(0, 2), (1, 3)], "a long, b long"), forms, counts, products.Settings())
    assert {(int(vocabulary.ids[x]), int(vocabulary.ids[y])) for x, y in at.T} == {(x, y) for x in range(100, 121) for y in range(200, 221)}


@pytest.mark.parametrize("together", [1, 7, 1 << 20])
def test_facings_by_parts(monkeypatch, together):
    monkeypatch.setattr(products, "FACINGS", together)
    g = random.Random(together)
    rows = [{k: [g.randrange(-1, 30) for _ in range(g.randrange(0, 6))] for k in "suv"} for _ in range(50)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([(k, pa.list_(pa.int32())) for k in "suv"]))
    for part in (batch, batch.slice(20, 25), batch.slice(0, 0)):
        got = Counter()
        for b in products._facings(30)(iter([part])):
            for code, n in zip(*(c.to_pylist() for c in b.columns)):
                got[code] += n
        assert got == Counter(min(x, y) * 30 + max(x, y) for r in part.to_pylist() for x in r["u"] for y in r["v"] if min(x, y) >= 0)


# --- near duplicates ---------------------------------------------------------


def records(seed):
    g = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)] + ["the", "a", "it"] * 30
    base = [[g.choice(vocabulary) for _ in range(g.randrange(32, 90))] for _ in range(40)]
    rows, k = [], 0
    for words in base:
        for _ in range(4):
            w = list(words)
            for _ in range(g.randrange(0, 14)):
                w[g.randrange(len(w))] = g.choice(vocabulary)
            if g.random() < 0.3:
                h = len(w) // 2
                w = w[h:] + w[:h]
            rows.append((k, g.choice([None, "", "Title"]), g.choice([" ", "\n", "; "]).join(w)))
            k += 1
    text = " ".join(base[0])
    rows += [(k + i, None, text) for i in range(6)] + [(k + 10, "", text), (k + 11, None, None), (k + 12, "t", ""), (k + 13, None, "Five stars " * 10), (k + 14, None, "Five stars " * 10), (k + 15, None, "word " * 29), (k + 16, None, " ".join(["x"] * 200000)), (k + 17, None, "日本語 " * 40), (k + 18, None, "日本語 " * 40)]
    return rows


def brute(rows, limit=0.7):
    import re

    bags = [(k, Counter(re.findall("[a-z0-9]+", ((t or "") + " " + (x or "")).lower()))) for k, t, x in rows]
    return {(a, b) for (a, p), (b, q) in combinations(sorted(bags, key=lambda r: r[0]), 2) if min(p.total(), q.total()) >= 30 and neardup.multiset_similarity(p, q) >= limit - 1e-12}


@pytest.mark.parametrize("tile", [512, 3])
def test_near_duplicates(spark, tile):
    rows = records(4)
    df = spark.createDataFrame([*rows, (None, None, rows[0][2]), rows[1]], "review_id long, title string, text string").withColumn("id", F.lit(1)).withColumn("key", F.lit(2)).repartition(5)
    got = {tuple(r) for r in neardup.near_duplicates(df, settings=neardup.Settings(tile=tile)).collect()}
    want = brute(rows)
    # word-by-word substitutions all over a record, near the limit, are the hardest case for the bands
    assert got <= want and len(got) >= 0.9 * len(want)
    clear = brute(rows, 0.8)
    assert len(clear & got) >= 0.97 * len(clear)
    close = {(a, b) for a, b in want if dict((k, x) for k, _, x in rows)[a] == dict((k, x) for k, _, x in rows)[b]}
    assert close <= got
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_a_full_filter_loses_nothing(spark):
    rows = records(6)[:80]
    df = spark.createDataFrame(rows, "review_id long, title string, text string")
    few, many = ({tuple(r) for r in neardup.near_duplicates(df, settings=neardup.Settings(filter_bits=b)).collect()} for b in (1 << 15, 1 << 25))
    assert few == many and few


def test_posterior_bounds():
    low, high = neardup.least_matches(0.7, 1e-4, 64), neardup.least_matches(0.7, 1e-2, 64)
    assert 32 < low < high < 55
    # pairs right at the limit are seldom ruled out
    hits = np.random.default_rng(1).binomial(64, 0.85, 100000)
    assert (hits < low).mean() < 0.005


def test_oversized_buckets_that_meet_at_a_batch_boundary():
    s = neardup.Settings(tile=3)
    keys = [[7] * 8, [9] * 8, [9] * 2 + [11]]
    first = [0, 8, 16]
    batches = [pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(range(f, f + len(k)), pa.int64()), pa.array([0] * len(k), pa.int64()), pa.array([40] * len(k), pa.int64()), pa.array([-1] * len(k), pa.int64())], ["key", "id", "sketch", "more", "chunk"]) for k, f in zip(keys, first)]
    out = [row for b in neardup._bucket_pairs(s)(iter(batches)) for row in b.to_pylist()]
    assert {(r["key"], r["a"], r["chunk"]) for r in out} == {(7, i, i // 3) for i in range(8)} | {(9, 8 + i, i // 3) for i in range(10)}


def test_announced_buckets_pass_on_however_small():
    rows = [(5, neardup.MARK, 0, 0, -1), (5, 1, 0, 40, -1), (6, 2, 0, 40, -1), (6, 3, 0, 40, -1), (5, 4, 0, 40, 1 << 32)]
    for size in (1, 2, 5):
        batches = [pa.RecordBatch.from_pylist([dict(zip(["key", "id", "sketch", "more", "chunk"], r)) for r in rows[i : i + size]]) for i in range(0, 5, size)]
        out = [r for b in neardup._bucket_pairs(neardup.Settings())(iter(batches)) for r in b.to_pylist()]
        assert {(r["key"], r["a"], r["b"], r["chunk"]) for r in out} == {(5, 1, None, 0), (5, 4, None, 1 << 32), (None, 2, 3, None)}


def test_a_hot_bucket_is_spread_before_the_shuffle(spark):
    """Records that share whole bands: each task keeps about ``tile`` of them under the key and numbers the rest."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, body string").repartition(2)
    s = neardup.Settings(tile=100)
    routed = df.mapInArrow(neardup._band_rows(s), "key long, id long, sketch long, more long, chunk long").where(f"id <> {neardup.MARK}")
    worst = routed.groupBy("key", "chunk").count().agg(F.max("count")).first()[0]
    assert worst <= 2 * (100 + neardup.CHUNK) + 2 and routed.groupBy("key").count().agg(F.max("count")).first()[0] > 1400
    assert neardup.text_pairs(df, s).count() == 1500 * 1499 // 2


def test_words_count_after_lowering(spark):
    df = spark.createDataFrame([(1, None, "\u0130" * 30), (2, "", "\u0130" * 30)], "review_id long, title string, text string")
    assert neardup.near_duplicates(df).collect() == [(1, 2)]


def test_min_hashes_are_worked_out_a_few_at_a_time():
    """Scratch for a few of the 240 functions at once, which the cache holds and long records leave room for."""
    g = np.random.default_rng(3)
    values, heads = g.integers(0, 2**32, 30000, dtype=np.uint64), np.array([0, 1, 40, 9000, 29999])
    neardup._multipliers(240, 2)
    tracemalloc.start()
    got = neardup._minhash(values, heads, 240, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * values.nbytes
    for k in (0, 7, 8, 239):
        a, b = (int(x[k]) for x in neardup._multipliers(240, 2))
        all_of = [(((h := (int(v) * a + b) % 2**32) ^ h >> 15) * 0x2C1B3C6D) % 2**32 for v in values]
        assert got[:, k].tolist() == [min(all_of[i:j]) for i, j in zip(heads, [*heads[1:], None])]
