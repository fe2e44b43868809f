import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklight.llm import bitmap, leakage, spans, tokens, topn

VOCABULARY = f"{tokens.FOLDER}/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files here")


# --- top N -------------------------------------------------------------------


def best(rows, n):
    out, low = set(), float("-inf")
    groups = {g for g, *_ in rows if g is not None}
    value = lambda x: low if x is None or x != x else x
    for g in groups:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-value(r[1]), -value(r[2]), r[3]))
        out |= {(g, i + 1, r[3]) for i, r in enumerate(mine[:n])}
    return out


@pytest.mark.parametrize("copies", [1, 3])
def test_top_n_equals_brute_force(spark, copies):
    g = random.Random(copies)
    rows = [(g.choice(["hot"] * 6 + ["tied", "few", None] + [f"g{i}" for i in range(30)]), g.choice([None, 0, 0, 0, 1, 7, 300, -2]), g.choice([None, 1.0, 5.0, float("nan")]), i) for i in range(1500)]
    rows += [("tied", 0, 5.0, 5000 + i) for i in range(400)]
    df = spark.createDataFrame(rows * copies, "place string, votes long, c double, id long").withColumn("__bin", F.lit(1)).repartition(6)
    got = {tuple(r) for r in topn.top_n(df, "place", ["votes", "c"], "id", 3).toDF("g", "p", "id").collect()}
    assert got == best(rows, 3)
    assert topn.top_n(df.limit(0), "place", ["votes", "c"], "id", 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, "place", ["votes"], "id", 0)


def test_bins_keep_the_order(spark):
    values = [None, -1e9, -5.0, -1.0, 0.0, 0.4, 1.0, 2.0, 3.0, 1e6, float("inf")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(topn.score_bin(F.col("v"))).collect()]
    assert got == sorted(got)


# --- tokens ------------------------------------------------------------------

TRICKY = [
    None, "", " ", "\n\n", "  a", "a  b ", "don't've'll 's's's ''s !'s 're'", "x'y'S'T", "tab\tnbsp\xa0 　wide", "\x1c\x85z", "١٢٣ ½ ²", "naïve café 日本語 👍🏽", "<|endoftext|>", "'", "'l", "'ll", "\r\n \r\n x", "a" * 5000, "'ve" * 50,
]


def random_texts(seed, n):
    g = random.Random(seed)
    letters = [*"aabcstmdrevlSTL'''  \n\t!.,019é中あ٣ß", " ", "\x85", "’", "😀", "́", "'s", "'re", "'ll", " '"]
    some = ["".join(g.choices(letters, k=g.randrange(30))) for _ in range(n)]
    return some + ["".join(chr(g.choice([g.randrange(0x20, 0x2FFF), g.randrange(0x10000, 0x1FFFF)])) for _ in range(15)) for _ in range(n // 10)]


@needs_vocabulary
def test_ids_equal_the_public_library():
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    texts = [t or "" for t in TRICKY] + random_texts(2, 8000)
    flat, cuts, at = tokens.encoder(VOCABULARY).encode(texts)
    want = [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]
    assert [flat[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == want
    for t, a, b in zip(texts, cuts[:-1], cuts[1:]):
        assert all(0 <= x < len(t) for x in at[a:b]) and list(at[a:b]) == sorted(at[a:b])


@needs_vocabulary
def test_encode_and_decode(spark):
    rows = [(i, t, "x") for i, t in enumerate(TRICKY)] + [(None, "text", "y"), (0, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tokens.encode(df, offsets=True)
    assert got.columns == ["doc_id", "ids", "offsets"] and got.count() == len(rows)
    by = {r["doc_id"]: r for r in got.where("doc_id > 0").collect()}
    assert by[1]["ids"] == [] and len(by[4]["ids"]) == len(by[4]["offsets"])
    back = {r["doc_id"]: r["text"] for r in tokens.decode(got).where("doc_id > 0").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TRICKY) if i)
    assert tokens.encode(df.limit(0)).count() == 0


def test_chunks_cover_all_texts():
    texts = ["a" * n for n in (0, 5, 100, 0, 3)]
    assert [i for a, b in tokens._chunks(texts, 50) for i in range(a, b)] == list(range(5))


# --- leakage -----------------------------------------------------------------


def shared(docs, items, n):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    grams = lambda t: {tuple(w[i : i + n]) for w in [words(t)] for i in range(len(w) - n + 1)}
    known = [(k, grams(t)) for k, t in items]
    return {(d, k) for d, t in docs if d is not None for k, g in known if k is not None and g & grams(t)}


@pytest.mark.parametrize("most", [1 << 28, bitmap.PART])
def test_leaks_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(leakage, "width", lambda n: bitmap.width(n, most=most))
    g = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünder", "İx", "a1"]
    text = lambda n: " ".join(g.choice(vocabulary) + g.choice(["", ",", "\n", "--"]) for _ in range(n))
    items = [(i, text(8)) for i in range(20)] + [(50, None), (51, ""), (52, "one two"), (None, text(9)), (3, text(8))]
    docs = [(i, text(40)) for i in range(60)]
    docs += [(100 + i, text(10) + " " + g.choice(items[:20])[1].upper() + "! " + text(5)) for i in range(30)] + [(200, None), (201, ""), (None, items[0][1]), (202, items[1][1] * 3000), (203, "x" * 100000)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for n in (4, 8):
        found = leakage.leaks(df, it, n=n)
        assert {tuple(r) for r in found.collect()} == shared(docs, items, n)
    assert leakage.leaks(df.limit(0), it, n=4).count() == 0 and leakage.leaks(df, it.limit(0), n=4).count() == 0
    kept = {r["doc_id"] for r in leakage.remove_leaks(df, leakage.leaks(df, it, n=8)).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in shared(docs, items, 8)}


def test_a_passage_in_very_many_items(spark):
    same = " ".join(f"w{i}" for i in range(12))
    items = spark.range(100_000).select(F.col("id").alias("item_id"), F.lit(same).alias("text"))
    docs = spark.createDataFrame([(i, f"x {same} y") for i in range(5)] + [(9, "else")], "doc_id long, text string")
    assert leakage.leaks(docs, items).count() == 500_000
    assert {(r["doc_id"], r["words_cut"]) for r in leakage.cut_passages(docs, items).collect()} == {(i, 12) for i in range(5)} | {(9, 0)}


def test_the_bitmap_is_bounded_and_misses_nothing(spark):
    assert bitmap.width(0) == bitmap.PART and bitmap.width(10**9) == 1 << 28 and bitmap.width(1000) == 1 << 20
    some = [g * 7919 * (-1) ** g for g in range(5000)]
    bits = bitmap.build(spark.createDataFrame([(x,) for x in some], "h long"), "h", bitmap.PART)
    assert bitmap.holds(bits, np.array(some)).all() and len(bits) == bitmap.PART // 8


def test_cut_passages(spark):
    df = spark.createDataFrame([(1, "Start. THE quick brown-fox jumps! End"), (2, None), (3, "nothing here"), (4, "")], "doc_id long, text string")
    it = spark.createDataFrame([(9, "the quick brown fox jumps")], "item_id long, text string")
    got = {r["doc_id"]: (r["clean_text"], r["n_cut"] > 0) for r in leakage.cut_passages(df, it, n=4).collect()}
    assert got == {1: ("Start. ! End", True), 2: (None, False), 3: ("nothing here", False), 4: ("", False)}


# --- spans -------------------------------------------------------------------


def brute_spans(docs, least):
    own, out = {}, set()
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            own.setdefault(t[i : i + least], set()).add(d)
    cover = {}
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            if len(own[t[i : i + least]]) > 1:
                cover.setdefault(d, set()).add(i)
    for d, at in cover.items():
        start = end = None
        for i in sorted(at):
            if start is None or i > end:
                if start is not None:
                    out.add((d, start, end))
                start = i
            end = i + least
        out.add((d, start, end))
    return out


def span_docs(seed):
    g = random.Random(seed)
    text = lambda n: "".join(g.choices("ab cdé😀", k=n))
    parts = [text(g.randrange(20, 90)) for _ in range(8)]
    docs = [(i, "".join(g.choice(parts) if g.random() < 0.5 else text(g.randrange(40)) for _ in range(4))) for i in range(40)]
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, parts[0] * 3), (103, "a" * 200), (104, "a" * 120 + "b"), (105, None), (106, ""), (107, "short"), (108, "xy" * 100), (109, "yx" * 100)]
    return docs


@pytest.mark.parametrize("seed, group, seed_length", [(1, 1000, 12), (2, 2, 12), (3, 0, 30), (4, 1000, 1)])
def test_spans_equal_brute_force(spark, seed, group, seed_length):
    docs = span_docs(seed)
    df = spark.createDataFrame([*docs, (None, docs[0][1]), docs[3]], "doc_id long, text string").withColumn("seed", F.lit("x")).repartition(5)
    got = {tuple(r) for r in spans.shared_spans(df, least=30, seed=seed_length, group=group).collect()}
    assert got == brute_spans(docs, 30)
    assert spans.shared_spans(df.limit(0), least=30, seed=12).count() == 0


def test_long_texts_are_cut_into_blocks(spark, monkeypatch):
    docs = span_docs(5)
    rows, least = [], 30
    monkeypatch.setattr(spans, "BLOCK", 50)
    for block in spans._blocks([d for d, _ in docs], [t for _, t in docs], least):
        which, grams, context, first, n, lead = spans.seeds(block, least, 12)
        rows += [(block[w][0], block[w][1] + f, k) for w, f, k in zip(which, first, n)]
    starts = {(d, a + i) for d, a, k in rows for i in range(k)}
    assert starts == {(d, i) for d, t in docs if t for i in range(len(t) - least + 1)}


def test_shared_amount(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    found = spark.createDataFrame([(1, 0, 2)], "doc_id long, span_start long, span_end long")
    assert {tuple(r) for r in spans.shared_amount(docs, found).collect()} == {(1, 3, 2, 1), (2, 0, 0, 0)}
