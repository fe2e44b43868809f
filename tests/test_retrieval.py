import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklight.operators import retrieval, vector
from stacklight.plans.search_plan import RELAX_ORDER, Filters, gender_pools, subqueries

COLUMNS = "id string, vec array<float>, title string, description string, gender string, color string, style string, size string, category string, overall_sentiment string, average_rating double"


def rows_of(n, seed):
    g = random.Random(seed)
    pick = lambda *xs: g.choice([*xs, None])
    out = []
    for i in range(n):
        v = np.array([g.gauss(0, 1) for _ in range(3)])
        v = np.round(v / np.linalg.norm(v), 1)
        out.append((f"p{i:03}", [float(x) for x in v], f"title {i}", None, pick("men", "women", "kids"), pick("red", "blue"), pick("party", "casual"), pick("s", "m"), pick("dress", "shirt", "jeans"), pick("positive", "negative"), g.choice([None, 2.0, 4.0, 5.0])))
    return out


def loop(rows, f, q, k, at_once):
    """The search as a loop that gives up one filter after another."""
    names = COLUMNS.replace(" array<float>", " x").split(", ")
    idx = {c.split()[0]: i for i, c in enumerate(names)}
    value = lambda r, n: r[idx["overall_sentiment" if n == "sentiment" else n]]

    def ok(r, soft):
        if f.gender and r[idx["gender"]] != f.gender or not f.gender and r[idx["gender"]] in f.exclude_genders:
            return False
        if f.category and r[idx["category"]] != f.category:
            return False
        for n in soft:
            have = r[idx["average_rating"]] if n == "min_rating" else value(r, n)
            if have is None or (have < f.min_rating if n == "min_rating" else have != getattr(f, n)):
                return False
        return True

    soft, steps = f.soft(), 0
    while True:
        hit = sorted(((-round(float(np.dot(np.float32(r[1]).astype(float), q)), 6), r[0]) for r in rows if ok(r, soft)))[:k]
        if len(hit) >= 5 or not soft:
            return [i for _, i in hit], steps
        soft, steps = ([], steps + 1) if at_once else (soft[1:], steps + 1)


@pytest.mark.parametrize("at_once", [False, True])
def test_relaxation_equals_the_loop(spark, at_once):
    rows = rows_of(80, 5)
    df = spark.createDataFrame(rows, COLUMNS)
    q = [0.6, 0.8, 0.0]
    for k, f in ((20, Filters(gender="men", color="red", style="party", min_rating=4.0)), (3, Filters(color="blue", size="s")), (20, Filters(category="dress")), (20, Filters(gender="women", sentiment="positive", style="casual", size="m", color="red", min_rating=5.0))):
        plan = subqueries(f)
        got = retrieval.relaxed(df, plan, q, {p.number: k for p in plan}, at_once, keep=[]).orderBy("sq_id", "rank").collect()
        for p in plan:
            mine = [r for r in got if r["sq_id"] == p.number]
            want, steps = loop(rows, p.filters, q, k, at_once)
            assert [r["id"] for r in mine] == want
            assert all(r["chosen"] == steps for r in mine)


def interleaved(lists):
    order = sorted((l for l in lists if l), key=lambda l: -l[0][1])
    out, seen = [], set()
    for k in range(max(map(len, order), default=0)):
        for l in order:
            if k < len(l) and l[k][0] not in seen:
                seen.add(l[k][0])
                out.append(l[k][0])
    return out


def test_interleave_equals_round_robin(spark):
    g = random.Random(6)
    for _ in range(5):
        lists = [[(f"i{g.randrange(12)}-{j if g.random() < 0.7 else 0}", float(g.randrange(4))) for j in range(g.randrange(5))] for _ in range(4)]
        flat = [(n, j + 1, i, r) for n, l in enumerate(lists) for j, (i, r) in enumerate(l)]
        df = spark.createDataFrame(flat, "l int, k int, id string, r double")
        assert [r["id"] for r in retrieval.interleave(df, "l", "k", "id", "r").orderBy("position").collect()] == interleaved(lists)


def test_plans():
    assert [f.gender for f in gender_pools(Filters())] == [None, "men"]
    assert len(gender_pools(Filters(category="dress"))) == 1 and gender_pools(Filters(gender="men")) == [Filters(gender="men")]
    plan = subqueries(Filters(style="party", category="jeans"), True)
    assert len(plan) == 8 and all(p.filters.style is None and p.filters.category is None for p in plan)
    f = Filters(gender="men", style="party", color="red", min_rating=4.0)
    assert f.soft() == ["min_rating", "style", "color"] and f.after(1, False).soft() == ["style", "color"] and f.after(1, True).soft() == []
    assert f.applied() == {"gender": "men", "color": "red", "style": "party", "min_rating": 4.0}
    assert RELAX_ORDER[0] == "min_rating"


def test_predicates_and_nulls(spark):
    df = spark.createDataFrame(rows_of(60, 7), COLUMNS)
    none_excluded = df.where(Filters(exclude_genders=("men", "kids")).predicate())
    assert {r["gender"] for r in none_excluded.collect()} == {"women", None}
    assert df.where(Filters().predicate()).count() == 60
    assert df.where(Filters(min_rating=4.0).predicate()).where("average_rating is null").count() == 0
    assert {r["category"] for r in df.where(Filters(categories=("dress", "jeans")).predicate()).collect()} == {"dress", "jeans"}


def test_word_score(spark):
    df = spark.createDataFrame([("red dress", 2.0), ("DRESS", 1.0), ("", float("-inf"))], "t string, want double")
    for r in df.select(retrieval.word_score(retrieval.query_words(F.lit(" Red  dress red")), F.col("t")).alias("got"), "want").collect():
        assert r["got"] == r["want"]


def test_nearest_sets(spark, monkeypatch):
    g = np.random.default_rng(8)
    v = g.normal(size=(200, 6)).astype(np.float32)
    v[5] = v[7]  # a tie
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (None, [1.0] * 6)], "id long, vec array<float>")
    asked = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vec")

    def brute(k, keep):
        out = set()
        for q in range(0, 200, 20):
            s = sorted((-round(float(np.dot(v[q].astype(float), v[i].astype(float))), 6), i) for i in range(200) if keep or i != q)
            out |= {(q, i, k_ + 1) for k_, (_, i) in enumerate(s[:k])}
        return out

    for keep in (True, False):
        got = {(r["query_id"], r["id"], r["rank"]) for r in vector.nearest_many(df, asked, 5, keep_self=keep).collect()}
        assert got == brute(5, keep)
    monkeypatch.setattr(vector, "BLOCK_BYTES", 400)  # several blocks
    assert {(r["query_id"], r["id"], r["rank"]) for r in vector.nearest_many(df, asked, 5).collect()} == brute(5, True)
    assert vector.nearest_many(df, asked.limit(0), 5).count() == 0
    assert vector.nearest_many(df.limit(0), asked, 5).count() == 0
