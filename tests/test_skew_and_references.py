import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stacklight.operators import references, relational, skew


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def test_heavy_keys_exact(spark):
    values = ["a"] * 400 + ["b"] * 41 + [None] * 300 + ["c"] * 39 + [f"x{i}" for i in range(220)]
    random.Random(1).shuffle(values)
    got = {r["k"]: (r["n_rows"], r["n_total"]) for r in skew.heavy_keys(keys(spark, values), "k", 0.04).collect()}
    assert got == {"a": (400, 1000), "b": (41, 1000)}


@pytest.mark.parametrize("values", [[], [None, None], ["only"]])
def test_heavy_keys_small_tables(spark, values):
    got = [r["k"] for r in skew.heavy_keys(keys(spark, values), "k", 0.04).collect()]
    assert got == ([values[0]] if values == ["only"] else [])


def test_statistics_equal_a_plain_aggregation(spark):
    g = random.Random(2)
    rows = [(g.choice(["hot"] * 5 + ["warm", None] + [f"c{i}" for i in range(50)]), g.choice([None, 1.0, 2.5, -3.0])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["n_rows"], r["n_values"], r["sum_value"], r["min_value"], r["max_value"]) for r in skew.per_key_stats(df, "k", F.col("v")).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        vs = [v for kk, v in rows if kk == k]
        real = [v for v in vs if v is not None]
        want[k] = (len(vs), len(real), sum(real) if real else None, min(real, default=None), max(real, default=None))
    assert got == want
    assert skew.per_key_stats(df.limit(0), "k", F.col("v")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_join(spark, how):
    g = random.Random(3)
    facts = spark.createDataFrame([(g.choice(["hot"] * 9 + [None] + [f"k{i}" for i in range(20)]), i) for i in range(500)], "k string, f int")
    dims = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 20, 2)], ("unused", 5)], "k string, d int")
    ours, plain = (Counter(map(tuple, df.select("k", "f", "d").collect())) for df in (skew.split_join(facts, dims, "k", how), facts.join(dims, "k", how)))
    assert ours == plain
    with pytest.raises(ValueError):
        skew.split_join(facts, dims.withColumn("f", F.lit(1)), "k")


def test_runs_and_missing_keys(spark):
    number = lambda i: "".join("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[i // 36**p % 36] for p in range(9, -1, -1))
    g = random.Random(4)
    base = 36**4 - 20  # across a bucket border
    have = {number(base + i) for i in range(40) if i % 7} | {"odd key", "b000000001", number(36**10 - 1)}
    asked = {number(base + i) for i in range(-3, 45)} | {"odd key", "B000000001", "b000000001", "b000000002", "", "0000000000", number(36**10 - 1), number(36**10 - 2)}
    refs = spark.createDataFrame([(k,) for k in [*asked, None, *g.choices(sorted(asked), k=50)]], "k string")
    parents = spark.createDataFrame([(k,) for k in [*have, None, *have]], "p string")
    assert {r["key"] for r in references.missing_keys(refs, "k", parents, "p").collect()} == asked - have
    runs = [tuple(r) for r in references.key_runs(parents, "p").orderBy("run_start").collect()]
    assert len(runs) < len(have) and all(a <= b for _, a, b in runs)
    assert {r["key"] for r in references.missing_keys(refs, "k", parents.limit(0), "p").collect()} == asked
    assert references.missing_keys(refs.limit(0), "k", parents, "p").count() == 0


def test_reasons(spark):
    refs = spark.createDataFrame(
        [("t", "1", "A", 5), ("t", "2", "A", 20), ("t", "2", "A", 20), ("t", "3", "A", 15), ("t", "4", "Z", None), ("t", "5", None, 1), ("t", "6", "A", None), ("t", "7", "N", 0), ("t", "8", "A", 10)],
        "src_table string, row_key string, key string, at_us long",
    )
    parents = spark.createDataFrame([("A", 10), ("A", 12), ("N", None), (None, 1)], "key string, first_us long")
    gone = spark.createDataFrame([("A", 30), ("A", 20), ("Q", 1), (None, 1)], "key string, gone_us long")
    got = {(r["row_key"], r["reason"], r["period"]) for r in references.dangling(refs, parents, gone).collect()}
    assert got == {("1", "late", "1970-01"), ("2", "deleted", "1970-01"), ("4", "missing", "unknown")}
    assert references.dangling(refs.limit(0), parents, gone).count() == 0
    assert references.dangling(refs, parents.limit(0), gone.limit(0)).count() == 7


def test_membership(spark, tmp_path):
    rows, ids = keys(spark, ["A1", "A2", "A2", None, "ZZ"]), keys(spark, ["A2", "A2", None])
    assert [r["k"] for r in relational.rows_of_keys(rows, ids, "k").collect()] == ["A2", "A2"]
    assert sorted(r["k"] for r in relational.orphans(rows, ids, "k").collect()) == ["A1", "ZZ"]
    assert tuple(relational.orphan_summary(rows, ids, "k").collect()[0]) == (2, ["A1", "ZZ"])
    assert tuple(relational.orphan_summary(rows.limit(0), ids, "k").collect()[0]) == (0, [])
    with pytest.raises(ValueError, match="no such path"):
        relational.check_table(spark, f"{tmp_path}/x.parquet", "products")
    rows.write.parquet(f"{tmp_path}/y.parquet")
    with pytest.raises(ValueError, match="parent_asin"):
        relational.check_table(spark, f"{tmp_path}/y.parquet", "products")
    assert relational.check_request("  red dress ", 5) == "red dress"
    for bad in (("", 5), ("   ", 5), (None, 5), ("x", 0), ("x", 51), ("x" * 501, 5)):
        with pytest.raises(ValueError):
            relational.check_request(*bad)
