import json

import pytest
from pyspark.sql import functions as F

from stacklight.operators import evals
from stacklight.sources import files
from stacklight.streaming import ingest


def test_jsonl_round_trip(spark, tmp_path):
    (tmp_path / "meta_x.jsonl").write_text('{"parent_asin": "A", "title": "T", "rating_number": 3, "details": {"a": 1}}\nno json\n')
    (tmp_path / "x.jsonl").write_text(json.dumps({"parent_asin": "A", "timestamp": 5, "rating": 4.0}) + "\n")
    meta, other = files.discover(spark, str(tmp_path))
    assert meta.endswith("/meta_x.jsonl") and other.endswith("/x.jsonl")
    out = files.jsonl_to_parquet(spark, meta, f"{tmp_path}/m.parquet", files.PRODUCTS)
    assert [(r["parent_asin"], r["rating_number"]) for r in out.orderBy(F.col("parent_asin").desc_nulls_last()).collect()] == [("A", 3), (None, None)]
    with pytest.raises(Exception, match="(?i)already exists"):
        files.jsonl_to_parquet(spark, meta, f"{tmp_path}/m.parquet", files.PRODUCTS)
    assert files.jsonl_to_parquet(spark, other, f"{tmp_path}/m.parquet", files.REVIEWS, True).collect()[0]["timestamp"] == 5


def test_sample_and_stream(spark, tmp_path):
    products, reviews = files.sample_tables(spark)
    assert (products.count(), reviews.count()) == (3, 4)
    products.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # nothing new the second time
        ingest.stream_files(spark, f"{tmp_path}/in", files.PRODUCTS, lambda df: df.select("parent_asin"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_batches_resume(spark, tmp_path):
    products = spark.createDataFrame([(f"k{i}",) for i in range(20)] + [(None,)], "parent_asin string")
    bad = {"on": True}

    def transform(df):
        if bad["on"] and df.where("parent_asin = 'k3'").count():
            raise RuntimeError("broken")
        return df.where("parent_asin is not null")

    go = lambda **kw: ingest.run(spark, products, transform, f"{tmp_path}/index", f"{tmp_path}/ledger", 4, attempts=2, sleep=lambda s: None, **kw)
    assert go(dry_run=True) == ingest.Outcome()
    first = go()
    assert (first.completed, first.failed, first.exit_code) == (3, 1, 1)
    assert go(skip_failed=True) == ingest.Outcome()
    bad["on"] = False
    assert go(only_failed=True).completed == 1
    assert go() == ingest.Outcome()
    assert spark.read.parquet(f"{tmp_path}/index").count() == 20
    with pytest.raises(ValueError, match="ledger"):
        ingest.run(spark, products, transform, f"{tmp_path}/index", f"{tmp_path}/ledger", 5)


def test_retries():
    waits, calls = [], []

    def action():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert ingest.with_retries(action, 3, 2.0, waits.append) == 7 and waits == [2.0, 4.0]
    with pytest.raises(OSError):
        ingest.with_retries(lambda: (_ for _ in ()).throw(OSError()), 2, 0.0, waits.append)


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5)] + [(None,)], "v double")
    assert tuple(evals.percentiles(df, "v").collect()[0]) == (3.0, 5.0, 5)
    assert tuple(evals.percentiles(df.limit(0), "v").collect()[0]) == (None, None, 0)


def test_scores_and_verdicts(spark):
    cases = spark.createDataFrame([("c1", False, "men", ["jean"], 1, 2), ("c2", True, None, [], None, None)], "call_id string, outfit boolean, want_gender string, title_any array<string>, filter_hits int, filter_total int")
    results = spark.createDataFrame(
        [("c1", 1, "Blue JEANS", "men", False, False, "lower_body"), ("c1", 2, "Sandals", "women", True, False, None), ("c1", 11, "Jeans", "men", False, False, None), ("c2", 1, "x", None, True, False, "upper_body")],
        "call_id string, rank int, title string, gender string, is_footwear boolean, is_accessory boolean, region string",
    )
    got = {r["call_id"]: r for r in evals.call_scores(results, cases).collect()}
    assert (got["c1"]["n_results"], got["c1"]["category_conformance"], got["c1"]["gender_conformance"], got["c1"]["outfit_coverage"]) == (2, 0.5, 0.5, None)
    assert (got["c2"]["category_conformance"], got["c2"]["gender_conformance"], got["c2"]["outfit_coverage"]) == (None, None, 0.5)
    calls = spark.createDataFrame(
        [(200, 100.0, 0, False, 5, 1, 2, 0.5, 1.0, None), (500, None, 2, False, 0, None, None, None, None, None), (200, 300.0, 0, True, 0, None, None, None, None, 0.5)],
        "status int, latency_ms double, flakes int, outfit boolean, n_results int, filter_hits int, filter_total int, category_conformance double, gender_conformance double, outfit_coverage double",
    )
    m = evals.metrics(calls).collect()[0]
    assert (m["error_rate"], m["empty_rate"], m["network_flakes"], m["filter_accuracy"], m["latency_p95_ms_outfit"]) == (0.333, 0.5, 2, 0.5, 300.0)
    passed = {r["metric"]: r["passed"] for r in evals.verdicts(evals.metrics(calls)).collect()}
    assert passed["latency_p95_ms_normal"] and not passed["error_rate"] and not passed["outfit_coverage"]
    empty = {r["metric"]: r["passed"] for r in evals.verdicts(evals.metrics(calls.limit(0))).collect()}
    assert not empty["error_rate"] and empty["latency_p95_ms_normal"]
