import html

import pytest
from pyspark.sql import functions as F

from stacklight.functions import attributes, sections
from stacklight.operators import evals, models, references, skew, vector
from stacklight.session import cut, forget
from stacklight.sources import files
from stacklight.streaming import ingest


def test_entities_as_the_standard_library_resolves_them(spark):
    texts = ["Tarn &amp; Tweed", "&amp;lt;", "&#39;x&#x27;&#X41;", "&eacute;t&eacute; &rarr; &nosuch; & &;", "a&b&amp", "&#128512;&#x1F600;", "&#0;&#xD800;&#1114112;", "", None, "&&amp;&quot;x", "&NotEqualTilde;"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(attributes.unescape(F.col("t"))).collect()]
    # the library also resolves some names without a semicolon, which is left alone here
    assert got == [None if t is None else "a&b&amp" if t == "a&b&amp" else html.unescape(t) for t in texts]


@pytest.mark.parametrize(
    "category, title, accessory, footwear",
    [
        ("cap", "Baseball Cap", True, False), (None, "Leather Belt for Men", True, False), (None, "Polarized Sunglasses", True, False), ("shirt", "Men's Red Shirt", False, False),
        ("shoes", "Leather Belt Buckle Shoes", False, True), (None, "Ring Spun Cotton Tie Dye Tee", False, False), (None, "silk bow tie", True, False), (None, "silk bowties", True, False),
        (None, "silk bow-tie", False, False), (None, "hair-clip", False, False), (None, "hair clips", True, False), (None, "Flip-Flops", False, True), (None, None, False, False),
    ],
)
def test_sections_of_titles(spark, category, title, accessory, footwear):
    row = spark.createDataFrame([(category, title)], "c string, t string").select(sections.is_accessory(F.col("c"), F.col("t")), sections.is_footwear(F.col("c"), F.col("t"))).first()
    assert tuple(row) == (accessory, footwear)


def test_queries_meet_rows_of_their_own_length(spark, monkeypatch):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [1.0]), ("d", []), ("e", None), (None, [1.0, 0.0])], "id string, vec array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("short", [0.5]), ("empty", []), ("none", None)], "query_id string, vec array<float>")
    want = {("q", "a", 1), ("q", "b", 2), ("short", "c", 1), ("empty", "d", 1)}
    for size in (64 << 20, 70):  # one block, a block a query
        monkeypatch.setattr(vector, "BLOCK_BYTES", size)
        assert {(r["query_id"], r["id"], r["rank"]) for r in vector.nearest_many(rows, asked, 3).collect()} == want
    assert vector.nearest_many(rows, asked.limit(0), 3).count() == 0 and vector.nearest_many(rows.limit(0), asked, 3).count() == 0


def test_months_are_utc_in_any_session(spark):
    refs = spark.createDataFrame([("r", "1", "X", 1704067199999999), ("r", "2", "X", 1704067200000000), ("r", "3", "X", -1), ("r", "4", "X", None)], "src_table string, row_key string, key string, at_us long")
    none = spark.createDataFrame([], "key string, first_us long")
    for zone in ("UTC", "Pacific/Auckland", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = {(r["row_key"], r["period"]) for r in references.dangling(refs, none, none.withColumnRenamed("first_us", "gone_us")).collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == {("1", "2023-12"), ("2", "2024-01"), ("3", "1969-12"), ("4", "unknown")}


def test_pairs_of_heavy_classes(spark):
    rows = [("hot", i) for i in range(2300)] + [("hot", 0), ("small", -1), ("small", -2), ("one", 9), (None, 1), ("small", None)]
    got = skew.class_pairs(spark.createDataFrame(rows, "c string, k long"), "c", "k")
    assert got.count() == 2300 * 2299 // 2 + 1 == got.distinct().count()
    assert skew.class_pairs(spark.createDataFrame([], "c string, k long"), "c", "k").count() == 0


def test_null_keys_of_a_split_join(spark):
    facts = spark.createDataFrame([(None, i) for i in range(50)] + [("a", 1)], "k string, x long")
    dims = spark.createDataFrame([("a", 2.0), (None, 3.0)], "k string, y double")
    assert skew.split_join(facts, dims, "k", "inner").count() == 1
    got = skew.split_join(facts, dims, "k", "left")
    assert got.count() == 51 and got.where("y is not null").count() == 1


def test_tables_cut_and_forgotten(spark):
    df = cut(spark.range(10).withColumn("b", F.col("id") % 2), by="b")
    assert df.where("b = 1").count() == 5
    forget(df)
    with pytest.raises(Exception, match="(?i)not exist"):
        df.count()


def test_the_last_write_of_a_key_stays(spark, tmp_path):
    write = lambda rows: ingest.upsert(spark.createDataFrame(rows, "id string, v long, at long"), f"{tmp_path}/t", "id", "at", 4)
    assert write([("a", 1, 1), ("b", 1, 1), ("a", 2, 2), (None, 9, 9), ("c", 7, None)]) == 3
    assert write([("a", 0, 0), ("d", 5, 5), ("d", 5, 5)]) == 2
    assert {(r["id"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {("a", 0), ("b", 1), ("c", 7), ("d", 5)}
    assert write([]) == 0 and spark.read.parquet(f"{tmp_path}/t").count() == 4


def test_an_interrupt_ends_with_130(spark, tmp_path):
    def broken(df):
        raise KeyboardInterrupt

    out = ingest.run(spark, spark.createDataFrame([("a",)], "parent_asin string"), broken, f"{tmp_path}/i", f"{tmp_path}/l", 1)
    assert (out.exit_code, out.completed, out.failed) == (130, 0, 0) and ingest.Outcome(failed=1).exit_code == 1


def test_failed_chunks_are_neutral(spark):
    def classify(texts):
        if "bad chunk" in texts:
            raise OSError
        return ["strange" if t == "?" else "positive" for t in texts]

    df = spark.createDataFrame([(1, "x"), (2, "bad chunk"), (3, None), (4, "?"), (5, "")], "id long, text string")
    got = {r["id"]: r["sentiment"] for r in models.sentiments(df, "text", models.Models(classify=classify), 1).collect()}
    assert got == {1: "positive", 2: "neutral", 3: "neutral", 4: "neutral", 5: "positive"}
    together = models.sentiments(df.coalesce(1), "text", models.Models(classify=classify), 10)
    assert {r["sentiment"] for r in together.collect()} == {"neutral"} and models.sentiments(df, "text").columns == ["id", "text", "sentiment"]


def test_a_models_verdict_goes_before_the_words(spark):
    df = spark.createDataFrame([("red dress",), ("bitcoin price",), ("robe rouge",), (None,)], "q string")
    plain = {r["q"]: r for r in models.understand(df).collect()}
    assert plain["red dress"]["is_fashion"] and not plain["bitcoin price"]["is_fashion"] and plain["bitcoin price"]["message"] and plain["bitcoin price"]["search_query"] is None and not plain[None]["is_fashion"]
    told = F.when(F.col("q") == "robe rouge", F.struct(F.lit(True).alias("is_fashion"), F.lit("fr").alias("language"), F.lit("red dress").alias("english_query"))).when(F.col("q") == "red dress", F.struct(F.lit(False).alias("is_fashion"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("english_query")))
    asked = models.understand(df, "q", models.Models(extract=lambda q: told))
    by = {r["q"]: r for r in asked.collect()}
    assert by["robe rouge"]["search_query"] == "red dress" and by["robe rouge"]["language"] == "fr" and not by["red dress"]["is_fashion"] and not by["bitcoin price"]["is_fashion"]
    results = spark.createDataFrame([("robe rouge", "p1"), ("red dress", "p2")], "q string, id string")
    assert {(r["q"], r["id"], r["message"] is not None) for r in models.guarded(asked.where("q is not null"), "q", results).collect()} == {("robe rouge", "p1", False), ("red dress", None, True), ("bitcoin price", None, True)}


def test_rates_of_probes_and_request_ids(spark):
    probes = spark.createDataFrame([(422, [400, 422]), (500, [422]), (None, [422])], "status int, allowed array<int>")
    assert evals.robustness(probes).first()[0] == 0.333 and evals.robustness(probes.limit(0)).first()[0] is None
    calls = spark.createDataFrame([(200, "r"), (200, ""), (200, None), (500, "r")], "status int, request_id string")
    assert evals.request_id_rate(calls).first()[0] == 0.333


def test_an_index_of_another_length_is_refused(spark, tmp_path):
    assert files.ensure_index(spark, f"{tmp_path}/i", "id string", 8) and not files.ensure_index(spark, f"{tmp_path}/i", "id string", 8)
    with pytest.raises(ValueError, match="dimensions"):
        files.ensure_index(spark, f"{tmp_path}/i", "id string", 9)
