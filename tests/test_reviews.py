from pyspark.sql import functions as F

from stacklight.functions import reviews as R
from stacklight.operators import catalog
from stacklight.operators import reviews as ops

SCHEMA = "review_id long, parent_asin string, rating double, text string, ts long, verified_purchase boolean, helpful_vote long"


def frame(spark, rows):
    """(parent_asin, rating, text) in order; other columns fixed."""
    return spark.createDataFrame([(i, k, r, t, 1690000000000, True, 0) for i, (k, r, t) in enumerate(rows)], SCHEMA)


def test_bucket_edges(spark):
    ratings = [0.0, 2.5, 2.6, 3.5, 3.6, 5.0, 5.1, -1.0, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ratings], "r double").select(R.rating_bucket(F.col("r"))).collect()]
    assert got == ["low", "low", "middle", "middle", "high", "high", None, None, None]


def test_keep_counts(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 3, 4, 10, 11, 999)], "n long")
    assert [r[0] for r in rows.select(R.keep_per_bucket(F.col("n"))).collect()] == [0, 1, 3, 2, 2, 3, 3]


def test_score_terms(spark):
    rows = spark.createDataFrame(
        [("", 0, False, R.REFERENCE_MS), ("Fit and SIZE fit fits color", 3, True, R.REFERENCE_MS - 1), (None, None, None, None), ("x" * 1501, 0, False, R.REFERENCE_MS - R.DAY_MS * 365), ("profit", 0, False, R.REFERENCE_MS + 1)],
        "t string, h long, v boolean, ms long",
    )
    got = [round(r[0], 6) for r in rows.select(R.score(F.col("t"), F.col("h"), F.col("v"), F.col("ms"))).collect()]
    import math

    assert got == [0.3, round(math.log1p(3) + 0.5 + 0.8 + 0.5 * 27 / 400 + 0.3, 6), 0.3, round(0.5 - 0.5 + 0.15, 6), round(0.5 * 6 / 400 + 0.3, 6)]


def test_selection(spark):
    many = ops.top_reviews(ops.scored(frame(spark, [("A", 5.0, f"t{i}") for i in range(12)])))
    assert many.count() == 3
    mixed = ops.top_reviews(ops.scored(frame(spark, [("A", 1.0, "a"), ("A", 3.0, "b"), ("A", 5.0, "c"), ("A", None, "d"), (None, 5.0, "e"), ("A", 9.0, "f")])))
    assert sorted(r["review_id"] for r in mixed.collect()) == [0, 1, 2]


def test_redelivered_reviews_count_once(spark):
    rows = frame(spark, [("A", 5.0, "a"), ("A", 4.0, "b")])
    assert ops.scored(rows.unionByName(rows)).count() == 2


def test_majority_and_ties(spark):
    rows = spark.createDataFrame([("A", "positive"), ("A", "negative"), ("B", "neutral"), ("B", "positive"), ("B", "positive")], "parent_asin string, sentiment string")
    assert {tuple(r) for r in ops.majority_sentiment(rows).collect()} == {("A", "negative"), ("B", "positive")}


def test_highlight_mix(spark):
    kinds = [("p1", "positive"), ("p2", "positive"), ("p3", "positive"), ("n1", "neutral"), ("g1", "negative")]
    rows = spark.createDataFrame([("A", i, 1.0 - i / 10, s) for i, (_, s) in enumerate(kinds)], "parent_asin string, review_id long, score double, sentiment string")
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(kinds)], "review_id long, text string")
    assert ops.highlights(rows, texts).collect()[0]["review_highlights"] == ["p1", "p2", "p3", "n1", "g1"]
    only = ops.highlights(rows.where("sentiment = 'positive'"), texts).collect()[0]["review_highlights"]
    assert only == ["p1", "p2", "p3"]
    assert ops.highlights(rows.limit(0), texts).count() == 0


def test_enrichment_defaults(spark):
    products = spark.createDataFrame(
        [("A1", "Men's Red Party Shirt Large", ["Soft. ", "", None], 4.0, 3, None, 1.0), ("A2", "Plain thing", None, None, None, None, None), ("A3", None, [], 1.0, 1, None, None)],
        "parent_asin string, title string, description array<string>, average_rating double, rating_number long, images array<struct<variant:string,thumb:string,large:string,hi_res:string>>, price double",
    )
    results = spark.createDataFrame([("A1", "positive", ["x"])], "parent_asin string, overall_sentiment string, review_highlights array<string>")
    got = {r["parent_asin"]: r for r in catalog.enrich(catalog.one_per_key(products), results).collect()}
    assert got["A1"]["combined_text"] == "Men's Red Party Shirt Large Soft. red men l party shirt positive"
    a2 = got["A2"]
    assert (a2["overall_sentiment"], a2["review_highlights"], a2["gender"], a2["color"], a2["category"], a2["description"], a2["size"]) == ("neutral", [], "not specified", "not mentioned", "not distributed", "no description", None)
    assert got["A3"]["combined_text"].startswith("no description not mentioned")


def test_index_codec(spark):
    rows = spark.createDataFrame([("A", "", '["a","b","a"]', "plain words", 12.0), ("B", "T", None, '["x", "y"]', None)], "id string, title string, images string, review_highlights string, rating_number double")
    for c in ("gender", "color", "style", "size", "category", "overall_sentiment"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    got = {r["id"]: r for r in catalog.decode_rows(rows.withColumn("average_rating", F.lit(1.0))).collect()}
    assert (got["A"]["title"], got["A"]["rating_number"], got["A"]["review_highlights"]) == ("Unknown Title", 12, ["plain words"])
    assert (got["B"]["image_urls"], got["B"]["review_highlights"]) == ([], ["x", "y"])
