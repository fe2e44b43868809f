import pytest
from pyspark.sql import functions as F

from stacklight.functions import attributes as A
from stacklight.functions import images, query_text, sections

GOLDEN = {
    "category": [("Men's Graphic T-Shirt", "t-shirt"), ("Leather Boots", "shoes"), ("Unisex Baseball Cap", "hat"), ("Running Sneakers for Women", "sneakers"), ("Unknown Vintage Item", None), ("Short Sleeve Dress", "shorts"), ("Nice teen outfit", "t-shirt")],
    "color": [("Women's Navy Blue Dress", "navy"), ("Slim Fit Gray Jeans", "grey"), ("Golden Party Watch", "gold"), ("Plain Cotton Hoodie", None), ("navy-blue cap", "navy")],
    "gender": [("Men's Casual Shirt", "men"), ("Kids' Playground Set", "kids"), ("Adult T‑Shirt", None), ("Super‑Unisex Hoodie", "unisex"), ("Men’s Hat", None), ("", None), (None, None), ("For Women", "women")],
    "size": [("Casual Dress - Size XL", "xl"), ("Women's Small Top", "s"), ("Extra-Large Hoodie", "xl"), ("Size 2XL Sweatshirt", "xxl"), ("Classic Blue Jeans", None), ("XX-Large coat", "xl"), ("extra small tee", "xs"), ("size: m shirt", "m")],
    "style": [("Athletic Running Shoes", "sporty"), ("Formal Business Suit", "formal"), ("Basic Cotton Socks", None), ("Vintages", "vintage")],
}


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


@pytest.mark.parametrize("name", list(GOLDEN))
def test_golden(spark, name):
    assert column(spark, [t for t, _ in GOLDEN[name]], A.ALL[name]) == [v for _, v in GOLDEN[name]]


def test_all_together(spark):
    got = column(spark, ["Men's Red Casual T-Shirt Size XL", None], A.all_attributes)
    assert [tuple(g) for g in got] == [("men", "t-shirt", "red", "casual", "xl"), (None,) * 5]


def test_normalized_titles(spark):
    assert column(spark, ["&amp; Summer Dress!!", "***Special*Offer***", "", None, "  A  B  "], A.normalize_title) == ["& summer dress", "special*offer", "", None, "a b"]


def test_query_rules(spark):
    asked = ["blue jeans under 50", "size 8-10 boots", "shoes < 50", "coat over $80", "plain"]
    assert [tuple(r) for r in column(spark, asked, query_text.price_range)] == [(None, 50.0), (8.0, 10.0), (None, None), (80.0, None), (None, None)]
    assert column(spark, ["rated 4+", "4.5 stars", "top rated", "x"], query_text.min_rating) == [4.0, 4.5, 4.0, None]
    assert column(spark, ["a dress for my wife", "him and her", "girls party dress", "kids hat for him"], query_text.gender) == ["women", None, None, "kids"]
    assert column(spark, ["dress shirt", "dress pants for office", "black dress shoes", "a dress"], query_text.category) == ["shirt", "pants", "shoes", "dress"]
    assert column(spark, ["outfit for my husband for a party", "for my wife", "mother of the bride dress"], query_text.without_relations) == ["outfit for a party", "for my wife", "mother of the bride dress"]
    assert column(spark, ["pizza recipes", "weather today", "bitcoin price", "venues near me", "two dresses", "what's the weather", ""], query_text.has_fashion_term) == [False, False, False, False, True, True, False]
    assert column(spark, ["outfit for a wedding outfit", "blue thing"], lambda q: query_text.group_text(q, "shoes")) == ["shoes for a wedding outfit", "blue thing shoes"]
    assert column(spark, ["an outfit for a party", "outfit dress", "jeans"], query_text.is_outfit) == [True, False, False]


def test_model_answers_must_be_valid(spark):
    assert column(spark, [" Trousers", "cap", "mauve", None], lambda c: query_text.valid_choice(c, "category")) == ["pants", "hat", None, None]
    assert column(spark, ["4.5", "x", None], lambda c: query_text.valid_choice(c, "min_rating")) == [4.5, None, None]


def test_image_order(spark):
    codes = ["BACK", "TOPP", "main ", "PT01", "BOTT", "FRNT", None, "FRONT2"]
    rows = spark.createDataFrame([([(c, None, f"u{i}", None) for i, c in enumerate(codes)],), ([],), (None,), ([("X", "t", "", None), ("Y", None, None, "h")],)], f"x {images.SCHEMA}")
    assert [r["y"] for r in rows.select(images.display_urls(F.col("x")).alias("y")).collect()] == [["u2", "u3", "u5", "u0", "u1", "u4"], [], [], ["t"]]
    raw = ['[{"variant":"MAIN","large":"a"}]', '{"variant":"PT01","hi_res":"b"}', "https://c", "", None]
    assert column(spark, raw, lambda c: images.display_urls(images.parse(c))) == [["a"], ["b"], ["https://c"], [], []]


def test_sections(spark):
    rows = spark.createDataFrame(
        [("men", "shoes", "Hat Boots"), ("not specified", "not distributed", "Women's bag"), (None, None, "Summer Dress"), (None, "hat", "Plain"), ("KIDS", "jeans", "x"), (None, None, None), ("", "", "flip-flops")],
        "g string, c string, t string",
    )
    g, c, t = F.col("g"), F.col("c"), F.col("t")
    got = [tuple(r) for r in rows.select(sections.effective_gender(g, c, t), sections.is_footwear(c, t), sections.is_accessory(c, t), sections.garment_region(c, t)).collect()]
    assert got == [("men", True, False, None), ("women", False, True, None), ("women", False, False, "dresses"), (None, False, True, None), ("kids", False, False, "lower_body"), (None, False, False, None), (None, True, False, None)]
