"""Queries of the catalogue engine over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes, images, query_text, sections, vocab
from ..functions import reviews as R
from ..operators import catalog, evals, relational, retrieval, vector
from ..operators import reviews as review_ops
from ..sources.tables import table
from . import catalog_sql as S
from .search_plan import Filters, fetch_size, gender_pools, subqueries

#: A fixed unit vector that stands for an embedded query on the eight-dimensional index.
QUERY = [0.5, -0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def products(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.one_per_key(table(spark, folder, "metadata"))


def index(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.latest_rows(table(spark, folder, "vector_index"))


def kept_reviews(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "reviews")
    return review_ops.top_reviews(review_ops.scored(raw), raw)


# --- reviews -----------------------------------------------------------------


@query(f"WITH {S.SCORED} SELECT review_id, score FROM scored")
def review_score(spark, folder):
    return review_ops.scored(table(spark, folder, "reviews")).select("review_id", "score")


@query(f"WITH {S.REVIEWS} SELECT review_id, {S.ASPECTS} AS n_aspects FROM rev WHERE text IS NOT NULL")
def aspect_count(spark, folder):
    rows = table(spark, folder, "reviews").where("review_id is not null and text is not null")
    return rows.select("review_id", R.aspect_count(F.col("text")).cast("long").alias("n_aspects")).distinct()


@query(f"WITH {S.SCORED} SELECT parent_asin, count(rating) AS n_rated, CASE WHEN count(rating) <= 3 THEN count(rating) WHEN count(rating) <= 10 THEN 2 ELSE 3 END AS keep FROM scored WHERE parent_asin IS NOT NULL GROUP BY 1")
def rating_bucket_k(spark, folder):
    return review_ops.counts(review_ops.rated(table(spark, folder, "reviews")))


@query(f"WITH {S.KEPT} SELECT parent_asin, bucket, place, review_id, score FROM kept")
def review_topk(spark, folder):
    return kept_reviews(spark, folder).select("parent_asin", "bucket", "place", "review_id", "score")


@query(f"WITH {S.KEPT}, {S.MAJORITY} SELECT * FROM majority")
def product_sentiment(spark, folder):
    return review_ops.majority_sentiment(kept_reviews(spark, folder))


@query(f"WITH {S.KEPT}, {S.MAJORITY} SELECT overall_sentiment, count(*) AS n_products FROM majority GROUP BY 1")
def sentiment_counts(spark, folder):
    return review_ops.sentiment_counts(kept_reviews(spark, folder))


@query(f"WITH {S.KEPT}, {S.HIGHLIGHTS} SELECT parent_asin, len(review_highlights) AS n_highlights, array_to_string(review_highlights, '|') AS review_highlights FROM mixed")
def review_highlights(spark, folder):
    rows = review_ops.product_reviews(table(spark, folder, "reviews"))
    return rows.select("parent_asin", F.size("review_highlights").alias("n_highlights"), F.array_join("review_highlights", "|").alias("review_highlights"))


@query("""SELECT review_id, CASE WHEN contains(t, 'great') OR contains(t, 'love') THEN 'positive' WHEN contains(t, 'bad') THEN 'negative' ELSE 'neutral' END AS sentiment
FROM (SELECT DISTINCT review_id, lower(coalesce(text, '')) AS t FROM reviews WHERE review_id IS NOT NULL)""")
def review_lexicon_sentiment(spark, folder):
    return table(spark, folder, "reviews").where("review_id is not null").select("review_id", R.lexicon_sentiment(F.col("text")).alias("sentiment")).distinct()


_LABELS = ["1 star", "2 stars", "3 stars", "4 stars", "5 stars", "LABEL_4", "unknown", " 5 STARS ", "12", ""]


@query("SELECT label, CASE WHEN contains(label, '1') OR contains(label, '2') THEN 'negative' WHEN contains(label, '3') THEN 'neutral' WHEN contains(label, '4') OR contains(label, '5') THEN 'positive' ELSE 'neutral' END AS sentiment FROM (SELECT unnest(" + S.values(_LABELS) + ") AS label)")
def star_label(spark, folder):
    return spark.createDataFrame([(x,) for x in _LABELS], "label string").select("label", R.star_label(F.col("label")).alias("sentiment"))


# --- attributes --------------------------------------------------------------


def _attribute(name: str):
    def run(spark, folder):
        return products(spark, folder).select("parent_asin", attributes.ALL[name](F.coalesce("title", F.lit(""))).alias(name))

    run.__name__ = f"attr_{name}"
    return query(f"WITH {S.PRODUCTS} SELECT parent_asin, {S.ATTRIBUTES[name](chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')} AS {name} FROM products")(run)


for _name in attributes.ALL:
    _attribute(_name)


_TITLE = "coalesce(title, '')"


@query(f"WITH {S.PRODUCTS} SELECT {', '.join(f'{f(_TITLE)} AS {n}' for n, f in S.ATTRIBUTES.items())}, count(*) AS n FROM products GROUP BY ALL")
def attr_all(spark, folder):
    got = products(spark, folder).select(attributes.all_attributes(F.coalesce("title", F.lit(""))).alias("a")).select("a.*")
    return got.groupBy(*attributes.ALL).agg(F.count(F.lit(1)).alias("n"))


_ENTITY = r"""CASE WHEN regexp_matches(p, '^#[0-9]{1,7};') THEN chr(regexp_extract(p, '^#([0-9]{1,7});', 1)::INT) || regexp_replace(p, '^#[0-9]{1,7};', '')
WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]{1,6};') THEN chr(('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]{1,6});', 1))::INT) || regexp_replace(p, '^#[xX][0-9a-fA-F]{1,6};', '')
WHEN map_contains(m, regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;')) THEN m[regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;')] || regexp_replace(p, '^[A-Za-z][A-Za-z0-9]*;', '') ELSE '&' || p END"""
_UNESCAPED = f"""u AS (SELECT parent_asin, CASE WHEN contains(title, '&') THEN string_split(title, '&')[1] || array_to_string(list_transform(string_split(title, '&')[2:], lambda p: {_ENTITY}), '') ELSE title END AS title
FROM products, (SELECT map({S.values(list(attributes.ENTITIES))}, {S.values(list(attributes.ENTITIES.values()))}) AS m))"""


@query(rf"WITH {S.PRODUCTS}, {_UNESCAPED} SELECT parent_asin, lower(regexp_replace(trim(regexp_replace(title, '[\s\x{{00A0}}]+', ' ', 'g')), '^[^\pL\pN\pM_&]+|[^\pL\pN\pM_&]+$', '', 'g')) AS normalized FROM u")
def title_normalize(spark, folder):
    return products(spark, folder).select("parent_asin", attributes.normalize_title(F.col("title")).alias("normalized"))


# --- catalogue ---------------------------------------------------------------

_FILLED = f"""{S.KEPT}, {S.MAJORITY}, {S.HIGHLIGHTS}, {S.PRODUCTS},
attrs AS (SELECT parent_asin, title, average_rating, rating_number, images, {S.DESCRIPTION} AS description, {', '.join(f'{f(_TITLE)} AS {n}' for n, f in S.ATTRIBUTES.items())} FROM products),
filled AS (SELECT a.parent_asin, title, average_rating, rating_number, images, size, coalesce(gender, 'not specified') AS gender, coalesce(color, 'not mentioned') AS color,
  coalesce(style, 'not specified') AS style, coalesce(category, 'not distributed') AS category, coalesce(description, 'no description') AS description,
  coalesce(overall_sentiment, 'neutral') AS overall_sentiment, coalesce(review_highlights, []) AS review_highlights
  FROM attrs a LEFT JOIN majority USING (parent_asin) LEFT JOIN mixed USING (parent_asin)),
enriched AS (SELECT *, array_to_string(list_filter(list_transform([title, description, color, gender, size, style, category, overall_sentiment], lambda x: trim(x)), lambda x: x <> ''), ' ') AS combined_text FROM filled)"""


def enriched(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.enrich(products(spark, folder), review_ops.product_reviews(table(spark, folder, "reviews")))


@query(f"WITH {_FILLED} SELECT parent_asin, gender, color, style, category, size, description, overall_sentiment, len(review_highlights) AS n_highlights FROM enriched")
def enrich_catalog(spark, folder):
    return enriched(spark, folder).select("parent_asin", "gender", "color", "style", "category", "size", "description", "overall_sentiment", F.size("review_highlights").alias("n_highlights"))


@query(f"WITH {_FILLED} SELECT parent_asin, combined_text FROM enriched WHERE trim(combined_text) <> ''")
def combined_text(spark, folder):
    return catalog.embeddable(enriched(spark, folder)).select("parent_asin", "combined_text")


@query(f"WITH {S.PRODUCTS} SELECT parent_asin, array_to_string({S.image_urls('images')}, ' ') AS urls FROM products")
def display_images(spark, folder):
    return products(spark, folder).select("parent_asin", F.array_join(images.display_urls(F.col("images")), " ").alias("urls"))


@query(f"WITH {_FILLED} SELECT parent_asin AS id, gender, size, rating_number, coalesce(len(images), -1) AS n_images, len(review_highlights) AS n_highlights FROM enriched")
def metadata_codec(spark, folder):
    """Encode the catalogue to index rows and read their lists back."""
    rows = catalog.encode_rows(enriched(spark, folder))
    n_images = F.coalesce(F.size(F.from_json("images", images.SCHEMA)), F.lit(-1))
    return rows.select("id", "gender", "size", "rating_number", F.when(F.col("images").isNull(), F.lit(-1)).otherwise(n_images).alias("n_images"), F.size(catalog.json_strings(F.col("review_highlights"))).alias("n_highlights"))


@query(f"""WITH {S.INDEX} SELECT id, coalesce(nullif(title, ''), 'Unknown Title') AS title, rating_number, array_to_string(from_json(images, '["VARCHAR"]'), ' ') AS urls,
array_to_string(from_json(review_highlights, '["VARCHAR"]')[1:2], '|') AS snippets FROM cur""")
def decode_index(spark, folder):
    rows = catalog.decode_rows(index(spark, folder))
    return rows.select("id", "title", "rating_number", F.array_join("image_urls", " ").alias("urls"), F.array_join(F.slice("review_highlights", 1, 2), "|").alias("snippets"))


@query(f"WITH {S.INDEX} SELECT id, title, rating_number, epoch_us(indexed_at) AS indexed_us FROM cur")
def index_current(spark, folder):
    return index(spark, folder).select("id", "title", "rating_number", F.unix_micros("indexed_at").alias("indexed_us"))


@query("SELECT count(*) AS n_written, count(DISTINCT id) AS n_keys FROM vector_index")
def index_stats(spark, folder):
    per_key = table(spark, folder, "vector_index").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("n_written"), F.count("id").alias("n_keys"))


# --- relational --------------------------------------------------------------


@query("SELECT count(*) AS n_rows, count(DISTINCT review_id) AS n_reviews FROM reviews WHERE parent_asin IN (SELECT id FROM vector_index)")
def semi_join_reviews(spark, folder):
    ids = table(spark, folder, "vector_index").select(F.col("id").alias("parent_asin"))
    per_id = relational.rows_of_keys(table(spark, folder, "reviews").select("review_id", "parent_asin"), ids, "parent_asin").groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.sum("n").alias("n_rows"), F.count("review_id").alias("n_reviews"))


_ORPHANS = "o AS (SELECT parent_asin FROM reviews WHERE parent_asin IS NOT NULL AND parent_asin NOT IN (SELECT parent_asin FROM metadata WHERE parent_asin IS NOT NULL))"


@query(f"WITH {_ORPHANS} SELECT count(*) AS n_orphans, (SELECT array_to_string(list(parent_asin ORDER BY parent_asin), ' ') FROM (SELECT DISTINCT parent_asin FROM o ORDER BY 1 LIMIT 5)) AS examples FROM o")
def orphan_reviews(spark, folder):
    keys = table(spark, folder, "metadata").select("parent_asin")
    return relational.orphan_summary(table(spark, folder, "reviews").select("parent_asin"), keys, "parent_asin").withColumn("examples", F.array_join("examples", " "))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def left_join_orders(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey", "left").select("o_orderkey", "c_name")


# --- vector search -----------------------------------------------------------


@query(f"WITH {S.INDEX} SELECT id, {S.score(QUERY)} AS score, row_number() OVER (ORDER BY {S.score(QUERY)} DESC, id) AS rank FROM cur WHERE vec IS NOT NULL QUALIFY rank <= 20")
def dense_topk(spark, folder):
    return vector.nearest(index(spark, folder), QUERY, 20)


_FILTERS = Filters(style="casual", sentiment="positive", min_rating=3.5, exclude_genders=("men", "kids"), categories=("dress", "skirt", "sneakers", "jacket", "swimsuit", "tote", "gloves", "socks"))
_WHERE = " AND ".join([S.hard(_FILTERS), *(S.soft(_FILTERS, n) for n in _FILTERS.soft())])


@query(f"WITH {S.INDEX} SELECT id, {S.score(QUERY)} AS score, row_number() OVER (ORDER BY {S.score(QUERY)} DESC, id) AS rank FROM cur WHERE {_WHERE} QUALIFY rank <= 20")
def filtered_topk(spark, folder):
    return vector.nearest(index(spark, folder), QUERY, 20, _FILTERS.predicate())


@query("""SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10""")
def batch_topk(spark, folder):
    """Ten nearest rows of every row whose id is divisible by 50, against all rows."""
    rows = table(spark, folder, "embeddings")
    asked = rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.nearest_many(rows, asked, 10, "vec_id", "embedding")


@query("""SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id QUALIFY rank <= 7""")
def similar_items(spark, folder):
    """Seven rows most similar to an item, without itself."""
    rows = table(spark, folder, "embeddings")
    asked = rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.nearest_many(rows, asked, 7, "vec_id", "embedding", keep_self=False)


# --- retrieval ---------------------------------------------------------------

_SOFT = Filters(gender="kids", color="beige", style="casual", size="s", min_rating=4.0, sentiment="positive")
_OUTFIT = Filters(style="casual", color="black")


@query(f"WITH {S.relaxed(subqueries(_SOFT), QUERY, False)} SELECT sq_id, id, score, rank, chosen FROM relaxed")
def relaxed_topk(spark, folder):
    plan = subqueries(_SOFT)
    rows = retrieval.relaxed(index(spark, folder), plan, QUERY, {p.number: fetch_size(p.group) for p in plan}, keep=[])
    return rows.select("sq_id", "id", "score", "rank", "chosen")


@query(f"WITH {S.relaxed(subqueries(_OUTFIT, True), QUERY, True)} SELECT sq_id, id, score, rank, chosen FROM relaxed")
def relax_all(spark, folder):
    plan = subqueries(_OUTFIT, True)
    rows = retrieval.relaxed(index(spark, folder), plan, QUERY, {p.number: fetch_size(p.group) for p in plan}, True, keep=[])
    return rows.select("sq_id", "id", "score", "rank", "chosen")


@query("""SELECT * FROM (VALUES ('none', 0, 'not in men, kids'), ('none', 1, 'men'), ('women', 0, 'women'), ('dress', 0, 'not in men, kids'), ('jeans', 0, 'not in men, kids'), ('jeans', 1, 'men')) t(filters, pool, gender)""")
def gender_pool_plan(spark, folder):
    asked = {"none": Filters(), "women": Filters(gender="women"), "dress": Filters(category="dress"), "jeans": Filters(category="jeans")}
    rows = [(name, i, f.gender or "not in " + ", ".join(f.exclude_genders)) for name, base in asked.items() for i, f in enumerate(gender_pools(base))]
    return spark.createDataFrame(rows, "filters string, pool int, gender string")


@query("""SELECT row_number() OVER (ORDER BY p, g) - 1 AS sq_id, p AS pool, gname AS "group", n AS n_categories
FROM (VALUES (0), (1)) a(p), (VALUES (0, 'tops', 7), (1, 'bottoms', 5), (2, 'footwear', 2), (3, 'accessories', 0)) b(g, gname, n)""")
def outfit_plan(spark, folder):
    rows = [(p.number, p.pool, p.group, len(p.filters.categories)) for p in subqueries(_OUTFIT, True)]
    return spark.createDataFrame(rows, "sq_id int, pool int, `group` string, n_categories int")


@query(f"""WITH {S.INDEX}, lists AS (SELECT style AS l, id, average_rating AS r, row_number() OVER (PARTITION BY style ORDER BY average_rating DESC, id) AS k FROM cur WHERE style IS NOT NULL AND average_rating IS NOT NULL QUALIFY k <= 10),
heads AS (SELECT l, max(CASE WHEN k = 1 THEN r END) AS h FROM lists GROUP BY 1), turns AS (SELECT l, row_number() OVER (ORDER BY h DESC, l) AS t FROM heads)
SELECT l AS list_id, id, row_number() OVER (ORDER BY k, t) AS position FROM lists JOIN turns USING (l)""")
def interleave_lists(spark, folder):
    from pyspark.sql import Window

    rows = index(spark, folder).where("style is not null and average_rating is not null").select(F.col("style").alias("list_id"), "id", "average_rating")
    order = Window.partitionBy("list_id").orderBy(F.desc("average_rating"), F.asc("id"))
    few = rows.withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    return retrieval.interleave(few, "list_id", "rank", "id", "average_rating").select("list_id", "id", "position")


_CANDIDATE = "array_to_string(list_filter(list_transform([title, description, category, color, style, gender], lambda x: trim(x)), lambda x: x <> ''), ' ')"


def _word_score(words: list[str], body: str) -> str:
    return f"CASE WHEN trim({body}) = '' THEN '-inf'::DOUBLE ELSE ({' + '.join(f'contains(lower({body}), {S.text(w)})::INT' for w in words)})::DOUBLE END"


_RERANK_TEXT = "soft casual cotton dress for kids"


@query(f"""WITH {S.INDEX}, best AS (SELECT cur.*, {S.score(QUERY)} AS score, row_number() OVER (ORDER BY {S.score(QUERY)} DESC, id) AS dense FROM cur QUALIFY dense <= 48)
SELECT id, dense, {_word_score(_RERANK_TEXT.split(), _CANDIDATE)} AS rerank, row_number() OVER (ORDER BY {_word_score(_RERANK_TEXT.split(), _CANDIDATE)} DESC, dense) AS rank FROM best""")
def rerank(spark, folder):
    from pyspark.sql import Window

    rows = index(spark, folder)
    best = vector.nearest(rows, QUERY, 48).withColumnRenamed("rank", "dense")
    told = F.broadcast(best).join(rows.drop("vec"), "id").select("id", "dense", retrieval.word_score(retrieval.query_words(F.lit(_RERANK_TEXT)), catalog.candidate_text()).alias("rerank"))
    return told.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rerank"), F.asc("dense"))))


def _search_sql(plan, text: str, all_at_once: bool, top_k: int) -> str:
    groups = list(dict.fromkeys(p.group for p in plan))
    about = ", ".join(f"({p.number}, {p.pool}, {S.text(p.group or '')}, {groups.index(p.group)})" for p in plan)
    share = max(2, 48 // len(plan))
    swap = {"": text} | {g: _first_swap(text, n) for g, n in vocab.GROUP_NOUNS.items()}
    score = "CASE " + " ".join(f"WHEN grp = {S.text(g or '')} THEN {_word_score(list(dict.fromkeys(swap[g or ''].lower().split())), _CANDIDATE)}" for g in groups) + " END"
    return f"""WITH {S.relaxed(plan, QUERY, all_at_once)}, about(sq_id, pool, grp, grp_no) AS (VALUES {about}),
few AS (SELECT relaxed.*, pool, grp, grp_no, row_number() OVER (PARTITION BY sq_id ORDER BY rank) AS dense FROM relaxed JOIN about USING (sq_id) WHERE grp <> 'accessories' OR {S.accessory('category', 'title')} QUALIFY dense <= {share}),
scored AS (SELECT *, {score} AS rerank FROM few),
placed AS (SELECT *, row_number() OVER (PARTITION BY sq_id ORDER BY rerank DESC, dense) AS place FROM scored),
h1 AS (SELECT *, max(CASE WHEN place = 1 THEN rerank END) OVER (PARTITION BY sq_id) AS h FROM placed),
t1 AS (SELECT *, dense_rank() OVER (PARTITION BY grp ORDER BY h DESC, sq_id) AS t FROM h1),
o1 AS (SELECT * FROM t1 QUALIFY row_number() OVER (PARTITION BY grp, id ORDER BY place, t) = 1),
g1 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY place, t) AS in_group FROM o1),
h2 AS (SELECT *, max(CASE WHEN in_group = 1 THEN rerank END) OVER (PARTITION BY grp) AS hh FROM g1),
t2 AS (SELECT *, dense_rank() OVER (ORDER BY hh DESC, grp_no) AS tt FROM h2),
o2 AS (SELECT * FROM t2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY in_group, tt) = 1)
SELECT id, position AS rank, grp AS "group", pool, score, rerank FROM (SELECT *, row_number() OVER (ORDER BY in_group, tt) AS position FROM o2) WHERE position <= least({top_k}, (SELECT count(*) FROM placed))"""


def _first_swap(text: str, noun: str) -> str:
    import re

    out, n = re.subn(rf"(?i)\b(?:{vocab.GENERAL_TERMS})\b", noun, text, count=1)
    return out if n else f"{text} {noun}"


_SEARCH_TEXT, _OUTFIT_TEXT = "casual beige piece for kids", "an outfit for a wedding"


@query(_search_sql(subqueries(_SOFT), _SEARCH_TEXT, False, 36))
def search_normal(spark, folder):
    return retrieval.search(index(spark, folder), subqueries(_SOFT), _SEARCH_TEXT, QUERY, 36)


@query(_search_sql(subqueries(_OUTFIT, True), _OUTFIT_TEXT, True, 36))
def search_outfit(spark, folder):
    return retrieval.search(index(spark, folder), subqueries(_OUTFIT, True), _OUTFIT_TEXT, QUERY, 36)


# --- query understanding -----------------------------------------------------

_ASKED = [
    "blue jeans under 50", "a dress for my wife", "girls party dress", "outfit for my husband for a party", "dress shirt", "dress pants for office", "black dress shoes", "pizza recipes",
    "what's the weather today", "shoes between 20-35 rated 4+", "highly rated red hoodie over $30", "a 4.5 star jacket", "size XL grey sweatpants", "something to wear to college", "gift for him and her",
    "wedding attire", "my mother's navy-blue coat", "sporty sneakers less than 40", "kids extra large tee", "casual look", "bitcoin price", "venues near me", "Vintage Dresses",
]
_ROWS = "asked AS (SELECT unnest(" + S.values(_ASKED) + ") AS q)"


def _asked(spark) -> tuple[DataFrame, Column]:
    return spark.createDataFrame([(x,) for x in _ASKED], "q string"), F.col("q")


_NUM = r"(\d+(?:\.\d+)?)"
_GOT = lambda pattern, group: f"TRY_CAST(nullif(regexp_extract(q, {S.text(pattern)}, {group}), '') AS DOUBLE)"
_RANGE = rf"(?i)\$?\s*{_NUM}\s*(?:-|to)\s*\$?\s*{_NUM}"


@query(f"""WITH {_ROWS}, p AS (SELECT q, {_GOT(_RANGE, 1)} AS a, {_GOT(_RANGE, 2)} AS b, {_GOT(rf'(?i)\b(?:under|below|less than|<)\s*\$?\s*{_NUM}', 1)} AS u, {_GOT(rf'(?i)\b(?:over|above|more than|>)\s*\$?\s*{_NUM}', 1)} AS o FROM asked)
SELECT q, CASE WHEN a IS NOT NULL THEN least(a, b) WHEN u IS NULL THEN o END AS price_min, CASE WHEN a IS NOT NULL THEN greatest(a, b) ELSE u END AS price_max FROM p""")
def parse_price(spark, folder):
    rows, q = _asked(spark)
    return rows.select("q", query_text.price_range(q).alias("p")).select("q", "p.*")


_PRAISE = "regexp_matches(q, " + S.text(r"(?i)\b(" + "|".join(vocab.RATING_PHRASES) + r")\b") + ")"
_STARS = r"(?i)\b(\d(?:\.\d)?)\s*\+?\s*stars?\b|\brated?\s*(\d(?:\.\d)?)\s*\+"


@query(f"WITH {_ROWS} SELECT q, coalesce({_GOT(_STARS, 1)}, {_GOT(_STARS, 2)}, CASE WHEN {_PRAISE} THEN 4.0 END) AS min_rating, CASE WHEN {_PRAISE} THEN 'positive' END AS sentiment FROM asked")
def parse_rating(spark, folder):
    rows, q = _asked(spark)
    return rows.select("q", query_text.min_rating(q).alias("min_rating"), query_text.sentiment(q).alias("sentiment"))


_HER, _HIM = ("regexp_matches(q, " + S.text(r"(?i)\b(" + "|".join(vocab.RELATIONS[g]) + r")\b") + ")" for g in ("women", "men"))
_Q_CATEGORY = f"CASE WHEN {S.category('q')} = 'dress' THEN coalesce({S.category('d')}, 'dress') ELSE {S.category('q')} END"
_WITHOUT = r"regexp_replace(q, '(?i)\bdress(es)?\b', ' ', 'g') AS d"


@query(f"WITH {_ROWS}, w AS (SELECT q, {_WITHOUT} FROM asked) SELECT q, coalesce({S.gender('q')}, CASE WHEN {_HER} AND NOT {_HIM} THEN 'women' WHEN {_HIM} AND NOT {_HER} THEN 'men' END) AS gender, {_Q_CATEGORY} AS category, {S.color('q')} AS color, {S.style('q')} AS style, {S.size('q')} AS size FROM w")
def parse_attributes(spark, folder):
    rows, q = _asked(spark)
    return rows.select("q", query_text.filters(q).alias("f")).select("q", "f.gender", "f.category", "f.color", "f.style", "f.size")


_TERM = lambda w: f"list_contains({S.values(vocab.FASHION_TERMS)}, {w})"


@query(f"WITH {_ROWS} SELECT q, len(list_filter(regexp_extract_all(lower(q), '[a-z]+'), lambda w: {_TERM('w')} OR {_TERM('rtrim(w, ' + chr(39) + 's' + chr(39) + ')')} OR {_TERM('regexp_replace(w, ' + chr(39) + 'es$' + chr(39) + ', ' + chr(39) * 2 + ')')})) > 0 AS is_fashion FROM asked")
def fashion_guard(spark, folder):
    rows, q = _asked(spark)
    return rows.select("q", query_text.has_fashion_term(q).alias("is_fashion"))


_PERSON = r"(?i)\s*\b(?:for\s+)?(?:my|his|her|our)\s+(?:" + "|".join(vocab.RELATION_NOUNS) + r")(?:'s)?\b"


@query(f"WITH {_ROWS} SELECT q, coalesce(nullif(trim(regexp_replace(regexp_replace(q, {S.text(_PERSON)}, '', 'g'), '\\s{{2,}}', ' ', 'g')), ''), q) AS stripped FROM asked")
def relation_strip(spark, folder):
    rows, q = _asked(spark)
    return rows.select("q", query_text.without_relations(q).alias("stripped"))


_GENERAL = S.text(rf"(?i)\b(?:{vocab.GENERAL_TERMS})\b")


@query(f"WITH {_ROWS}, w AS (SELECT q, {_WITHOUT} FROM asked) SELECT q, regexp_matches(q, {_GENERAL}) AND ({_Q_CATEGORY}) IS NULL AS is_outfit, CASE WHEN regexp_matches(q, {_GENERAL}) THEN regexp_replace(q, {_GENERAL}, 'shoes') ELSE q || ' shoes' END AS footwear_text FROM w")
def group_query(spark, folder):
    rows, q = _asked(spark)
    return rows.select("q", query_text.is_outfit(q).alias("is_outfit"), query_text.group_text(q, "shoes").alias("footwear_text"))


_ANSWERS = [("blue jeans under 50", "green", "casual"), ("wedding attire", "Silver ", "gown"), ("a dress for my wife", "mauve", "ELEGANT")]
_ANSWER_ROWS = "answers(q, m_color, m_style) AS (VALUES " + ", ".join(f"({S.text(a)}, {S.text(b)}, {S.text(c)})" for a, b, c in _ANSWERS) + ")"


def _merge_sql(name: str, rule: str) -> str:
    ok = f"CASE WHEN list_contains({S.values(query_text.MODEL_FIELDS[name])}, lower(trim(m_{name}))) THEN lower(trim(m_{name})) END"
    return f"coalesce({rule}, {ok}) AS {name}, CASE WHEN {rule} IS NOT NULL THEN 'regex' WHEN {ok} IS NOT NULL THEN 'llm' END AS {name}_source"


@query(f"WITH {_ROWS}, {_ANSWER_ROWS} SELECT q, {_merge_sql('color', S.color('q'))}, {_merge_sql('style', S.style('q'))} FROM asked LEFT JOIN answers USING (q)")
def merge_sources(spark, folder):
    """Rules first, then a model's valid answers; a query without an answer keeps the rules alone."""
    rows, q = _asked(spark)
    told = rows.join(F.broadcast(spark.createDataFrame(_ANSWERS, "q string, m_color string, m_style string")), "q", "left")
    out = [told["q"]]
    for name, rule in (("color", attributes.color(q)), ("style", attributes.style(q))):
        value, source = query_text.merged(rule, F.col(f"m_{name}"), name)
        out += [value.alias(name), source.alias(f"{name}_source")]
    return told.select(*out)


@query("SELECT * FROM (VALUES (0, 'color', 'beige'), (0, 'gender', 'kids'), (0, 'min_rating', '4.0'), (0, 'sentiment', 'positive'), (0, 'size', 's'), (0, 'style', 'casual'), (3, 'color', 'beige'), (3, 'gender', 'kids'), (3, 'size', 's')) t(level, name, value)")
def applied_filters(spark, folder):
    """Filters shown after giving up none and three of the soft ones."""
    rows = [(level, n, str(v)) for level in (0, 3) for n, v in _SOFT.after(level, False).applied().items()]
    return spark.createDataFrame(rows, "level int, name string, value string")


# --- sections ----------------------------------------------------------------

_SECTIONS = f"sec AS (SELECT id, average_rating, {S.effective_gender('gender', 'category', 'title')} AS gender, {S.footwear('category', 'title')} AS is_footwear, {S.accessory('category', 'title')} AS is_accessory, {S.region('category', 'title')} AS garment_region FROM cur)"


def _sections(spark, folder) -> DataFrame:
    g, c, t = F.col("gender"), F.col("category"), F.col("title")
    return index(spark, folder).select(
        "id", "average_rating", "title", sections.effective_gender(g, c, t).alias("gender"), sections.is_footwear(c, t).alias("is_footwear"), sections.is_accessory(c, t).alias("is_accessory"), sections.garment_region(c, t).alias("garment_region")
    )


@query(f"WITH {S.INDEX}, {_SECTIONS} SELECT id, gender, is_footwear, is_accessory, garment_region FROM sec")
def section_flags(spark, folder):
    return _sections(spark, folder).drop("average_rating", "title")


@query(f"""WITH {S.INDEX}, {_SECTIONS} SELECT count(*) AS "all", count_if(coalesce(gender IN ('men', 'unisex'), false)) AS men, count_if(coalesce(gender IN ('women', 'unisex'), false)) AS women,
count_if(coalesce(gender = 'kids', false)) AS kids, count_if(is_footwear) AS footwear, count_if(is_accessory) AS accessories FROM sec WHERE coalesce(average_rating, 0) >= 3.5""")
def tab_counts(spark, folder):
    """Results per tab, with a minimum rating; an unknown rating counts as 0."""
    rows = _sections(spark, folder).where(F.coalesce("average_rating", F.lit(0.0)) >= 3.5)
    tabs = ["all", "men", "women", "kids", "footwear", "accessories"]
    return rows.agg(*[F.count_if(sections.in_tab(t, F.col("gender"), F.col("is_footwear"), F.col("is_accessory"))).alias(t) for t in tabs])


@query("WITH " + S.INDEX + " SELECT id, array_to_string(list_transform([1, 2, 3, 4, 5], lambda n: CASE WHEN coalesce(average_rating, 0) >= n - 0.25 THEN 'full' WHEN coalesce(average_rating, 0) >= n - 0.75 THEN 'half' ELSE 'empty' END), ' ') AS stars FROM cur")
def star_buckets(spark, folder):
    return index(spark, folder).select("id", F.array_join(sections.star_fill(F.col("average_rating")), " ").alias("stars"))


_URLS = ["https://m.media-amazon.com/a.jpg", "http://m.media-amazon.com/a.jpg", "https://media-amazon.com/x", "https://evilmedia-amazon.com/x", "https://images-amazon.com.evil.example/x", "not a url", "https://IMAGES-AMAZON.COM/i", ""]


@query("SELECT u AS url, coalesce(regexp_matches(u, '(?i)^https://([^/@]+\\.)?(media-amazon\\.com|images-amazon\\.com|ssl-images-amazon\\.com)(/|$)'), false) AS allowed FROM (SELECT unnest(" + S.values(_URLS) + ") AS u)")
def url_allowlist(spark, folder):
    return spark.createDataFrame([(u,) for u in _URLS], "url string").select("url", sections.allowed_image(F.col("url")).alias("allowed"))


# --- evaluation --------------------------------------------------------------

# Search calls are drawn from the events table: an event is a call, its value the latency in 100 ms.
_CALLS = "calls AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 500 ELSE 200 END AS status, value * 100 AS latency_ms, event_id % 53 = 0 AS flaky, event_type = 'purchase' AS outfit, event_id % 11 AS n_results, event_id % 3 AS filter_hits, 2 AS filter_total FROM events)"


def _calls(spark, folder) -> DataFrame:
    e = F.col("event_id")
    return table(spark, folder, "events").select(
        F.when(e % 97 == 0, 500).otherwise(200).alias("status"), (F.col("value") * 100).alias("latency_ms"), (e % 53 == 0).cast("int").alias("flakes"), (F.col("event_type") == "purchase").alias("outfit"),
        (e % 11).alias("n_results"), (e % 3).alias("filter_hits"), F.lit(2).alias("filter_total"), (e % 5 / 4.0).alias("category_conformance"), F.when(e % 2 == 0, e % 7 / 6.0).alias("gender_conformance"),
        F.when(F.col("event_type") == "purchase", e % 4 / 4.0).alias("outfit_coverage"),
    )


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_percentiles(spark, folder):
    return evals.percentiles(table(spark, folder, "events"), "value", ["event_type"])


_METRICS = f"""{_CALLS}, scores AS (SELECT *, event_id % 5 / 4.0 AS category_conformance, CASE WHEN event_id % 2 = 0 THEN event_id % 7 / 6.0 END AS gender_conformance, CASE WHEN outfit THEN event_id % 4 / 4.0 END AS outfit_coverage FROM calls),
m AS (SELECT round(avg((status <> 200)::INT), 3) AS error_rate, round(avg((n_results = 0)::INT) FILTER (status = 200), 3) AS empty_rate, sum(flaky::INT) AS network_flakes,
coalesce(round(quantile_disc(latency_ms, 0.5) FILTER (status = 200)), 0) AS latency_p50_ms, coalesce(round(quantile_disc(latency_ms, 0.95) FILTER (status = 200)), 0) AS latency_p95_ms,
coalesce(round(quantile_disc(latency_ms, 0.95) FILTER (status = 200 AND NOT outfit)), 0) AS latency_p95_ms_normal, coalesce(round(quantile_disc(latency_ms, 0.95) FILTER (status = 200 AND outfit)), 0) AS latency_p95_ms_outfit,
round(sum(filter_hits) FILTER (status = 200) / sum(filter_total) FILTER (status = 200), 3) AS filter_accuracy, round(avg(category_conformance) FILTER (status = 200), 3) AS category_conformance,
round(avg(gender_conformance) FILTER (status = 200), 3) AS gender_conformance, round(avg(outfit_coverage) FILTER (status = 200), 3) AS outfit_coverage FROM scores)"""


@query(f"WITH {_METRICS} SELECT * FROM m")
def eval_metrics(spark, folder):
    return evals.metrics(_calls(spark, folder))


@query(f"WITH {_METRICS} SELECT metric, value, passed FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, {n}::DOUBLE AS value, coalesce({n} {op} {v}, false) AS passed FROM m" for n, (op, v) in evals.THRESHOLDS.items()) + ")")
def eval_verdicts(spark, folder):
    return evals.verdicts(evals.metrics(_calls(spark, folder)))


_NEEDLES = ["jacket", "coat", "parka"]


@query(f"WITH {S.INDEX}, {_SECTIONS}, calls AS (SELECT style AS call_id, cur.title, sec.*, row_number() OVER (PARTITION BY style ORDER BY cur.average_rating DESC NULLS LAST, cur.id) AS rank FROM cur JOIN sec ON cur.id = sec.id WHERE style IS NOT NULL) SELECT call_id, count(*) AS n_results, round(avg((contains(lower(title), 'jacket') OR contains(lower(title), 'coat') OR contains(lower(title), 'parka'))::INT), 6) AS category_conformance, round(avg((coalesce(gender IN ('women', 'unisex'), true))::INT), 6) AS gender_conformance, (max(is_footwear::INT) + max(is_accessory::INT) + max((coalesce(garment_region, '') = 'upper_body')::INT) + max((coalesce(garment_region, '') = 'lower_body')::INT)) / 4.0 AS outfit_coverage FROM calls WHERE rank <= 10 GROUP BY 1")
def conformance(spark, folder):
    from pyspark.sql import Window

    order = Window.partitionBy("call_id").orderBy(F.desc_nulls_last("average_rating"), F.asc("id"))
    styles = index(spark, folder).where("style is not null").select("id", F.col("style").alias("call_id"))
    results = _sections(spark, folder).join(styles, "id").withColumn("rank", F.row_number().over(order)).withColumnRenamed("garment_region", "region")
    cases = styles.select("call_id").distinct().select("call_id", F.lit(True).alias("outfit"), F.lit("women").alias("want_gender"), F.array(*map(F.lit, _NEEDLES)).alias("title_any"), F.lit(0).alias("filter_hits"), F.lit(0).alias("filter_total"))
    return evals.call_scores(results, cases).select("call_id", "n_results", F.round("category_conformance", 6).alias("category_conformance"), F.round("gender_conformance", 6).alias("gender_conformance"), "outfit_coverage")
