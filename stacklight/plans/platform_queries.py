"""Queries of sources, sinks, batches, models and requests, with their SQL. Written tables go to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sections, vocab
from ..operators import evals, models, relational, retrieval
from ..session import shared_folder
from ..sources import files
from ..sources.tables import table
from ..streaming import ingest
from . import catalog_queries as C
from . import catalog_sql as S
from .search_plan import fetch_size, subqueries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
BATCHES = 8


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _place(spark: SparkSession) -> str:
    """A new folder, deleted when the process ends."""
    path = f"{shared_folder(spark).rstrip('/')}/query-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


# --- sources and sinks ---------------------------------------------------------


@query("SELECT 'metadata' AS kind, count(*) AS n_rows FROM metadata UNION ALL SELECT 'reviews', count(*) FROM reviews")
def footer_check(spark, folder):
    """Paths and columns checked, rows counted from the footers."""
    rows = [(name, relational.check_table(spark, f"{folder}/{name}.parquet", kind)) for name, kind in (("metadata", "products"), ("reviews", "reviews"))]
    return spark.createDataFrame(rows, "kind string, n_rows long")


@query("SELECT parent_asin, title, rating_number, price, len(images) AS n_images, len(description) AS n_paragraphs FROM metadata")
def jsonl_roundtrip(spark, folder):
    """The catalogue as JSON lines, found by its name and converted back."""
    place = _place(spark)
    table(spark, folder, "metadata").write.option("ignoreNullFields", "false").json(f"{place}/meta_all.jsonl")
    found, _ = files.discover(spark, place)
    rows = files.jsonl_to_parquet(spark, found, f"{place}/metadata.parquet", files.PRODUCTS)
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return rows.select("parent_asin", "title", "rating_number", "price", count("images").alias("n_images"), count("description").alias("n_paragraphs"))


@query("SELECT true AS refused, count(*) AS n_rows FROM delisted")
def overwrite_refused(spark, folder):
    """A target that exists is kept unless overwriting is asked for."""
    place, rows = _place(spark), table(spark, folder, "delisted")
    files.write_table(rows, place)
    try:
        files.write_table(rows.limit(0), place)
        refused = False
    except Exception:  # noqa: BLE001
        refused = True
    return spark.read.parquet(place).agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n_rows"))


@query("SELECT id, epoch_us(max(indexed_at)) AS indexed_us FROM vector_index WHERE id IS NOT NULL GROUP BY id")
def upsert_index(spark, folder):
    """The index written in two deliveries, older rows first; the last write of a key stays."""
    place, rows = _place(spark), table(spark, folder, "vector_index").select("id", "title", "indexed_at", "vec")
    middle = rows.agg(F.percentile_approx(F.unix_micros("indexed_at"), 0.5).alias("m")).first()["m"] or 0
    late = F.coalesce(F.unix_micros("indexed_at") > middle, F.lit(False))
    for part in (rows.where(~late), rows.where(late), rows.where(late)):  # a repeated delivery changes nothing
        ingest.upsert(part, place, "id", "indexed_at")
    return spark.read.parquet(place).select("id", F.unix_micros("indexed_at").alias("indexed_us"))


@query("SELECT * FROM (VALUES (1, true, 0), (2, false, 0)) t(attempt, created, n_rows)")
def index_created(spark, folder):
    """An index table is created once; one of another length is refused."""
    place = _place(spark)
    made = [(n, files.ensure_index(spark, place, "id string, vec array<float>", 8), files.ensure_table(spark, place, "id string, vec array<float>").count()) for n in (1, 2)]
    try:
        files.ensure_index(spark, place, "id string, vec array<float>", 16)
        raise AssertionError("an index of another length was accepted")
    except ValueError:
        return spark.createDataFrame(made, "attempt int, created boolean, n_rows int")


@query("SELECT parent_asin, price FROM metadata WHERE title IS NULL")
def failure_log(spark, folder):
    """Products that cannot be indexed, appended to a log and read back."""
    place, bad = _place(spark), table(spark, folder, "metadata").where("title is null").select("parent_asin", "price")
    files.append_log(bad, place)
    return spark.read.schema("parent_asin string, price double, logged_at timestamp").json(place).where("logged_at is not null").drop("logged_at")


@query(C.ORACLE["tab_counts"])
def report_file(spark, folder):
    """The counts per tab, written as a JSON report and read back."""
    place, rows = _place(spark), C.QUERIES["tab_counts"](spark, folder)
    files.write_report(rows, place)
    return spark.read.schema(rows.schema).json(place)


@query("SELECT 3 AS n_products, 4 AS n_reviews, 1693526400000 AS at")
def sample_data(spark, folder):
    products, reviews = files.sample_tables(spark)
    return reviews.agg(F.lit(products.count()).alias("n_products"), F.count(F.lit(1)).alias("n_reviews"), F.max("timestamp").alias("at"))


# --- batches -------------------------------------------------------------------

_B = lambda key, n=BATCHES: f"(coalesce(('0x' || substr(md5({key}), 1, 8))::UBIGINT % {n}, 0))::INT"
_ONE = "p AS (SELECT DISTINCT parent_asin FROM metadata WHERE parent_asin IS NOT NULL)"


@query(f"WITH {_ONE} SELECT {_B('parent_asin')} AS batch, count(*) AS n_products FROM p GROUP BY 1")
def batch_plan(spark, folder):
    """Products per hash batch."""
    return ingest.batch_sizes(C.products(spark, folder).where("parent_asin is not null"), BATCHES)


@query(f"WITH {_ONE}, b AS (SELECT {_B('parent_asin')} AS batch, count(*) AS n FROM p GROUP BY 1) SELECT batch, CASE WHEN batch = 3 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN batch = 3 THEN 0 ELSE n END AS n_rows FROM b")
def batch_ledger(spark, folder):
    """A run over all batches of which one fails on every attempt: the last entry of each."""
    place = _place(spark)
    products = C.products(spark, folder).where("parent_asin is not null").select("parent_asin", "title")

    def transform(df: DataFrame) -> DataFrame:
        if df.where(ingest.batch_of(BATCHES) == 3).limit(1).count():
            raise RuntimeError("broken")
        return df

    ingest.run(spark, products, transform, f"{place}/index", f"{place}/ledger", BATCHES, attempts=2, sleep=lambda s: None)
    ledger = spark.read.parquet(f"{place}/ledger")
    rows = ledger.groupBy("batch").agg(F.max_by("n_rows", "at").alias("n_rows"))
    return ingest.latest_status(ledger).join(rows, "batch").select("batch", "status", "n_rows")


@query("SELECT * FROM (VALUES ('open', 1), ('open', 2), ('open', 4), ('failed', 1), ('failed', 4), ('new', 2), ('first', 1)) t(asked, batch)")
def pending_batches(spark, folder):
    """Batches left by a ledger: all, only failed ones, without failed ones, and the first of all."""
    entries = [(0, "failed", 1), (0, "completed", 2), (1, "failed", 1), (3, "completed", 1), (4, "completed", 1), (4, "failed", 2)]
    ledger = spark.createDataFrame(entries, "batch int, status string, at int")
    asked = {"open": {}, "failed": {"only_failed": True}, "new": {"skip_failed": True}, "first": {"most": 1}}
    parts = [ingest.pending(spark, ledger, 5, **how).select(F.lit(name).alias("asked"), "batch") for name, how in asked.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {_ONE}, s AS ({C.ORACLE['product_sentiment']}), e AS (SELECT p.parent_asin, s.overall_sentiment AS o FROM p LEFT JOIN s USING (parent_asin)),
a AS (SELECT {_B('parent_asin')} AS batch, count(*) AS n_products, count_if(o = 'positive') AS n_positive, count_if(o = 'neutral') AS n_neutral, count_if(o = 'negative') AS n_negative FROM e GROUP BY 1),
r AS (SELECT {_B('parent_asin')} AS batch, count(*) AS n_reviews FROM reviews GROUP BY 1), v AS (SELECT {_B('id')} AS batch, count(*) AS n_vectors FROM vector_index GROUP BY 1)
SELECT b::INT AS batch, coalesce(n_products, 0) AS n_products, coalesce(n_reviews, 0) AS n_reviews, coalesce(n_vectors, 0) AS n_vectors, coalesce(n_positive, 0) AS n_positive, coalesce(n_neutral, 0) AS n_neutral, coalesce(n_negative, 0) AS n_negative
FROM range({BATCHES}) t(b) LEFT JOIN a ON b = a.batch LEFT JOIN r ON b = r.batch LEFT JOIN v ON b = v.batch""")
def batch_counts(spark, folder):
    """Products, reviews, vectors and sentiments of every batch."""
    keys = C.products(spark, folder).where("parent_asin is not null").select("parent_asin")
    enriched = keys.join(C.QUERIES["product_sentiment"](spark, folder).select("parent_asin", "overall_sentiment"), "parent_asin", "left")
    return ingest.batch_report(enriched, table(spark, folder, "reviews"), table(spark, folder, "vector_index"), BATCHES)


@query("SELECT parent_asin, max(rating_number) AS rating_number FROM metadata WHERE parent_asin IS NOT NULL GROUP BY 1")
def stream_ingest(spark, folder):
    """The catalogue taken in as a stream of files, twice; of a key's rows the one with the most ratings stays."""
    place, rows = _place(spark), table(spark, folder, "metadata").select("parent_asin", "rating_number")
    for _ in range(2):  # redelivered files are new files to the stream, but no new keys
        rows.write.mode("append").parquet(f"{place}/in")
        ingest.stream_files(spark, f"{place}/in", "parent_asin string, rating_number long", lambda df: df, f"{place}/out", f"{place}/state", "parent_asin", "rating_number")
    return spark.read.parquet(f"{place}/out").select("parent_asin", "rating_number")


# --- models and requests ---------------------------------------------------------


@query(f"SELECT parent_asin, 1.0::DOUBLE AS norm FROM ({C.ORACLE['combined_text']}) WHERE trim(combined_text) <> ''")
def text_embedding(spark, folder):
    """Hashed unit vectors of the catalogue's texts, by their norms."""
    from pyspark.ml.functions import vector_to_array

    rows = models.Models().embed(C.QUERIES["combined_text"](spark, folder), "combined_text")
    return rows.select("parent_asin", F.round(F.aggregate(vector_to_array("vec"), F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@query("""SELECT CASE WHEN text IS NULL OR contains(lower(text), 'zip') THEN 'neutral' WHEN contains(lower(text), 'great') OR contains(lower(text), 'love') THEN 'positive' WHEN contains(lower(text), 'bad') THEN 'negative' ELSE 'neutral' END AS sentiment, count(*) AS n_rows
FROM reviews GROUP BY 1""")
def chunked_sentiment(spark, folder):
    """A model that breaks on some texts: their chunks, here of one text, are neutral and the rest goes on."""

    def classify(texts: list[str]) -> list[str]:
        low = [t.lower() for t in texts]
        if any("zip" in t for t in low):
            raise RuntimeError("broken")
        return ["positive" if "great" in t or "love" in t else "negative" if "bad" in t else "neutral" for t in low]

    rows = models.sentiments(table(spark, folder, "reviews").select("text"), "text", models.Models(classify=classify), 1)
    return rows.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"""WITH g AS ({C.ORACLE['fashion_guard']}), r AS ({C.ORACLE['relation_strip']})
SELECT q, is_fashion, CASE WHEN NOT is_fashion THEN {S.text(vocab.NOT_FASHION_MESSAGE)} END AS message, CASE WHEN is_fashion THEN stripped END AS search_query FROM g JOIN r USING (q)""")
def guard_messages(spark, folder):
    """Queries without anything of fashion are refused with a message and searched for nothing."""
    rows, _ = C._asked(spark)
    return models.understand(rows).select("q", "is_fashion", "message", "search_query")


@query("SELECT q, ok FROM (VALUES ('a red dress', true), ('   ', false), ('xxxxxxxxxxxxxxxxxxxx', false), ('shirt', false), ('coat', true)) t(q, ok)")
def request_check(spark, folder):
    """Requests refused for blank or overlong queries and for result counts out of range."""
    asked = [("a red dress", "a red dress", 10), ("   ", "   ", 10), ("x" * 20, "x" * 501, 10), ("shirt", "shirt", 0), ("coat", "coat", 50)]

    def ok(text: str, k: int) -> bool:
        try:
            return bool(relational.check_request(text, k))
        except ValueError:
            return False

    return spark.createDataFrame([(name, ok(text, k)) for name, text, k in asked], "q string, ok boolean")


@query(f"""WITH {S.INDEX}, {C._SECTIONS} SELECT cur.id AS product_id, coalesce(nullif(cur.title, ''), 'Unknown Title') AS title, array_to_string(from_json(cur.images, '["VARCHAR"]'), ' ') AS images, cur.average_rating,
array_to_string(from_json(cur.review_highlights, '["VARCHAR"]'), '|') AS review_highlights, sec.garment_region AS garment_type, sec.gender, sec.is_accessory, sec.is_footwear FROM cur JOIN sec USING (id)""")
def cards(spark, folder):
    """Every current product as the row a result shows."""
    from ..operators import catalog

    p = {c: F.col(c) for c in ("id", "title", "gender", "category", "image_urls", "average_rating", "review_highlights")}
    shown = catalog.decode_rows(C.index(spark, folder)).select(sections.card(p["id"], p["title"], p["gender"], p["category"], p["image_urls"], p["average_rating"], p["review_highlights"]).alias("c")).select("c.*")
    return shown.withColumn("images", F.array_join("images", " ")).withColumn("review_highlights", F.array_join("review_highlights", "|"))


_PLAN = subqueries(C._SOFT)
_LEVELS = [(level, n, str(v)) for level in range(_PLAN[0].filters.steps(False) + 1) for n, v in _PLAN[0].filters.after(level, False).applied().items()]


@query(f"WITH {S.relaxed(_PLAN, C.QUERY, False)} SELECT name, value FROM (VALUES {', '.join(f'({level}, {S.text(n)}, {S.text(v)})' for level, n, v in _LEVELS)}) t(level, name, value) WHERE level IN (SELECT chosen FROM relaxed WHERE sq_id = 0)")
def search_filters(spark, folder):
    """The filters of a search's first subquery that are left at the level it chose."""
    rows = retrieval.candidates(C.index(spark, folder), _PLAN, C.QUERY, False)
    chosen = retrieval.chosen_levels(rows, _PLAN, {p.number: fetch_size(p.group) for p in _PLAN}, False).where("sq_id = 0")
    return spark.createDataFrame(_LEVELS, "level int, name string, value string").join(F.broadcast(chosen), F.col("level") == F.col("chosen")).select("name", "value")


@query("SELECT round(avg((event_id % 4 <> 1)::INT), 3) AS robustness_pass_rate FROM events")
def robustness_rate(spark, folder):
    status = F.when(F.col("event_id") % 4 == 1, 500).when(F.col("event_id") % 4 == 2, 400).otherwise(422)
    return evals.robustness(table(spark, folder, "events").select(status.alias("status"), F.array(F.lit(400), F.lit(422)).alias("allowed")))


@query("SELECT round(avg((event_id % 3 <> 0)::INT) FILTER (event_id % 7 <> 0), 3) AS request_id_present_rate FROM events")
def request_id_rate(spark, folder):
    e = F.col("event_id")
    calls = table(spark, folder, "events").select(F.when(e % 7 == 0, 500).otherwise(200).alias("status"), F.when(e % 3 != 0, F.concat(F.lit("r"), e.cast("string"))).when(e % 2 == 0, "").alias("request_id"))
    return evals.request_id_rate(calls)
