"""File sources and sinks: JSON lines, literal samples, keyed tables, ledgers, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE = "struct<variant:string,thumb:string,large:string,hi_res:string>"
PRODUCTS = f"parent_asin string, title string, average_rating double, rating_number long, images array<{IMAGE}>, description array<string>, price double, store string"
REVIEWS = "asin string, parent_asin string, rating double, title string, text string, user_id string, timestamp long, verified_purchase boolean, helpful_vote long"


def discover(spark: SparkSession, folder: str) -> tuple[str | None, str | None]:
    """(products file, reviews file) among the .jsonl files of a folder: the first meta_*, the first other; any file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().endswith(".jsonl"))
    meta = next((n for n in names if n.startswith("meta_")), None)
    other = next((n for n in names if not n.startswith("meta_")), None)
    return tuple(f"{folder}/{n}" if n else None for n in (meta, other))


def jsonl_to_parquet(spark: SparkSession, source: str, target: str, schema: str, overwrite: bool = False) -> DataFrame:
    """Read JSON lines with a fixed schema, write Parquet, and return the written table.

    Lines that are no JSON give a row of nulls. An existing target is an error unless overwritten.
    """
    write_table(spark.read.schema(schema).json(source), target, overwrite)
    return spark.read.parquet(target)


def write_table(df: DataFrame, target: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(target)


def sample_tables(spark: SparkSession, now_ms: int = 1693526400000) -> tuple[DataFrame, DataFrame]:
    """Three products and four reviews for a first run; ``now_ms`` stands for the time of all reviews."""
    pics = lambda key, *codes: [(c, f"https://m.media-amazon.com/{key}/{c}_t.jpg", f"https://m.media-amazon.com/{key}/{c}.jpg", None) for c in codes]
    products = [
        ("B01D234567", "Men's Classic Red T-Shirt Cotton Large", 4.5, 120, pics("B01", "MAIN", "PT01"), ["Soft cotton."], None, None),
        ("B02E345678", "Women's Elegant Black Dress Size M", 4.8, 340, pics("B02", "MAIN", "PT01", "FRNT", "BACK"), ["For evenings."], None, None),
        ("B03F456789", "Unisex Sporty Blue Sneakers", 3.9, 85, pics("B03", "MAIN"), [], None, None),
    ]
    reviews = [
        ("B01D234567", "B01D234567", 5.0, "Great", "Great fit and soft fabric", "u1", now_ms, True, 3),
        ("B01D234567", "B01D234567", 2.0, "Meh", "Bad wash quality", "u2", now_ms, True, 1),
        ("B02E345678", "B02E345678", 5.0, "Love it", "Love it for a wedding", "u3", now_ms, True, 0),
        ("B03F456789", "B03F456789", 4.0, "Nice", "Comfortable to wear", "u4", now_ms, False, 0),
    ]
    return spark.createDataFrame(products, PRODUCTS), spark.createDataFrame(reviews, REVIEWS)


def ensure_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, created empty if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        spark.createDataFrame([], T._parse_datatype_string(schema)).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to an append-only log; every row gets the time of writing."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def ensure_index(spark: SparkSession, path: str, schema: str, dimension: int, metric: str = "cosine") -> bool:
    """Create an index table of a vector length and metric if there is none; whether it was created.

    Both are kept beside the table; an index of another length or metric is an error.
    """
    ensure_table(spark, path, schema)
    about = ensure_table(spark, f"{path}.about", "dimension int, metric string")
    told = about.first()
    if told is None:
        spark.createDataFrame([(dimension, metric)], about.schema).write.mode("append").parquet(f"{path}.about")
    elif (told["dimension"], told["metric"]) != (dimension, metric):
        raise ValueError(f"{path} is an index of {told['dimension']} dimensions by {told['metric']}")
    return told is None
