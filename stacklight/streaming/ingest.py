"""Incremental ingestion: hash batches with a ledger, idempotent keyed writes, and a stream of new files."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

LEDGER = "batch int, n_batches int, n_products long, status string, n_rows long, message string, at timestamp"


def batch_of(n_batches: int, key: str = "parent_asin"):
    """Stable batch number of a row: the first 32 bits of its key's MD5, 0 for a null key. Row positions aren't stable in Spark."""
    digits = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return F.coalesce(digits % n_batches, F.lit(0)).cast("int")


def batch_sizes(products: DataFrame, n_batches: int, key: str = "parent_asin") -> DataFrame:
    """(batch, n_products)."""
    return products.groupBy(batch_of(n_batches, key).alias("batch")).agg(F.count(F.lit(1)).alias("n_products"))


def latest_status(ledger: DataFrame) -> DataFrame:
    """(batch, status): the last entry of each batch; on one instant completed wins."""
    return ledger.groupBy("batch").agg(F.max_by("status", F.struct("at", (F.col("status") == "completed").alias("c"))).alias("status"))


def pending(spark: SparkSession, ledger: DataFrame, n_batches: int, only_failed: bool = False, skip_failed: bool = False, most: int | None = None) -> DataFrame:
    """(batch) still to do, in order: all but the completed, or only the failed, or without the failed."""
    state = latest_status(ledger)
    every = spark.range(n_batches).select(F.col("id").cast("int").alias("batch"))
    open_ = every.join(state.where("status = 'completed'"), "batch", "left_anti")
    failed = state.where("status = 'failed'").select("batch")
    if only_failed:
        open_ = open_.join(failed, "batch", "left_semi")
    elif skip_failed:
        open_ = open_.join(failed, "batch", "left_anti")
    ordered = open_.orderBy("batch")
    return ordered if most is None else ordered.limit(most)


def check_ledger(ledger: DataFrame, n_batches: int, n_products: int) -> None:
    """Raise ValueError if the ledger was written for another split or another table."""
    for row in ledger.select("n_batches", "n_products").distinct().limit(2).collect():
        if (row["n_batches"], row["n_products"]) != (n_batches, n_products):
            raise ValueError(f"the ledger is of {row['n_batches']} batches and {row['n_products']} products, not {n_batches} and {n_products}")


def with_retries(action: Callable[[], int], attempts: int = 3, first_wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run an idempotent action again after failures, waiting twice as long each time; the last failure is raised."""
    for k in range(attempts):
        try:
            return action()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(first_wait * 2**k)
    raise ValueError("attempts must be at least 1")


@dataclass
class Outcome:
    completed: int = 0
    failed: int = 0
    rows: int = 0
    interrupted: bool = False

    @property
    def exit_code(self) -> int:
        """130 if interrupted, 1 if a batch failed, else 0."""
        return 130 if self.interrupted else 1 if self.failed else 0


def write_batch(rows: DataFrame, index_path: str, batch: int) -> int:
    """Replace one batch's partition of the index; doing it again gives the same table."""
    target = f"{index_path}/batch={batch}"
    rows.write.mode("overwrite").parquet(target)
    return rows.sparkSession.read.parquet(target).count()


def upsert(rows: DataFrame, path: str, key: str, order: str, parts: int = 64) -> int:
    """Write rows into a keyed table, the last write of a key staying; returns the number of keys written.

    The table is split by the key's hash into ``parts`` folders; only those the rows fall into are read and
    replaced. Among the rows themselves the greatest ``order`` wins, then the text of the row; the rows win over
    what is stored. Rows with a null key are left out. Doing it again gives the same table.
    """
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    columns = rows.columns
    latest = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.col(order).isNotNull(), order, F.to_json(F.struct(*columns)))).alias("r"))
    new = cut(latest.select("r.*").withColumn("part", part))
    touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most ``parts``
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    merged = new
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        old = spark.read.parquet(path).where(F.col("part").isin(touched))
        merged = cut(old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True))
    merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return new.count()


def batch_report(enriched: DataFrame, reviews: DataFrame, vectors: DataFrame, n_batches: int, key: str = "parent_asin", vector_key: str = "id") -> DataFrame:
    """(batch, n_products, n_reviews, n_vectors, n_positive, n_neutral, n_negative): what each batch holds.

    enriched has the key and overall_sentiment. Every input is counted per batch where it lies; only counts move.
    """
    def count(df: DataFrame, k: str, *more) -> DataFrame:
        return df.groupBy(batch_of(n_batches, k).alias("batch")).agg(*more)

    kinds = [F.count_if(F.col("overall_sentiment") == s).alias(f"n_{s}") for s in ("positive", "neutral", "negative")]
    every = enriched.sparkSession.range(n_batches).select(F.col("id").cast("int").alias("batch"))
    out = every.join(count(enriched, key, F.count(F.lit(1)).alias("n_products"), *kinds), "batch", "left")
    out = out.join(count(reviews, key, F.count(F.lit(1)).alias("n_reviews")), "batch", "left").join(count(vectors, vector_key, F.count(F.lit(1)).alias("n_vectors")), "batch", "left")
    names = ["n_products", "n_reviews", "n_vectors", "n_positive", "n_neutral", "n_negative"]
    return out.select("batch", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def run(spark: SparkSession, products: DataFrame, transform: Callable[[DataFrame], DataFrame], index_path: str, ledger_path: str, n_batches: int, dry_run: bool = False, stop_on_error: bool = False, only_failed: bool = False, skip_failed: bool = False, most: int | None = None, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> Outcome:
    """Transform and write all pending batches, entering each in the ledger after its write.

    The products are split by batch once, into the shared folder, so a batch reads its own rows only. A batch that
    fails is entered as failed and the next one follows, unless stop_on_error. A crash between write and entry
    repeats the batch, which its write allows. An interrupt ends the run after what is entered; its exit code is 130.
    """
    from ..sources.files import ensure_table

    total = products.count()
    ledger = ensure_table(spark, ledger_path, LEDGER)
    check_ledger(ledger, n_batches, total)
    todo = [r["batch"] for r in pending(spark, ledger, n_batches, only_failed, skip_failed, most).collect()]
    out = Outcome()
    if dry_run or not todo:
        return out
    split = cut(products.withColumn("__batch", batch_of(n_batches)).where(F.col("__batch").isin(todo)), by="__batch")
    for batch in todo:
        part = split.where(F.col("__batch") == batch).drop("__batch")
        try:
            n = with_retries(lambda part=part, batch=batch: write_batch(transform(part), index_path, batch), attempts, sleep=sleep)
            entry, out.completed, out.rows = ("completed", n, None), out.completed + 1, out.rows + n
        except KeyboardInterrupt:
            out.interrupted = True
            break
        except Exception as e:  # noqa: BLE001
            entry, out.failed = ("failed", 0, str(e)[:500]), out.failed + 1
        spark.createDataFrame([(batch, n_batches, total, *entry)], "batch int, n_batches int, n_products long, status string, n_rows long, message string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(ledger_path)
        if out.failed and stop_on_error:
            break
    return out


def stream_files(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "parent_asin", order: str = "parent_asin") -> None:
    """Take in all new Parquet files of a folder once and stop; the target holds the last write of every key.

    A key delivered again, in the same micro-batch or a later one, replaces its row. A micro-batch that is repeated
    after a failure changes nothing.
    """

    def take(rows: DataFrame, batch_id: int) -> None:
        upsert(transform(rows), target, key, order)

    query = spark.readStream.schema(schema).parquet(source).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(take).start()
    query.awaitTermination()
