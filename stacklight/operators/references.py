"""Dangling references: compressed parent keys, as-of matching, reasons per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .skew import split_join

#: The digits of the integer form, in code point order, and its width.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WIDTH = 10
#: Neighbouring integer keys fall into one bucket of this many values; runs never cross a bucket.
BUCKET = 36**4


def key_number(col: Column) -> Column:
    """The base-36 value of a key written with exactly WIDTH digits, else null.

    Such keys map one to one to integers, in the same order. Any other spelling (lower
    case, blanks, other lengths or letters) has no number and is matched as a string.
    """
    lit_int = lambda part: F.conv(part, 36, 10).cast("long")
    return F.when(col.rlike(f"^[0-9A-Z]{{{WIDTH}}}\\z"), lit_int(F.substring(col, 1, 5)) * F.lit(36**5) + lit_int(F.substring(col, 6, 5)))


def key_runs(parents: DataFrame, key: str) -> DataFrame:
    """(bucket, run_start, run_end): the distinct integer parent keys as contiguous runs.

    ``value - row_number`` is constant within a run. Work is split by value bucket, so no task
    holds more than BUCKET keys; a run that crosses a bucket border becomes two runs.
    """
    numbers = parents.select(key_number(F.col(key)).alias("n")).where("n is not null").distinct()
    bucketed = numbers.withColumn("bucket", F.floor(F.col("n") / F.lit(BUCKET)))
    island = F.col("n") - F.row_number().over(Window.partitionBy("bucket").orderBy("n"))
    return bucketed.withColumn("island", island).groupBy("bucket", "island").agg(F.min("n").alias("run_start"), F.max("n").alias("run_end")).drop("island")


def missing_keys(references: DataFrame, ref_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """(key): distinct non-null reference keys that no parent has, compared exactly as written.

    References are made distinct first (pre-aggregated in each task), so a hot key costs
    nothing. Integer keys take the as-of match: in each bucket, references and run starts
    are ordered together and every reference looks back to the last run start; beyond that
    run's end, or before the first run, it is missing. Keys without an integer form take an
    anti join on the string. Empty tables are allowed on either side.
    """
    refs = references.select(F.col(ref_key).alias("key")).where("key is not null").distinct().withColumn("n", key_number(F.col("key")))
    runs = key_runs(parents, parent_key)
    events = (
        refs.where("n is not null")
        .select(F.floor(F.col("n") / F.lit(BUCKET)).alias("bucket"), F.col("n").alias("at"), F.lit(1).alias("is_ref"), F.lit(None).cast("long").alias("run_end"), "key")
        .unionByName(runs.select("bucket", F.col("run_start").alias("at"), F.lit(0).alias("is_ref"), "run_end", F.lit(None).cast("string").alias("key")))
    )
    back = Window.partitionBy("bucket").orderBy("at", "is_ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = events.withColumn("last_end", F.last("run_end", ignorenulls=True).over(back)).where("is_ref = 1")
    absent = matched.where(F.col("last_end").isNull() | (F.col("at") > F.col("last_end"))).select("key")
    plain = parents.select(F.col(parent_key).alias("key")).where(F.col("key").isNotNull() & key_number(F.col("key")).isNull()).distinct()
    return absent.unionByName(refs.where("n is null").select("key").join(plain, "key", "left_anti"))


def dangling(references: DataFrame, parents: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Rows of ``references`` whose parent is missing, not yet there or gone at the row's time.

    Times are microseconds. references: (src_table string, row_key string, key string, at_us
    long); parents: (key, first_us long); withdrawn: (key, gone_us long). Returns distinct (src_table, period,
    row_key, reason). ``missing`` if no parent row has the key; else ``late`` if the time is
    before the least first_us; else ``deleted`` if at or after the least gone_us. A null time
    can only be ``missing`` and has the period ``unknown``. Null keys refer to nothing and
    are left out; so is a row with a null row_key only if its key is null. Parents with
    only null first_us are never ``late``.
    """
    refs = references.where("key is not null")
    missing = missing_keys(refs, "key", parents, "key").withColumn("is_missing", F.lit(True))
    first = parents.where("key is not null").groupBy("key").agg(F.min("first_us").alias("first_us"))
    gone = withdrawn.where("key is not null").groupBy("key").agg(F.min("gone_us").alias("gone_us"))
    state = first.join(gone, "key", "left").withColumn("is_missing", F.lit(False)).unionByName(missing, allowMissingColumns=True)
    reason = (
        F.when(F.col("is_missing"), "missing")
        .when(F.col("at_us") < F.col("first_us"), "late")
        .when(F.col("at_us") >= F.col("gone_us"), "deleted")
    )
    # by whole days since 1970, so that the session's time zone has no say
    day = F.date_from_unix_date(F.floor(F.col("at_us") / F.lit(86_400_000_000.0)).cast("int"))
    period = F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("unknown"))
    return (
        split_join(refs, state, "key", "inner")
        .withColumn("reason", reason)
        .where("reason is not null")
        .select("src_table", period.alias("period"), "row_key", "reason")
        .distinct()
    )
