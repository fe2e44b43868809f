"""Per-key work under heavy skew: heavy-hitter detection and the split join.

A few keys may hold most rows. Their number is bounded by their share (at most
``1 / share`` keys can hold ``share`` of all rows each), so whatever is attached
to them can be broadcast; all other keys are small and shuffle evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Counters of the sketch; its error is at most about 4 / TRACKED of all rows.
TRACKED = 8192
#: Keys at or above this share of the rows are treated as heavy by default.
HEAVY_SHARE = 0.01


def sketch_candidates(df: DataFrame, key: str, share: float = HEAVY_SHARE, tracked: int = TRACKED) -> DataFrame:
    """Keys that may hold ``share`` of the rows: a superset of the true ones, at most ``2 / share`` keys.

    One pass with a frequent-items sketch per task; only sketches move. Every key whose true
    share reaches ``share`` is present, since the sketch's error stays far below it.
    Null keys are never candidates. An empty table gives no rows.
    """
    if not 0 < share <= 1 or 4 / tracked > share / 4:
        raise ValueError("share must lie in (0, 1] and be well above the sketch's error 4 / tracked")
    k = int(2 / share) + 1
    top = df.where(F.col(key).isNotNull()).select(F.expr(f"approx_top_k(`{key}`, {k}, {tracked})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias(key))


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """(key, n_rows, n_total): exactly the non-null keys that hold at least ``share`` of all rows.

    The sketch proposes a bounded candidate list, a broadcast join counts just those
    candidates exactly, and the total counts every row, null keys included. The counts are
    pre-aggregated in each task, so a hot key costs one row per task in the shuffle.
    Empty input or no key above the share gives no rows.
    """
    names = sketch_candidates(df, key, share)
    marked = df.select(F.col(key).alias("k")).join(F.broadcast(names.select(F.col(key).alias("k"), F.lit(True).alias("hit"))), "k", "left")
    counts = marked.groupBy(F.when(F.col("hit"), F.col("k")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    # counts has at most 2 / share + 1 rows, so one task for the total is safe.
    total = counts.agg(F.sum("n").alias("n_total"))
    return (
        counts.where(F.col("k").isNotNull())
        .crossJoin(F.broadcast(total))
        .where(F.col("n") >= F.lit(share) * F.col("n_total"))
        .select(F.col("k").alias(key), F.col("n").alias("n_rows"), "n_total")
    )


def split_join(facts: DataFrame, dims: DataFrame, key: str, how: str = "left", share: float = HEAVY_SHARE) -> DataFrame:
    """Join facts to dims (at most one row per key) without a hot task.

    Heavy keys of ``facts`` meet a broadcast of their few ``dims`` rows and never shuffle;
    the remaining keys take an ordinary shuffle join; both parts are united. ``how`` is
    ``inner`` or ``left``. Null keys match nothing; with ``left`` they are kept.
    A null key can match nothing, so with ``left`` its rows get their nulls where they lie, however many they are.
    Columns of ``dims`` must not clash with those of ``facts`` but for the key.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    clash = (set(facts.columns) & set(dims.columns)) - {key}
    if clash:
        raise ValueError(f"both sides have the columns {sorted(clash)}")
    hot = sketch_candidates(facts, key, share).select(F.col(key), F.lit(True).alias("__hot"))
    marked = facts.join(F.broadcast(hot), key, "left")
    hot_dims = dims.join(F.broadcast(hot.select(key)), key, "left_semi")
    first = marked.where(F.col("__hot")).drop("__hot").join(F.broadcast(hot_dims), key, how)
    second = marked.where(F.col("__hot").isNull() & F.col(key).isNotNull()).drop("__hot").join(dims, key, how)
    both = first.unionByName(second)
    if how == "inner":
        return both
    unmatched = facts.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in dims.schema if f.name != key])
    return both.unionByName(unmatched)


def per_key_stats(df: DataFrame, key: str, value: Column, share: float = HEAVY_SHARE) -> DataFrame:
    """(key, is_heavy, n_rows, n_values, sum_value, min_value, max_value) for every key, null included.

    Heavy keys are picked by a broadcast join and aggregated under a salt of 64 first, so
    no task sees one of them whole; all other keys shuffle once; then a union.
    A null value counts in n_rows only. An empty table gives no rows.
    """
    hot = sketch_candidates(df, key, share).select(F.col(key), F.lit(True).alias("__hot"))
    # the planner must not see the value before the join, or its columns would be evaluated twice
    marked = df.select(key, value.alias("__v")).join(F.broadcast(hot), key, "left")
    parts = [F.count(F.lit(1)).alias("n"), F.count("__v").alias("nv"), F.sum("__v").alias("s"), F.min("__v").alias("lo"), F.max("__v").alias("hi")]
    whole = [F.sum("n").alias("n_rows"), F.sum("nv").alias("n_values"), F.sum("s").alias("sum_value"), F.min("lo").alias("min_value"), F.max("hi").alias("max_value")]
    salted = marked.where(F.col("__hot")).withColumn("__salt", F.spark_partition_id() % 64).groupBy(key, "__salt").agg(*parts)
    heavy = salted.groupBy(key).agg(*whole).withColumn("is_heavy", F.lit(True))
    rest = marked.where(F.col("__hot").isNull()).groupBy(key).agg(*parts).groupBy(key).agg(*whole).withColumn("is_heavy", F.lit(False))
    return heavy.unionByName(rest).select(key, "is_heavy", "n_rows", "n_values", "sum_value", "min_value", "max_value")


def salted(df: DataFrame, key: str, by: str, share: float = HEAVY_SHARE, rows: int = 1000) -> DataFrame:
    """The rows with ``salt``: 0, but a number from the hash of ``by`` for heavy keys, about ``rows`` rows a number.

    What is broadcast is one row per heavy key, at most 1 / share. Null keys have salt 0.
    """
    hot = heavy_keys(df, key, share).select(key, F.ceil(F.col("n_rows") / rows).alias("parts"))
    return df.join(F.broadcast(hot), key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), "parts"), F.lit(0).cast("long"))).drop("parts")


def class_pairs(members: DataFrame, cls: str, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """(key_a, key_b), key_a < key_b: every pair of different keys of one class, each once.

    Members may repeat. A heavy class is met in tiles of about 1,000 by 1,000 keys, so no task has one whole.
    Null classes and keys are in no pair.
    """
    # written once: sizes, salts and both sides of the join read it
    once = cut(members.where(F.col(cls).isNotNull() & F.col(key).isNotNull()).select(cls, key).distinct())
    dealt = salted(once, cls, key, share)
    last = dealt.where("salt > 0").groupBy(cls).agg(F.max("salt").alias("last"))  # heavy classes alone
    zero = F.lit(0).cast("long")
    every = once.join(F.broadcast(last), cls, "left").withColumn("salt", F.explode(F.sequence(zero, F.coalesce("last", zero)))).drop("last")
    x = dealt.select(cls, "salt", F.col(key).alias(f"{key}_a"))
    y = every.select(cls, "salt", F.col(key).alias(f"{key}_b"))
    return x.join(y, [cls, "salt"]).where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
