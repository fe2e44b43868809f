"""Top N rows of every group by histogram thresholds and exact ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.skew import split_join

def score_bin(score: Column) -> Column:
    """A bin that never orders two scores against their order: half-octaves of the score, both signs.

    Null and NaN have the lowest bin.
    """
    size = lambda x: F.floor(2 * F.log2(1 + x)).cast("int") + 1
    real = F.least(F.greatest(score.cast("double"), F.lit(-1e300)), F.lit(1e300))  # infinite scores get the outermost bins
    return F.when(score.isNull() | F.isnan(score.cast("double")), F.lit(-10000)).when(real >= 0, size(real)).otherwise(-size(-real))


def top_n(df: DataFrame, group: str, scores: list[str], tie: str, n: int) -> DataFrame:
    """(group, place, tie): the first n rows of each non-null group, place counting from 1.

    Order: each column of ``scores`` descending with nulls (and NaN) last, then ``tie`` ascending. Rows equal in group,
    scores and tie are one row; ``tie`` must otherwise be unique within a group, so the order is total.
    A group of fewer than n rows gives all its rows. Null groups are left out.

    A histogram of the first score per group (pre-aggregated in each task) gives the highest bin down to which at least
    n different rows lie; rows below it cannot rank and are dropped. A bin counts the different values of six
    hash bits of the tie, never more than its different rows, so repeated rows need no shuffle of their own first.
    Floors reach the rows of heavy groups by broadcast, those of all other groups by a shuffle join. The survivors
    are ranked exactly; Spark ranks within each task first (WindowGroupLimit), so even a group
    whose rows all tie sends at most n rows a task.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    names = [f"__s{i}" for i in range(len(scores))]
    plain = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("__g"), *[plain(s).alias(a) for s, a in zip(scores, names)], F.col(tie).alias("__t"))
    binned = rows.withColumn("__bin", score_bin(F.col(names[0])))
    mark = F.expr("shiftleft(1L, cast(pmod(xxhash64(__t), 64) as int))")
    bins = binned.groupBy("__g", "__bin").agg(F.bit_count(F.bit_or(mark)).alias("c"))
    above = Window.partitionBy("__g").orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    floors = bins.withColumn("above", F.sum("c").over(above)).where(F.col("above") >= n).groupBy("__g").agg(F.max("__bin").alias("__floor"))
    kept = split_join(binned, floors, "__g", "left").where(F.col("__floor").isNull() | (F.col("__bin") >= F.col("__floor"))).select("__g", *names, "__t").distinct()
    order = [F.desc_nulls_last(s) for s in names] + [F.asc("__t")]
    ranked = kept.withColumn("__place", F.row_number().over(Window.partitionBy("__g").orderBy(*order)))
    return ranked.where(F.col("__place") <= n).select(F.col("__g").alias(group), F.col("__place").cast("long").alias("place"), F.col("__t").alias(tie))
