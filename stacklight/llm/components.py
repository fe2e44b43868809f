"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, class): the least node of the component of every node that has an edge.

    Alternating large-star and small-star steps: every step is one shuffle by node, star
    edges only ever get fewer, and about log(n) rounds suffice. A hot centre is met in the
    form of one edge per neighbour; minima are pre-aggregated in each task. Loops and
    repeated edges are allowed; null ends are left out.
    """
    links = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct())
    nodes = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    before = None
    while True:
        # large star: each node hands its larger neighbours to the least of its neighbourhood
        sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v")
        # small star: each node hands itself and its smaller neighbours to the least of them
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("m").alias("u"), "v").unionByName(low.select(F.col("m").alias("u"), F.col("u").alias("v")))
        links = cut(small.distinct())
        state = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        now = (state["n"], state["h"])
        if now == before:
            break
        before = now
    return nodes.join(links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("class")), "node", "left").select("node", F.coalesce("class", "node").alias("class"))
