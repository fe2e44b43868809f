"""Retrieval over a plan of subqueries: relaxation, reranking, interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import sections, vocab
from ..functions.query_text import group_text
from ..plans.search_plan import ENOUGH, Subquery, fetch_size, rerank_share
from .catalog import candidate_text
from .vector import dot


def candidates(index: DataFrame, plan: list[Subquery], query: list[float], all_at_once: bool, key: str = "id", vector: str = "vec") -> DataFrame:
    """Index rows with sq_id, level and score, a row per subquery whose hard filters it meets. One scan."""
    marks = [F.when(p.filters.hard_predicate(), F.struct(F.lit(p.number).alias("sq_id"), p.filters.level(all_at_once).alias("level"))) for p in plan]
    rows = index.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    hit = rows.withColumn("__m", F.explode(F.array_compact(F.array(*marks))))
    return hit.withColumn("score", dot(F.col(vector), query)).select("*", F.col("__m.sq_id").alias("sq_id"), F.col("__m.level").alias("level")).drop("__m", vector)


def chosen_levels(rows: DataFrame, plan: list[Subquery], limits: dict[int, int], all_at_once: bool) -> DataFrame:
    """(sq_id, chosen): the fewest filters to give up for ENOUGH results, or all of them.

    A result list never exceeds its limit, so a limit below ENOUGH always gives up everything.
    """
    spark = rows.sparkSession
    steps = [(p.number, level, limits[p.number], p.filters.steps(all_at_once)) for p in plan for level in range(p.filters.steps(all_at_once) + 1)]
    wanted = spark.createDataFrame(steps, "sq_id int, upto int, k int, last int")
    # at most six levels a subquery: both sides are tiny
    counts = rows.groupBy("sq_id", "level").agg(F.count(F.lit(1)).alias("n"))
    reached = F.broadcast(wanted).join(counts, "sq_id", "left").groupBy("sq_id", "upto", "k", "last").agg(F.coalesce(F.sum(F.when(F.col("level") <= F.col("upto"), F.col("n"))), F.lit(0)).alias("have"))
    good = (F.least("have", "k") >= ENOUGH) | (F.col("upto") == F.col("last"))
    return reached.where(good).groupBy("sq_id").agg(F.min("upto").alias("chosen"))


def relaxed(index: DataFrame, plan: list[Subquery], query: list[float], limits: dict[int, int], all_at_once: bool = False, key: str = "id", vector: str = "vec", keep: list[str] | None = None) -> DataFrame:
    """Per subquery the nearest rows under filters given up until there are enough.

    Adds sq_id, chosen, score and rank. One scan for levels and rows each; the strict matches
    aren't preferred once a filter is given up.
    """
    rows = candidates(index, plan, query, all_at_once, key, vector)
    if keep is not None:
        rows = rows.select(key, "sq_id", "level", "score", *keep)
    levels = chosen_levels(rows, plan, limits, all_at_once)
    most = max(limits.values())
    order = Window.partitionBy("sq_id").orderBy(F.desc("score"), F.asc(key))
    ranked = rows.join(F.broadcast(levels), "sq_id").where(F.col("level") <= F.col("chosen")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    k = F.create_map(*[F.lit(x) for n, v in limits.items() for x in (n, v)])
    return ranked.where(F.col("rank") <= k[F.col("sq_id")]).drop("level")


def word_score(words: Column, text: Column) -> Column:
    """Stand-in for a reranker: how many of the query's words the candidate's text contains; -infinity for no text."""
    low = F.lower(text)
    hits = F.aggregate(F.transform(words, lambda w: low.contains(w).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.trim(text) == "", F.lit(float("-inf"))).otherwise(hits.cast("double"))


def query_words(query: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(query)), r"(?U)\s+"), lambda w: w != ""))


def interleave(rows: DataFrame, list_id: str, rank: str, key: str, relevance: str, within: list[str] | None = None) -> DataFrame:
    """Adds position: the lists taken in turn, the one with the most relevant head first.

    Lists with equal heads go by their number. A key met again keeps its first place.
    ``rank`` counts from 1 in each list. With ``within``, each of its groups is interleaved
    on its own. Lists are result pages, not tables: a group is handled by one task.
    """
    group = within or []
    head = Window.partitionBy(*group, list_id)
    with_head = rows.withColumn("__head", F.max(F.when(F.col(rank) == 1, F.col(relevance))).over(head))
    everyone = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    turn = with_head.withColumn("__turn", F.dense_rank().over(everyone.orderBy(F.desc("__head"), F.asc(list_id))))
    first = Window.partitionBy(*group, key).orderBy(rank, "__turn")
    once = turn.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return once.withColumn("position", F.row_number().over(everyone.orderBy(rank, "__turn"))).drop("__head", "__turn", "__n")


def search(index: DataFrame, plan: list[Subquery], query_text: str, query: list[float], top_k: int, key: str = "id", vector: str = "vec") -> DataFrame:
    """(key, rank, group, pool, score, rerank): the whole search of one query over a plan.

    Fetch per subquery with relaxation (all at once for outfits), keep accessories only in
    their group, cut to the rerank share, rerank by the group's own text, interleave genders
    within a group and then groups, cut to top_k.
    """
    outfit = any(p.group for p in plan)
    limits = {p.number: fetch_size(p.group) for p in plan}
    found = relaxed(index, plan, query, limits, outfit, key, vector, ["title", "description", "category", "color", "style", "gender"])
    spark = index.sparkSession
    about = spark.createDataFrame([(p.number, p.pool, p.group, vocab.GROUP_NOUNS.get(p.group)) for p in plan], "sq_id int, pool int, group string, noun string")
    rows = found.join(F.broadcast(about), "sq_id")
    rows = rows.where((F.coalesce("group", F.lit("")) != "accessories") | sections.is_accessory(F.col("category"), F.col("title")))
    by_search = Window.partitionBy("sq_id").orderBy("rank")
    rows = rows.withColumn("dense", F.row_number().over(by_search)).where(F.col("dense") <= rerank_share(len(plan)))
    text = F.when(F.col("noun").isNull(), F.lit(query_text)).otherwise(group_text(F.lit(query_text), F.col("noun")))
    rows = rows.withColumn("rerank", word_score(query_words(text), candidate_text()))
    again = Window.partitionBy("sq_id").orderBy(F.desc("rerank"), F.asc("dense"))
    rows = rows.withColumn("place", F.row_number().over(again)).withColumn("group", F.coalesce("group", F.lit("")))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    inner = interleave(rows, "sq_id", "place", key, "rerank", ["group"]).withColumnRenamed("position", "in_group")
    # plan order of the groups decides between equal heads
    order = spark.createDataFrame([(g or "", i) for i, g in enumerate(dict.fromkeys(p.group for p in plan))], "group string, group_no int")
    outer = interleave(inner.join(F.broadcast(order), "group"), "group_no", "in_group", key, "rerank")
    cut = outer.crossJoin(F.broadcast(total)).where(F.col("position") <= F.least(F.lit(top_k), F.col("total")))
    return cut.select(key, F.col("position").alias("rank"), "group", "pool", "score", "rerank")
