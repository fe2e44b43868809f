"""Evaluation of search results: per-call scores, metrics, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Results of a call that count.
DEPTH = 10
#: Limits a run must keep.
THRESHOLDS = {"error_rate": ("<=", 0.02), "empty_rate": ("<=", 0.05), "latency_p95_ms_normal": ("<=", 15000), "latency_p95_ms_outfit": ("<=", 20000), "filter_accuracy": (">=", 0.9), "category_conformance": (">=", 0.7), "gender_conformance": (">=", 0.9), "outfit_coverage": (">=", 0.75)}


def nearest_rank(value: Column | str, percent: float) -> Column:
    """The nearest-rank percentile of a group, null for none: a value that occurs, never one in between.

    Exact; on huge groups it shuffles value counts, not rows.
    """
    name = value if isinstance(value, str) else "value"
    return F.expr(f"percentile_disc({percent / 100!r}) WITHIN GROUP (ORDER BY {name})")


def percentiles(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """p50 and p95 of a column, per group if asked."""
    return df.where(F.col(value).isNotNull()).groupBy(*(by or [])).agg(nearest_rank(value, 50).alias("p50"), nearest_rank(value, 95).alias("p95"), F.count(F.lit(1)).alias("n"))


def any_needle(title: Column, needles: list[str]) -> Column:
    """Whether a title holds one of the needles, in any letter case."""
    low = F.lower(title)
    out = F.lit(False)
    for n in needles:
        out = out | low.contains(n.lower())
    return out


def call_scores(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Per call the shares and hits of its first DEPTH results.

    cases: (call_id, outfit, want_gender, title_any array, filter_hits, filter_total);
    results: (call_id, rank, title, gender, is_footwear, is_accessory, region). A call without
    results has null conformance; unisex and unknown genders suit every query.
    """
    top = results.where(F.col("rank") <= DEPTH).join(F.broadcast(cases.select("call_id", "want_gender", "title_any")), "call_id")
    match = F.exists("title_any", lambda n: F.lower("title").contains(F.lower(n)))
    suits = F.col("gender").isNull() | (F.col("gender") == "unisex") | (F.col("gender") == F.col("want_gender"))
    covered = F.max(F.coalesce(F.col("is_footwear"), F.lit(False)).cast("int")) + F.max(F.coalesce(F.col("is_accessory"), F.lit(False)).cast("int")) + F.max((F.coalesce("region", F.lit("")) == "upper_body").cast("int")) + F.max((F.coalesce("region", F.lit("")) == "lower_body").cast("int"))
    per_call = top.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("n_results"),
        F.avg(F.when(F.size("title_any") > 0, match.cast("int"))).alias("category_conformance"),
        F.avg(F.when(F.col("want_gender").isNotNull(), suits.cast("int"))).alias("gender_conformance"),
        (covered / F.lit(4.0)).alias("coverage"),
    )
    return cases.join(per_call, "call_id", "left").select(
        "call_id", "outfit", "filter_hits", "filter_total", F.coalesce("n_results", F.lit(0)).alias("n_results"), "category_conformance", "gender_conformance", F.when(F.col("outfit"), F.coalesce("coverage", F.lit(0.0))).alias("outfit_coverage")
    )


def metrics(calls: DataFrame) -> DataFrame:
    """One row of metrics over calls: (status, latency_ms, flakes, outfit, n_results, filter_hits,
    filter_total, category_conformance, gender_conformance, outfit_coverage).

    Failed calls count in error_rate alone; shares are over calls that have them; a missing
    percentile is 0 and any other metric without a denominator is null.
    """
    ok = F.col("status") == 200
    when = lambda c, test=None: F.when(ok if test is None else ok & test, F.col(c))
    flat = calls.select(
        "*", when("latency_ms").alias("__all"), when("latency_ms", ~F.col("outfit")).alias("__normal"), when("latency_ms", F.col("outfit")).alias("__outfit"), F.coalesce(ok, F.lit(False)).alias("__ok")
    )
    rate = lambda c: F.round(F.avg(c), 3)
    p = lambda c, x: F.coalesce(F.round(nearest_rank(c, x)), F.lit(0.0))
    return flat.agg(
        rate((~F.col("__ok")).cast("int")).alias("error_rate"),
        rate(F.when(F.col("__ok"), (F.col("n_results") == 0).cast("int"))).alias("empty_rate"),
        F.sum("flakes").alias("network_flakes"),
        p("__all", 50).alias("latency_p50_ms"), p("__all", 95).alias("latency_p95_ms"), p("__normal", 95).alias("latency_p95_ms_normal"), p("__outfit", 95).alias("latency_p95_ms_outfit"),
        F.round(F.try_divide(F.sum(F.when(F.col("__ok"), F.col("filter_hits"))), F.sum(F.when(F.col("__ok"), F.col("filter_total")))), 3).alias("filter_accuracy"),
        *[rate(F.when(F.col("__ok"), F.col(c))).alias(c) for c in ("category_conformance", "gender_conformance", "outfit_coverage")],
    )


def verdicts(row: DataFrame, thresholds: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """(metric, value, passed) of a metrics row; a null metric fails."""
    rules = THRESHOLDS if thresholds is None else thresholds
    tests = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), F.coalesce((F.col(n) <= v) if op == "<=" else (F.col(n) >= v), F.lit(False)).alias("passed")) for n, (op, v) in rules.items()]
    return row.select(F.explode(F.array(*tests)).alias("t")).select("t.*")


def robustness(probes: DataFrame) -> DataFrame:
    """(robustness_pass_rate): share of the probes (status, allowed) that were answered with an allowed status.

    Bad requests must be refused cleanly. A missing status fails; no probes give null.
    """
    ok = F.coalesce(F.array_contains("allowed", F.col("status")), F.lit(False))
    return probes.agg(F.round(F.avg(ok.cast("int")), 3).alias("robustness_pass_rate"))


def request_id_rate(calls: DataFrame) -> DataFrame:
    """(request_id_present_rate): share of the successful calls (status, request_id) that carry a request id."""
    present = F.coalesce(F.length("request_id") > 0, F.lit(False)).cast("int")
    return calls.agg(F.round(F.avg(F.when(F.col("status") == 200, present)), 3).alias("request_id_present_rate"))
