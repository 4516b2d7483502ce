"""Scored tasks -> per-run scorecards (F1-F8).

All aggregates are partial (map-side) aggregations keyed by model; the percentiles use the
exact, bucketed order statistics so a model holding most rows never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scoring as S
from quarry.operators.order_stats import index_rank, last_rank, order_statistics, upper_median
from quarry.session import materialize
from quarry.sources import derived as D


def pct(a: Column, b: Column, places: int = 1) -> Column:
    """round(100 * a / b, places) half-even, 0.0 when b is 0."""
    return F.when(b > 0, F.bround(F.lit(100.0) * a / b, places)).otherwise(F.lit(0.0))


def priced(tasks: DataFrame, prices: DataFrame) -> DataFrame:
    """A5: left join to the price list with the default rate as fallback. The list is the caller's: it is
    broadcast by its size, not by a hint."""
    p = prices.select("model", F.col("input_rate").alias("_in"), F.col("output_rate").alias("_out"))
    j = tasks.join(p, "model", "left")
    return (j.withColumn("input_rate", F.coalesce("_in", F.lit(D.DEFAULT_PRICE[0])))
            .withColumn("output_rate", F.coalesce("_out", F.lit(D.DEFAULT_PRICE[1]))).drop("_in", "_out"))


def scored_run_log(catalog, spark) -> DataFrame:
    """Run log with grounding, traversal credit and cost per task."""
    log = priced(D.run_log(catalog), D.prices(spark))
    g = S.grounded("tool_calls")
    return (log.withColumn("called_kb", g)
            .withColumn("tool_call_count", F.size("tool_calls"))
            .withColumn("traversal_ok", S.traversal_ok("category", F.col("called_kb"), F.col("correct")))
            .withColumn("cost_usd", S.task_cost("input_tokens", "output_tokens", "input_rate", "output_rate")))


def scorecard(tasks: DataFrame, by: str = "model") -> DataFrame:
    """one row per run."""
    n = F.count(F.lit(1))
    correct = F.sum(F.col("correct").cast("int"))
    multi = F.sum((F.col("category") == "multi_hop").cast("int"))
    agg = tasks.groupBy(by).agg(
        n.alias("n_tasks"), correct.alias("correct"),
        F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"),
        F.sum("cost_usd").alias("_cost"), F.sum("latency_ms").alias("_lat"),
        F.sum(F.col("called_kb").cast("int")).alias("_grounded"),
        F.sum(F.coalesce(F.col("traversal_ok"), F.lit(False)).cast("int")).alias("_trav"),
        multi.alias("multi_hop_n"), F.count_distinct("config_hash").alias("n_config_hashes"),
        F.min("config_hash").alias("config_hash_min"))
    return agg.select(
        by, "n_tasks", "correct", pct(F.col("correct"), F.col("n_tasks")).alias("overall_pct"),
        "tokens_in", "tokens_out", (F.col("tokens_in") + F.col("tokens_out")).alias("tokens_total"),
        F.bround((F.col("tokens_in") + F.col("tokens_out")) / F.col("n_tasks"), 1).alias("tokens_avg"),
        F.bround("_cost", 6).alias("cost_total"),
        F.bround(F.col("_cost") / F.col("n_tasks"), 6).alias("cost_avg"),
        F.when(F.col("correct") > 0, F.bround(F.col("_cost") / F.col("correct"), 6)).alias("cost_per_correct"),
        F.bround(F.col("_lat") / F.col("n_tasks"), 0).cast("long").alias("latency_avg"),
        pct(F.col("_grounded"), F.col("n_tasks")).alias("grounded_pct"),
        pct(F.col("_trav"), F.col("multi_hop_n")).alias("traversal_pct"),
        "multi_hop_n", (F.col("n_config_hashes") == 1).alias("single_config"), "n_config_hashes", "config_hash_min")


def latency_percentiles(tasks: DataFrame, by: str = "model", value: str = "latency_ms") -> DataFrame:
    """p50 = sorted[n//2], p95 = sorted[min(n-1, int(.95 n))], max, exact, for any numbers
    (milliseconds, seconds, ratios)."""
    picks = {"p50": upper_median, "p95": index_rank(0.95), "max": last_rank}
    return order_statistics(tasks, [by], value, picks).withColumnRenamed("n", "n_tasks")


def scorecard_by_category(tasks: DataFrame, by: str = "model") -> DataFrame:
    """per run and category plus the run total in one ``rollup`` pass."""
    r = tasks.rollup(by, "category").agg(F.count(F.lit(1)).alias("n"),
                                         F.sum(F.col("correct").cast("int")).alias("correct"),
                                         F.grouping(by).alias("_all"), F.grouping("category").alias("_total"))
    # the grouping flags tell a total from a NULL run or category, which are groups of their own
    return (r.where(F.col("_all") == 0)
            .select(by, F.when(F.col("_total") == 1, F.lit("ALL")).otherwise(F.col("category")).alias("category"), "n",
                    "correct", pct(F.col("correct"), F.col("n")).alias("pct"), (F.col("_total") == 1).alias("is_total")))


def config_uniformity(tasks: DataFrame, by: str = "model", expected: str | None = None) -> DataFrame:
    """Config hashes per run, across all runs, and equality with a pinned value.

    Works on the distinct (run, hash) pairs (partial aggregation; runs x hashes rows), written as one row
    a run. The view across runs is one aggregate of those rows (all hashes are one if the smallest and the
    largest are the same): two texts that come to the driver and go back as literals.
    """
    per = (tasks.select(by, "config_hash").distinct().groupBy(by)
           .agg(F.count("config_hash").alias("n_hashes"), F.min("config_hash").alias("hash_min"), F.max("config_hash").alias("_hash_max")))
    per = materialize(per, "run-hashes")
    low, high = per.agg(F.min("hash_min"), F.max("_hash_max")).first()
    one = low is not None and low == high
    pinned = one and low == (expected if expected is not None else low)
    return per.select(by, "n_hashes", "hash_min", (F.col("n_hashes") == 1).alias("single_config"), F.lit(one).alias("shared_across_runs"),
                      F.lit(pinned).alias("equals_pinned"))


def tuning_summary(tasks: DataFrame, by: list[str]) -> DataFrame:
    """F8: n, correct, accuracy (2 places), tokens, negative n and negative correct."""
    neg = F.col("category") == "negative"
    return tasks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("correct"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        F.sum(neg.cast("int")).alias("neg_n"), F.sum((neg & F.col("correct")).cast("int")).alias("neg_correct"),
    ).withColumn("accuracy_pct", pct(F.col("correct"), F.col("n"), 2))


def nested_scorecard(tasks: DataFrame, by: str = "model") -> DataFrame:
    """F1-F7 as one nested record per run (accuracy with per-category counts, tokens, cost, latency,
    grounding, config), the shape written by the A6 sink and read back by field path.

    The per-category list holds one entry per category (bounded by the category set, not by data).
    """
    flat = scorecard(tasks, by)
    lat = latency_percentiles(tasks, by).drop("n_tasks")
    cats = (scorecard_by_category(tasks, by).where(~F.col("is_total"))
            .groupBy(by).agg(F.array_sort(F.collect_list(F.struct("category", "n", "correct", "pct")))
                             .alias("by_category")))
    hashes = tasks.select(by, "config_hash").distinct().groupBy(by).agg(
        F.array_sort(F.collect_list("config_hash")).alias("config_hashes"))
    j = flat.join(lat, by).join(cats, by, "left").join(hashes, by, "left")
    return j.select(
        by, F.col("n_tasks"),
        F.struct(F.col("overall_pct"), F.col("correct"), F.col("by_category")).alias("accuracy"),
        F.struct(F.col("tokens_in").alias("input"), F.col("tokens_out").alias("output"),
                 F.col("tokens_total").alias("total"), F.col("tokens_avg").alias("avg_per_task")).alias("tokens"),
        F.struct(F.col("cost_total").alias("total_usd"), F.col("cost_avg").alias("avg_per_task_usd"),
                 F.col("cost_per_correct").alias("cost_per_correct_usd")).alias("cost"),
        F.struct(F.col("latency_avg").alias("avg"), "p50", "p95", "max").alias("latency_ms"),
        F.struct(F.col("grounded_pct").alias("called_pct"), F.col("traversal_pct").alias("multi_hop_traversal_ok_pct"),
                 F.col("multi_hop_n")).alias("grounding"),
        F.struct(F.col("config_hashes"), F.col("single_config")).alias("frozen_weights"))
