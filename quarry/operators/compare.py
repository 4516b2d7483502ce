"""Run comparison.

Runs are paired by task with one grouped pass (a task has one row per run, so the pairing
group is bounded by the number of runs), never by joining a run log with itself. The paired
bootstrap resamples the counts of the four paired outcome classes, so no global row numbering of the
pairs is needed and its cost doesn't depend on how many pairs there are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.scorecard import pct


def pair_runs(tasks: DataFrame, run_a: str, run_b: str, key: str = "task_id", by: str = "model",
              value: str = "correct") -> DataFrame:
    """Tasks answered by both runs -> ``(key, a_correct, b_correct)`` (unmatched dropped)."""
    sub = tasks.where(F.col(by).isin(run_a, run_b))
    g = sub.groupBy(key).agg(F.max(F.when(F.col(by) == run_a, F.col(value).cast("int"))).alias("a_correct"),
                             F.max(F.when(F.col(by) == run_b, F.col(value).cast("int"))).alias("b_correct"))
    return g.where(F.col("a_correct").isNotNull() & F.col("b_correct").isNotNull())


def with_anchor(tasks: DataFrame, anchor: str, key: str = "task_id", by: str = "model",
                value: str = "correct") -> DataFrame:
    """Every non-anchor row with the anchor's outcome on the same task.

    The anchor's outcomes (one row per task, combined by a grouped max) are joined on the task
    key: a hot key on the probe side is split by AQE's skew-join handling, which a window
    partitioned by the key could not do.
    """
    anchor_rows = (tasks.where(F.col(by) == anchor).groupBy(key)
                   .agg(F.max(F.col(value).cast("int")).alias("anchor_correct")))
    return tasks.where(F.col(by) != anchor).join(anchor_rows, key)


def pair_all(tasks: DataFrame, anchor: str, key: str = "task_id", by: str = "model",
             value: str = "correct") -> DataFrame:
    """G4 for every run against the anchor: ``(challenger, key, a_correct, b_correct)``."""
    return with_anchor(tasks, anchor, key, by, value).select(
        F.col(by).alias("challenger"), key, F.col(value).cast("int").alias("a_correct"),
        F.col("anchor_correct").alias("b_correct"))


def flips_all(tasks: DataFrame, anchor: str, key: str = "task_id", by: str = "model") -> DataFrame:
    """G8 for every run against the anchor."""
    p = pair_all(tasks, anchor, key, by)
    return p.where(F.col("a_correct") != F.col("b_correct")).withColumn(
        "direction", F.when(F.col("a_correct") > F.col("b_correct"), "gained").otherwise("lost"))


def miss_classes(tasks: DataFrame, anchor: str, key: str = "task_id", by: str = "model") -> DataFrame:
    """Per run, how its outcomes split against the anchor (shared miss, contested, ...)."""
    t = with_anchor(tasks, anchor, key, by)
    a, b = F.col("correct").cast("int"), F.col("anchor_correct")
    cls = (F.when((a == 0) & (b == 0), "shared_miss").when(a == 0, "contested_miss")
           .when(b == 0, "anchor_only_miss").otherwise("both_correct"))
    return t.groupBy(by, cls.alias("miss_class")).agg(F.count(F.lit(1)).alias("n"))


def flips(tasks: DataFrame, run_a: str, run_b: str, key: str = "task_id", by: str = "model") -> DataFrame:
    """Tasks whose outcome differs between two runs."""
    p = pair_runs(tasks, run_a, run_b, key, by)
    return p.where(F.col("a_correct") != F.col("b_correct")).select(
        key, "a_correct", "b_correct", F.when(F.col("a_correct") > F.col("b_correct"), "gained").otherwise("lost")
        .alias("direction"))


def metric_matrix(cards: DataFrame, metrics: list[str], runs: list[str], by: str = "model") -> DataFrame:
    """G1: metrics as rows, one column per run (unpivot, then pivot with the run list given)."""
    long = cards.select(by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [by], metrics, "metric", "value")
    return long.groupBy("metric").pivot(by, runs).agg(F.first("value"))


def metric_matrix_text(cards: DataFrame, by_category: DataFrame, configs: DataFrame, metrics: list[str],
                       categories: list[str], runs: list[str], by: str = "model") -> DataFrame:
    """G1 in full, as text: the metrics, the accuracy of each category and the config hash (first 12
    characters) as rows, one column per run; numbers with 8 places, ``-`` where a run has none."""
    number = lambda c: F.format_string("%.8f", c.cast("double"))
    long = cards.select(by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([by], metrics, "metric", "value")
    rows = long.where(F.col("value").isNotNull()).select(by, "metric", number(F.col("value")).alias("value"))
    parts = by_category.where(~F.col("is_total") & F.col("category").isin(categories)).select(
        by, F.concat("category", F.lit("_pct")).alias("metric"), number(F.col("pct")).alias("value"))
    hashes = configs.select(by, F.lit("config_hash").alias("metric"), F.substring("hash_min", 1, 12).alias("value"))
    names = [*metrics, *[f"{c}_pct" for c in categories], "config_hash"]
    pivot = rows.unionByName(parts).unionByName(hashes).groupBy("metric").pivot(by, runs).agg(F.first("value"))
    every = cards.sparkSession.createDataFrame([(n,) for n in names], "metric string")
    return every.join(pivot, "metric", "left").select("metric", *[F.coalesce(F.col(r), F.lit("-")).alias(r) for r in runs])


def _ref_value(col: str, ref_cond: Column) -> Column:
    return F.max(F.when(ref_cond, F.col(col))).over(Window.partitionBy())


def pareto_check(cards: DataFrame, reference: str, by: str = "model") -> DataFrame:
    """Challenger vs reference: both accuracies, accuracy >=, tokens <= 75%, cost <= 75%; ratios to 3 places.

    ``cards`` has one row per run, so the reference row is spread by a window over that small frame.
    """
    is_ref = F.col(by) == reference
    c = (cards.withColumn("_acc_r", _ref_value("overall_pct", is_ref))
         .withColumn("_tok_r", _ref_value("tokens_total", is_ref))
         .withColumn("_cost_r", _ref_value("cost_total", is_ref)))
    acc_ge = F.col("overall_pct") >= F.col("_acc_r")
    tok_less = (F.col("_tok_r") > 0) & (F.col("tokens_total") <= F.lit(0.75) * F.col("_tok_r"))
    cost_less = (F.col("_cost_r") > 0) & (F.col("cost_total") <= F.lit(0.75) * F.col("_cost_r"))
    return c.where(~is_ref).select(
        F.lit(reference).alias("reference"), F.col(by).alias("challenger"), F.col("_acc_r").alias("reference_pct"),
        F.col("overall_pct").alias("challenger_pct"), acc_ge.alias("accuracy_ge"),
        F.when(F.col("_tok_r") != 0, F.bround(F.col("tokens_total") / F.col("_tok_r"), 3)).alias("tokens_ratio"),
        F.when(F.col("_cost_r") != 0, F.bround(F.col("cost_total") / F.col("_cost_r"), 3)).alias("cost_ratio"),
        tok_less.alias("tokens_much_less"), cost_less.alias("cost_much_less"),
        (acc_ge & tok_less & cost_less).alias("pareto_win"))


def category_vs_anchor(by_cat: DataFrame, anchor: str, by: str = "model") -> DataFrame:
    """Correct counts per category, each run next to the anchor."""
    w = Window.partitionBy("category")
    return (by_cat.withColumn("anchor_correct", F.max(F.when(F.col(by) == anchor, F.col("correct"))).over(w))
            .where(F.col(by) != anchor).select(by, "category", "correct", "anchor_correct", "n"))


def passrate_cube(tasks: DataFrame, dims: list[str]) -> DataFrame:
    """Pass rate for every combination of ``dims`` including all margins (``cube``)."""
    c = tasks.cube(*dims).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("passed"),
                              F.grouping_id().alias("grouping"))
    return c.withColumn("pass_pct", pct(F.col("passed"), F.col("n")))


def cost_projection(cards: DataFrame, prices: DataFrame, anchor: str, multiplier: float = 2.5,
                    ceiling_usd: float = 2.0, by: str = "model", default=(1.0, 5.0)) -> DataFrame:
    """Dollars for one pass at the anchor's token volume, times a safety multiplier, vs a ceiling."""
    is_a = F.col(by) == anchor
    c = (cards.withColumn("_a_in", _ref_value("tokens_in", is_a)).withColumn("_a_out", _ref_value("tokens_out", is_a))
         .join(prices, by, "left"))
    rin = F.coalesce(F.col("input_rate"), F.lit(default[0]))
    rout = F.coalesce(F.col("output_rate"), F.lit(default[1]))
    usd = (F.col("_a_in") / F.lit(1e6)) * rin + (F.col("_a_out") / F.lit(1e6)) * rout
    return c.select(by, F.col("_a_in").alias("anchor_tokens_in"), F.col("_a_out").alias("anchor_tokens_out"),
                    F.bround(usd, 4).alias("answer_usd"), F.bround(usd * F.lit(multiplier), 4).alias("projected_usd"),
                    (F.bround(usd * F.lit(multiplier), 4) <= F.lit(ceiling_usd)).alias("within_ceiling"))


def relative_savings(cards: DataFrame, anchor: str, by: str = "model") -> DataFrame:
    """% cheaper per query and per correct answer, and dollars saved per million queries."""
    is_a = F.col(by) == anchor
    c = (cards.withColumn("_q", _ref_value("cost_avg", is_a)).withColumn("_k", _ref_value("cost_per_correct", is_a)))
    return c.where(~is_a).select(
        by, F.bround((F.col("_q") - F.col("cost_avg")) / F.col("_q") * 100, 1).alias("pct_cheaper_per_query"),
        F.bround((F.col("_k") - F.col("cost_per_correct")) / F.col("_k") * 100, 1).alias("pct_cheaper_per_correct"),
        F.bround((F.col("_q") - F.col("cost_avg")) * F.lit(1e6), 2).alias("saved_per_1m_queries"))


# --- G5: paired bootstrap -------------------------------------------------------------------------

def hash_index(seed: int, r: Column, j: Column, m: Column) -> Column:
    """Draw index in [0, m): first 32 bits of md5('seed:r:j') modulo m (same in SQL engines)."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), r.cast("string"), j.cast("string"))), 1, 8), 16, 10)
    return h.cast("long") % m


def _draws_hash(reps: DataFrame, seed: int, chunk: int) -> DataFrame:
    """``(challenger, r, ka, kb)`` from hash draws. Each (run, resample) row expands its m draws in
    chunks of at most ``chunk`` (two bounded explodes with a repartition between), so no row ever
    holds a large array and the draws spread over all tasks."""
    m = F.col("m")
    n_parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = (reps.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(m / F.lit(chunk)).cast("long") - 1))
                          .alias("_ch"))
              .repartition(n_parts, "challenger", "r", "_ch"))
    draws = chunks.select("challenger", "r", "m", "c11", "c10", "c01", F.explode(F.sequence(
        F.col("_ch") * F.lit(chunk), F.least(m, (F.col("_ch") + 1) * F.lit(chunk)) - 1)).alias("j"))
    idx = hash_index(seed, F.col("r"), F.col("j"), m)
    d = draws.select("challenger", "r", "m", "c11", "c10", "c01", idx.alias("idx"))
    a = (F.col("idx") < F.col("c11") + F.col("c10")).cast("long")
    b = ((F.col("idx") < F.col("c11")) | ((F.col("idx") >= F.col("c11") + F.col("c10"))
                                          & (F.col("idx") < F.col("c11") + F.col("c10") + F.col("c01")))).cast("long")
    return d.groupBy("challenger", "r", "m", "c11", "c10", "c01").agg((F.sum(a) / F.col("m")).alias("ka"),
                                                                     (F.sum(b) / F.col("m")).alias("kb"))


def uniform(seed: int, *parts: Column) -> Column:
    """A double in (0, 1): 52 bits of the md5 of ``seed:part:...``. A counter-based generator: every
    number depends on its own counters alone, so any engine, partition or rerun draws the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def binomial_quantiles(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each (n, p, u) the binomial outcome that the uniform ``u`` picks, by inversion from the mode:
    outcomes are laid out as mode, mode + 1, mode - 1, mode + 2, ... and the first whose running
    probability exceeds u is taken. All rows step together, some standard deviations (not n) steps."""
    n, u = np.asarray(n, np.int64), np.asarray(u, float)
    p = np.clip(np.where(n > 0, p, 0.0), 0.0, 1.0)
    mode = np.minimum(np.floor((n + 1) * p).astype(np.int64), n)
    out = mode.copy()
    todo = np.flatnonzero((p > 0) & (p < 1))
    n, p, u, k = n[todo], p[todo], u[todo], mode[todo]
    lg = np.frompyfunc(math.lgamma, 1, 1)
    log = (lg(n + 1) - lg(k + 1) - lg(n - k + 1)).astype(float) + k * np.log(p) + (n - k) * np.log1p(-p)
    up = down = run = np.exp(log)
    high = low = k
    odds = p / (1 - p)
    while True:
        left = u >= run
        todo, n, u, k, up, down, run, high, low, odds = (x[left] for x in (todo, n, u, k, up, down, run, high, low, odds))
        if not len(todo):
            return out
        ended = (high >= n) & (low <= 0)  # rounding left a rest: the mode stays
        up = np.where(high < n, up * (n - high) / (high + 1) * odds, 0.0)
        high = np.minimum(high + 1, n + 1)
        run = run + up
        hit = (u < run) & (high <= n) & ~ended
        out[todo[hit]] = high[hit]
        down = np.where(low > 0, down * low / ((n - low + 1) * odds), 0.0)
        low = np.maximum(low - 1, -1)
        run = np.where(hit | ended, np.inf, run + down)
        hit = ~hit & ~ended & (u < run) & (low >= 0)
        out[todo[hit]] = low[hit]
        run = np.where(hit, np.inf, run)


def _draws_multinomial(reps: DataFrame, seed: int) -> DataFrame:
    """``(challenger, r, ka, kb)``: the class counts of a resample are one multinomial draw, made as three
    binomial draws, each given those before it. One row a resample, however many tasks there are."""
    def draw(batches):
        for pdf in batches:
            m = pdf["m"].to_numpy()
            left, rest, drawn = m.copy(), m.astype(float), []
            for i, c in enumerate(("c11", "c10", "c01")):
                size = pdf[c].to_numpy()
                got = binomial_quantiles(left, np.divide(size, rest, out=np.zeros(len(pdf)), where=rest > 0), pdf[f"u{i}"].to_numpy())
                drawn.append(got)
                left, rest = left - got, rest - size
            n11, n10, n01 = drawn
            yield pdf.drop(columns=["u0", "u1", "u2"]).assign(ka=(n11 + n10) / m, kb=(n11 + n01) / m)

    numbers = [uniform(seed, F.col("challenger"), F.col("r"), F.lit(i)).alias(f"u{i}") for i in range(3)]
    return reps.select("challenger", "r", "m", "c11", "c10", "c01", *numbers).mapInPandas(
        draw, "challenger string, r long, m long, c11 long, c10 long, c01 long, ka double, kb double")


def bootstrap_table(counts: DataFrame, resamples: int, seed: int, method: str = "multinomial", chunk: int = 1_000_000) -> DataFrame:
    """G5 for every row of ``counts`` (challenger, m, c11, c10, c01; one row per compared run): observed
    accuracies, paired delta and the intervals [sorted[int(.025 R)], sorted[int(.975 R)]] of both
    accuracies and the delta, rounded to 1 place. Everything stays in the plan. The caller names the
    draws, at any size: ``multinomial`` (three conditional binomials a resample) or ``hash`` (every drawn
    index, m a resample)."""
    if method not in ("hash", "multinomial"):
        raise ValueError(f"unknown method {method}")
    counts = counts.where(F.col("m") > 0)
    n_parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = (counts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))).alias("r"))
            .repartition(n_parts, "challenger", "r"))
    draws = _draws_hash(reps, seed, chunk) if method == "hash" else _draws_multinomial(reps, seed)
    drawn = draws.select("challenger", "r", "m", "c11", "c10", "c01", (F.col("ka") * 100.0).alias("a"), (F.col("kb") * 100.0).alias("b"),
                         ((F.col("ka") - F.col("kb")) * 100.0).alias("d"))
    # R rows per run (a parameter, not data volume): the ordered windows per run are bounded.
    place = lambda c: F.row_number().over(Window.partitionBy("challenger").orderBy(c, "r")) - 1
    ranked = drawn.select("*", *[place(c).alias(f"_{c}") for c in "abd"])
    ends = [(int(0.025 * resamples), "lo"), (int(0.975 * resamples), "hi")]
    # the counts travel with every resample row, so the observed figures need no join
    ci = ranked.groupBy("challenger", "m", "c11", "c10", "c01").agg(*[
        F.bround(F.max(F.when(F.col(f"_{c}") == at, F.col(c))), 1).alias(name + end)
        for c, name in (("a", "acc_a_"), ("b", "acc_b_"), ("d", "ci_")) for at, end in ends])
    acc_a = F.bround(F.lit(100.0) * (F.col("c11") + F.col("c10")) / F.col("m"), 1)
    acc_b = F.bround(F.lit(100.0) * (F.col("c11") + F.col("c01")) / F.col("m"), 1)
    return ci.withColumn("acc_a_pct", acc_a).withColumn("acc_b_pct", acc_b).select(
        F.col("challenger").alias("model_a"), "m", F.lit(resamples).cast("long").alias("resamples"), "acc_a_pct", "acc_a_lo", "acc_a_hi",
        "acc_b_pct", "acc_b_lo", "acc_b_hi", F.bround(F.col("acc_a_pct") - F.col("acc_b_pct"), 1).alias("delta_pct"), "ci_lo", "ci_hi",
        ((F.col("ci_lo") <= 0) & (F.col("ci_hi") >= 0)).alias("includes_zero"))


def _class_counts(pairs: DataFrame) -> DataFrame:
    a, b = F.col("a_correct"), F.col("b_correct")
    return pairs.groupBy("challenger").agg(
        F.count(F.lit(1)).alias("m"), F.sum(((a == 1) & (b == 1)).cast("long")).alias("c11"),
        F.sum(((a == 1) & (b == 0)).cast("long")).alias("c10"), F.sum(((a == 0) & (b == 1)).cast("long")).alias("c01"))


def _shape(out: DataFrame, anchor: str) -> DataFrame:
    return out.select("model_a", F.lit(anchor).alias("model_b"), F.col("m").cast("long").alias("n_paired"), "resamples", "acc_a_pct",
                      "acc_a_lo", "acc_a_hi", "acc_b_pct", "acc_b_lo", "acc_b_hi", "delta_pct", "ci_lo", "ci_hi", "includes_zero")


def paired_bootstrap_ci(spark, tasks: DataFrame, run_a: str, run_b: str, resamples: int = 10_000,
                        seed: int = 20260731, method: str = "multinomial", key: str = "task_id",
                        by: str = "model") -> DataFrame:
    """G5 for one run against another (see ``bootstrap_table``)."""
    pairs = pair_runs(tasks, run_a, run_b, key, by).withColumn("challenger", F.lit(run_a))
    return _shape(bootstrap_table(_class_counts(pairs), resamples, seed, method), run_b)


def paired_bootstrap_vs_anchor(spark, tasks: DataFrame, anchor: str, resamples: int = 10_000,
                               seed: int = 20260731, method: str = "multinomial", key: str = "task_id",
                               by: str = "model") -> DataFrame:
    """G5 for every run against the anchor, all runs in one plan."""
    return _shape(bootstrap_table(_class_counts(pair_all(tasks, anchor, key, by)), resamples, seed, method), anchor)


def verdict_clauses(cards: DataFrame, boot: DataFrame, neg: DataFrame, anchor: str, by: str = "model",
                    grounded_min: float = 95.0) -> DataFrame:
    """The four verdict clauses for every run of ``boot`` (``paired_bootstrap_vs_anchor``) against the
    anchor, as booleans, and ``verdict_met`` if all hold. A run without priced tasks has no cost clause (NULL).

    Inputs have one row a run; they are joined by run, the anchor's cost is spread by an aggregate of
    the cards (one row).
    """
    anchor_cost = F.max(F.when(F.col(by) == anchor, F.col("cost_total"))).over(Window.partitionBy())
    c = cards.withColumn("_anchor_cost", anchor_cost).select(F.col(by).alias("challenger"), "grounded_pct", "cost_total", "_anchor_cost")
    n = neg.select(F.col(by).alias("challenger"), "neg_n", "neg_correct")
    b = boot.select(F.col("model_a").alias("challenger"), F.col("includes_zero").alias("accuracy_within_noise"))
    clauses = b.join(c, "challenger").join(n, "challenger").select(
        "challenger", "accuracy_within_noise", (F.col("grounded_pct") >= grounded_min).alias("grounded_ok"),
        (F.col("neg_correct") == F.col("neg_n")).alias("refusals_kept"), (F.col("cost_total") < F.col("_anchor_cost")).alias("cost_lower"))
    return clauses.withColumn("verdict_met", F.col("accuracy_within_noise") & F.col("grounded_ok") & F.col("refusals_kept") & F.col("cost_lower"))
