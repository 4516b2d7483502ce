"""Evaluate many questions over one base frame in a single scan (multi-question batching).

Each question is a predicate, an optional member expression and an optional numeric value,
plus a reducer. Every base row is tagged with the questions it satisfies (an exploded array of
``(qid, member, value)``), one grouped aggregation by ``(qid, member)`` (partial, map-side:
a question whose member is constant collapses to one row per map task), then each reducer reads
its questions from that aggregate. N questions over the same table cost one scan and one
shuffle instead of N scans; the aggregate's exchange is reused by every reducer branch.

Reducers: ``count`` (rows), ``count_distinct`` (non-NULL members), ``set`` (distinct non-NULL
members), ``avg`` / ``max`` (of value, rounded to 2 places), ``top1`` (most frequent member,
ties by member ascending).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDUCERS = ("count", "count_distinct", "set", "avg", "max", "top1")


@dataclass(frozen=True)
class BatchQuestion:
    qid: str
    reducer: str
    where: Column | None = None
    member: Column | None = None
    value: Column | None = None


def _is_integral(c: Column, base: DataFrame) -> bool:
    dt = base.select(c).schema.fields[0].dataType
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _conditional(base: DataFrame, questions: list[BatchQuestion]) -> DataFrame:
    """Scalar questions (count, avg, max) as conditional aggregates of one global ``agg``: no row is
    copied, and each task hands on one row."""
    aggs = []
    for i, q in enumerate(questions):
        inside = q.where if q.where is not None else F.lit(True)
        if q.reducer == "count":
            aggs.append(F.count(F.when(inside, 1)).cast("double").alias(f"q{i}"))
        else:
            value = F.when(inside, q.value.cast("double"))
            aggs.append(F.round((F.avg if q.reducer == "avg" else F.max)(value), 2).alias(f"q{i}"))
    row = base.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(q.qid).alias("id"), F.lit(None).cast("string").alias("value_text"),
                               F.col(f"q{i}").alias("value_num")) for i, q in enumerate(questions)])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def evaluate(base: DataFrame, questions: list[BatchQuestion]) -> DataFrame:
    """``(id, value_text, value_num)`` rows for every question (scalar: one row, set: one per member):
    scalars as conditional aggregates, the rest by tags; one narrow scan of ``base`` for each kind."""
    for q in questions:
        if q.reducer not in REDUCERS:
            raise ValueError(f"unknown reducer {q.reducer}")
    scalar = [q for q in questions if q.reducer in ("count", "avg", "max")]
    tagged = [q for q in questions if q not in scalar]
    parts = ([_conditional(base, scalar)] if scalar else []) + ([_tagged(base, tagged)] if tagged else [])
    return reduce(DataFrame.unionByName, parts)


def _tagged(base: DataFrame, questions: list[BatchQuestion]) -> DataFrame:
    """``(id, value_text, value_num)`` rows for every question (scalar: one row, set: one per member).

    One scan of ``base``, then two small aggregations with a single consumer each: level 1 by
    (question, member); level 2 by (question, member for set questions else NULL). No per-question
    filter sits above a shared aggregate, so the optimizer cannot split the plan into one scan per
    reducer. Tags carry a question index and typed members (integral members stay numbers);
    text is produced only after aggregation.
    """
    tags = []
    for i, q in enumerate(questions):
        integral = q.member is not None and _is_integral(q.member, base)
        t = F.struct(F.lit(i).alias("qi"),
                     (q.member.cast("string") if q.member is not None and not integral
                      else F.lit(None).cast("string")).alias("ms"),
                     (q.member.cast("long") if integral else F.lit(None).cast("long")).alias("ml"),
                     (q.value.cast("double") if q.value is not None else F.lit(None).cast("double")).alias("v"))
        tags.append(F.when(q.where, t) if q.where is not None else t)
    # plain explode + null filter keeps the stage in generated code (a lambda filter would not)
    tagged = base.select(F.explode(F.array(*tags)).alias("t")).where(F.col("t").isNotNull()).select("t.*")
    lvl1 = tagged.groupBy("qi", "ms", "ml").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"),
                                               F.count("v").alias("nv"), F.max("v").alias("mx"))
    # counts are 0, not missing, when no row matched: one zero row per counting question
    zero_ids = [i for i, q in enumerate(questions) if q.reducer in ("count", "count_distinct")]
    if zero_ids:
        zeros = base.sparkSession.createDataFrame(
            [(i,) for i in zero_ids], "qi int").select(
            "qi", F.lit(None).cast("string").alias("ms"), F.lit(None).cast("long").alias("ml"),
            F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("s"),
            F.lit(0).cast("long").alias("nv"), F.lit(None).cast("double").alias("mx"))
        lvl1 = lvl1.unionByName(zeros)
    lvl1 = lvl1.withColumn("member", F.coalesce(F.col("ms"), F.col("ml").cast("string")))
    kinds = F.array(*[F.lit(q.reducer) for q in questions])
    names = F.array(*[F.lit(q.qid) for q in questions])
    kind = F.element_at(kinds, F.col("qi") + 1)
    lvl2 = lvl1.groupBy("qi", F.when(kind == "set", F.col("member")).alias("set_member")).agg(
        F.sum("n").alias("n"), F.count("member").alias("n_members"), F.sum("s").alias("s"), F.sum("nv").alias("nv"),
        F.max("mx").alias("mx"),
        # most frequent member; ties by member ascending with NULL last (as ORDER BY n DESC, member)
        F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("member").isNull().alias("is_null"),
                       F.col("member").alias("m"))).alias("best"))
    k = F.element_at(kinds, F.col("qi") + 1)
    out = lvl2.select(
        F.element_at(names, F.col("qi") + 1).alias("id"),
        F.when(k == "set", F.col("set_member")).when(k == "top1", F.col("best.m")).alias("value_text"),
        F.when(k == "count", F.col("n").cast("double"))
         .when(k == "count_distinct", F.col("n_members").cast("double"))
         .when(k == "avg", F.round(F.col("s") / F.col("nv"), 2))
         .when(k == "max", F.round(F.col("mx"), 2)).alias("value_num"),
        k.alias("_k"))
    return out.where((F.col("_k") != "set") | F.col("value_text").isNotNull()).drop("_k")
