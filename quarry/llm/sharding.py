"""Shards by proportional stratified interleaving.

The rows of each source are put in a seeded random order; row r of n gets the fractional rank
(r - 1/2) / n. Sorted by it, the sources interleave in proportion everywhere, and equal cuts of
that order give shards that all match the mixture. Counts of two shards differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_index, seeded, written

SHARDS, SEED = 8, "shard"


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard(rows: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``rows`` (doc_id, source and other narrow columns) with ``shard`` from 0 and ``slot`` (gapless
    from 0 in each shard).

    A null source is a source of its own and comes last among equal ranks; ties go by the seeded
    draw and doc_id (null last); repeated rows take neighbouring places. No rows: no rows.
    """
    drawn = written(rows.withColumn("_u", seeded(seed, F.col("doc_id"))), "drawn")
    last = [F.col("doc_id").asc_nulls_last()]
    placed = global_index(drawn, [F.col("source").asc_nulls_last(), F.col("_u"), *last], "_place", "by-source")
    first = placed.groupBy(F.col("source").alias("_s")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ranked = placed.join(first, F.col("source").eqNullSafe(F.col("_s")))
    ranked = ranked.withColumn("_rank", (F.col("_place") - F.col("_first") + F.lit(0.5)) / F.col("_n")).drop("_place", "_first", "_s", "_n")
    keys = [F.col("_rank"), F.col("_u"), F.col("source").asc_nulls_last(), *last]
    mixed = global_index(written(ranked, "fractions"), keys, "_at", "interleaved")
    total = max(1, drawn.count())
    # integer arithmetic: shard = at * shards div total, which begins at ceil(shard * total / shards)
    mixed = mixed.withColumn("shard", F.expr(f"int(_at * {shards} div {total})"))
    start = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return mixed.withColumn("slot", F.col("_at") - start).drop("_at", "_u", "_rank")
