"""Exact top-k search: tiled matrix products, selection in each tile, tree merge of the lists.

Rows and queries are numbered in order of their id and cut into shards and panels of fixed size, so
neither copies of one vector nor repeats of one id make a large group. Each (shard, panel) tile is one
matrix product in one task; it hands on ``k`` rows a query. Lists of ``FAN_IN`` tiles are merged at a
time, level after level, so a merge never holds more than FAN_IN * k rows of a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import global_index, shuffle_partitions, written

SCALE = 1024
#: rows of a shard, queries of a panel, lists merged at a time
SHARD, PANEL, FAN_IN = 4096, 4096, 16
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def clean(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part: id and vector not null, no
    component null or not finite."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers held as doubles, exact: by doubles
    while no partial sum can leave their exact range, else by Python's integers, clipped to 64 bits."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if most < 2.0 ** 53:
        return (left @ right.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(left).astype(object) @ whole(right).astype(object).T
    return np.clip(exact, _LOW + 1, _HIGH).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of ``scores`` the columns of its k largest, ties to the smaller id; ``ids`` ascend,
    and columns of the lowest long are left out."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
    else:
        least = np.full(len(scores), _LOW)
    out = []
    for row, low in zip(scores, least):
        some = np.flatnonzero((row >= low) & (row > _LOW))
        out.append(some[np.argsort(-row[some], kind="stable")][:k])
    return out


def _tile(k: int, scale: int):
    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": [], "shard": []}
        if len(rows) and len(asked):
            rows = rows.sort_values("vec_id", kind="stable")
            lengths, wide = rows.embedding.map(len).to_numpy(), asked.embedding.map(len).to_numpy()
            for d in np.intersect1d(lengths, wide):
                r, q = rows[lengths == d], asked[wide == d]
                ids, own = r.vec_id.to_numpy(), q.vec_id.to_numpy()
                # vectors of no component: all products are 0
                held, asks = (np.floor(scale * np.array(x.embedding.tolist(), float).reshape(len(x), d)) for x in (r, q))
                scores = _products(asks, held)
                scores[own[:, None] == ids[None, :]] = _LOW
                for i, columns in enumerate(select(scores, ids, k)):
                    out["query_id"].append(np.full(len(columns), own[i]))
                    out["vec_id"].append(ids[columns])
                    out["score"].append(scores[i, columns])
                    out["shard"].append(np.full(len(columns), rows["shard"].iloc[0]))
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.int64, "shard": np.int64}
        return pd.DataFrame({c: np.concatenate([np.empty(0, kinds[c]), *v]).astype(kinds[c]) for c, v in out.items()})

    return run


def merge(lists: DataFrame, k: int, shards: int, fan_in: int = FAN_IN) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of each query's ``k`` best of the lists (query_id, vec_id,
    score, shard) of ``shards`` shards, merged ``fan_in`` at a time."""
    while True:
        shards = max(1, -(-shards // fan_in))
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan_in))
        best = Window.partitionBy("query_id", "shard").orderBy(F.col("score").desc(), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE, shard: int = SHARD, panel: int = PANEL,
          fan_in: int = FAN_IN) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the ``k`` rows of ``rows`` of largest score for each row of
    ``queries`` (both vec_id, embedding), without rows of the query's own id.

    score: inner product of floor(scale * x), exact; beyond 64 bits it is the nearest long and ties as
    such. Ties go to the smaller vec_id. Fewer than k rows: all of them. Vectors of different lengths
    aren't compared. Rows without id, and vectors null or with null or non-finite components, take no
    part. Rows that repeat an id are rows of their own; a query id given more than once asks once, with
    the smallest of its vectors. Other columns aren't looked at; empty tables give no rows.
    """
    spark = rows.sparkSession
    asks = clean(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    held = written(global_index(clean(rows), [F.col("vec_id")], "at", "rows").withColumn("shard", F.floor(F.col("at") / shard)).drop("at"), "shards")
    asks = written(global_index(asks, [F.col("vec_id")], "at", "queries").withColumn("panel", F.floor(F.col("at") / panel)).drop("at"), "panels")
    # how many of each there are: two numbers
    shards = (held.agg(F.max("shard")).first()[0] or 0) + 1
    panels = (asks.agg(F.max("panel")).first()[0] or 0) + 1
    held = held.withColumn("panel", F.explode(F.sequence(F.lit(0), F.lit(panels - 1)).cast("array<bigint>")))
    asks = asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
    # a fixed number of tasks: small partitions aren't merged, tiles run side by side
    n = min(shards * panels, 8 * shuffle_partitions(spark))
    tiles = [x.repartition(n, "shard", "panel").groupBy("shard", "panel") for x in (held, asks)]
    lists = tiles[0].cogroup(tiles[1]).applyInPandas(_tile(k, scale), "query_id long, vec_id long, score long, shard long")
    return merge(lists, k, shards, fan_in)
