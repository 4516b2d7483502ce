"""Nearest neighbours by hierarchical navigable small-world graphs, one a shard, in flat arrays.

Nearness is the largest inner product. Inside a shard every vector gets one more component so that
all have the same length; the nearest by angle among them is the one of largest inner product with
a query. Points are inserted and queries searched many at a time: each step expands the best open
candidates of all of them with a few array operations.

Equal vectors are one point that carries its smallest ids, so groups of copies of any size cost one
point and lose no result.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LINKS, WIDTH_BUILD, WIDTH_SEARCH, SEED = 16, 96, 160, 4
#: points of a shard (expected), queries of a block
SHARD_POINTS, QUERY_BLOCK = 16384, 4096
_AT_ONCE, _OPEN = 256, 4
#: partitions for each group that a task of its own should get (groups are placed by hash), and the most
#: partitions of a shuffle; beyond it tasks take several groups, one after the other
_SPREAD, _MOST = 2, 50_000


@dataclass
class Graph:
    """``links[level]``: a row of neighbours (-1: none) for each point; points are sorted by level, so
    level l holds the first ``sizes[l]`` points, and point 0 is the entry."""

    points: np.ndarray
    links: list[np.ndarray]
    sizes: list[int]


def _beam(graph: Graph, level: int, q: np.ndarray, start: np.ndarray, width: int, ready: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores (best first, -1 and -inf for none) of the ``width`` best found for each query,
    from ``start`` ids, among the first ``ready`` points."""
    n, links = len(q), graph.links[level]
    rows = np.arange(n)[:, None]
    seen = np.zeros((n, ready), bool)
    slot = np.zeros((n, ready), np.int16)
    ids = np.full((n, width), -1, np.int64)
    score = np.full((n, width), -np.inf, np.float32)
    k = min(width, start.shape[1])
    ids[:, :k] = start[:, :k]
    valid = ids >= 0
    score[valid] = np.einsum("nd,nd->n", graph.points[ids[valid]], q[np.nonzero(valid)[0]])
    seen[np.nonzero(valid)[0], ids[valid]] = True
    open_ = valid.copy()
    live = np.arange(n)
    while len(live):
        # the best open candidates of each live query
        rank = np.where(open_[live], score[live], -np.inf)
        pick = np.argpartition(-rank, min(_OPEN, width) - 1, axis=1)[:, :_OPEN]
        good = np.take_along_axis(rank, pick, 1) > -np.inf
        use = good.any(axis=1)
        live, pick, good = live[use], pick[use], good[use]
        if not len(live):
            break
        r = live[:, None]
        open_[r, pick] = False
        near = links[np.where(good, ids[r, pick], 0)].astype(np.int64)
        near[~good] = -1
        near = near.reshape(len(live), -1)
        near[near >= ready] = -1
        ok = near >= 0
        ok[ok] = ~seen[np.broadcast_to(r, near.shape)[ok], near[ok]]
        at = np.broadcast_to(np.arange(near.shape[1], dtype=np.int16), near.shape)
        slot[np.broadcast_to(r, near.shape)[ok], near[ok]] = at[ok]
        ok[ok] = slot[np.broadcast_to(r, near.shape)[ok], near[ok]] == at[ok]
        rr = np.nonzero(ok)[0]
        seen[live[rr], near[ok]] = True
        fresh = np.full(near.shape, -np.inf, np.float32)
        fresh[ok] = np.einsum("nd,nd->n", graph.points[near[ok]], q[live[rr]])
        all_score = np.concatenate([score[live], fresh], axis=1)
        all_ids = np.concatenate([ids[live], np.where(ok, near, -1)], axis=1)
        all_open = np.concatenate([open_[live], ok], axis=1)
        top = np.argpartition(-all_score, width - 1, axis=1)[:, :width]
        score[live], ids[live] = np.take_along_axis(all_score, top, 1), np.take_along_axis(all_ids, top, 1)
        open_[live] = np.take_along_axis(all_open, top, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def _select(points: np.ndarray, of: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """For each row the neighbours to link: best first, and only those nearer to the point than to any
    neighbour already chosen; places left are filled with the best of the rest."""
    n, c = ids.shape
    valid = ids >= 0
    v = points[np.where(valid, ids, 0)]
    to = np.where(valid, np.einsum("ncd,nd->nc", v, of), -np.inf)
    order = np.argsort(-to, axis=1, kind="stable")
    ids, to, v = np.take_along_axis(ids, order, 1), np.take_along_axis(to, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    between = v @ v.transpose(0, 2, 1)
    chosen, count = np.zeros((n, c), bool), np.zeros(n, int)
    worst = np.full((n, c), -np.inf)
    for j in range(c):
        take = (to[:, j] > worst[:, j]) & (count < most) & (to[:, j] > -np.inf)
        chosen[:, j] = take
        count += take
        worst = np.where(take[:, None], np.maximum(worst, between[:, j]), worst)
    key = np.where(chosen, 0, np.where(to > -np.inf, 1, 2)) * c + np.arange(c)
    first = np.argsort(key, axis=1)[:, :most]
    out = np.take_along_axis(np.where(to > -np.inf, ids, -1), first, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _link(graph: Graph, level: int, fresh: np.ndarray, found: np.ndarray, most: int) -> None:
    """Link the points ``fresh`` with the best of ``found``, and those back."""
    links = graph.links[level]
    chosen = _select(graph.points, graph.points[fresh], found, most)
    links[fresh, :] = -1
    links[fresh, :most] = chosen
    source, target = np.repeat(fresh, most)[chosen.ravel() >= 0], chosen.ravel()[chosen.ravel() >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
    for at in range(0, len(nodes), 1024):
        t, b, k = nodes[at:at + 1024], begin[at:at + 1024], count[at:at + 1024]
        more = np.full((len(t), int(k.max())), -1, np.int64)
        place = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        more[np.repeat(np.arange(len(t)), k), place] = source[b[0]:b[0] + int(k.sum())]
        both = np.concatenate([links[t].astype(np.int64), more], axis=1)
        full = (both >= 0).sum(axis=1) > links.shape[1]
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        links[t[~full]] = packed[~full][:, :links.shape[1]]
        if full.any():
            links[t[full]] = _select(graph.points, graph.points[t[full]], packed[full], links.shape[1])


def build(vectors: np.ndarray) -> tuple[Graph, np.ndarray]:
    """The graph of the rows of ``vectors``, and the order in which it holds them."""
    n = len(vectors)
    rng = np.random.default_rng(SEED)
    level = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 8)
    order = np.argsort(-level, kind="stable")
    level = level[order]
    v = vectors[order].astype(np.float64)
    square = (v * v).sum(axis=1)
    tall = np.sqrt(np.maximum(0, square.max(initial=0) - square))
    points = np.column_stack([v, tall]).astype(np.float32)
    sizes = [int((level >= k).sum()) for k in range((level.max(initial=0)) + 1)]
    graph = Graph(points, [np.full((s, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k, s in enumerate(sizes)], sizes)
    at = 1
    while at < n:
        upto = min(n, at + min(_AT_ONCE, max(1, at)))
        fresh = np.arange(at, upto)
        q = points[fresh]
        start = np.zeros((len(fresh), 1), np.int64)
        for k in range(len(sizes) - 1, -1, -1):
            here = fresh < sizes[k]
            ready = min(at, sizes[k])
            start, _ = _beam(graph, k, q, start, WIDTH_BUILD if here.any() else 4, ready)
            if here.any():
                own = fresh[here]
                # the others of the batch are candidates too
                among = np.broadcast_to(own, (len(own), len(own))).copy()
                np.fill_diagonal(among, -1)
                if len(own) > 64:
                    score = points[own] @ points[own].T
                    np.fill_diagonal(score, -np.inf)
                    among = own[np.argpartition(-score, 32, axis=1)[:, :32]]
                _link(graph, k, own, np.concatenate([start[here], among], axis=1), LINKS)
        at = upto
    return graph, order


def search(graph: Graph, queries: np.ndarray, k: int, width: int = WIDTH_SEARCH) -> np.ndarray:
    """Numbers of the points found nearest to each query (-1: none), ``k`` or more of them if there are."""
    out = []
    wide = max(width, 2 * k)
    for at in range(0, len(queries), _AT_ONCE):
        q = np.column_stack([queries[at:at + _AT_ONCE], np.zeros(len(queries[at:at + _AT_ONCE]))]).astype(np.float32)
        start = np.zeros((len(q), 1), np.int64)
        for level in range(len(graph.sizes) - 1, -1, -1):
            start, _ = _beam(graph, level, q, start, wide if level == 0 else 8, graph.sizes[level])
        out.append(start[:, :wide])
    return np.concatenate(out)


def _to_bytes(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def clean(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part: id and vector not null, no null
    or non-finite component, not all zero."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(
        ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0))


def build_index(rows: DataFrame, k: int, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(size, shard, index): one graph for each shard of the distinct vectors of ``rows`` (vec_id,
    embedding); each point carries the k + 1 smallest ids of its vector. Vectors of different
    lengths go to different shards."""
    first = Window.partitionBy("embedding").orderBy("vec_id")
    points = (rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
              .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    points = written(points.withColumn("size", F.size("embedding")), "points")
    shards = points.groupBy("size").agg(F.ceil(F.count(F.lit(1)) / shard_points).cast("int").alias("shards"))
    total = shards.agg(F.sum("shards").alias("n")).first().n or 1
    # one row a vector length: n lengths need vectors of n * (n + 1) / 2 components, so 100 TB of floats hold 7 million at most
    dealt = points.join(F.broadcast(shards), "size").withColumn("shard", F.pmod(F.xxhash64("embedding"), F.col("shards")).cast("int"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.iloc[np.argsort(part.ids.map(lambda x: x[0]).to_numpy())]
        vectors = np.array(part.embedding.tolist(), float)
        graph, order = build(vectors)
        ids = [part.ids.iloc[i] for i in order]
        held = _to_bytes(vectors=vectors[order], points=graph.points, sizes=np.array(graph.sizes), ids=np.concatenate(ids),
                         ends=np.cumsum([len(x) for x in ids]), **{f"links{i}": x for i, x in enumerate(graph.links)})
        return pd.DataFrame({"size": [vectors.shape[1]], "shard": [int(part.shard.iloc[0])], "index": [held]})

    # a number of partitions of our own: adaptive execution leaves it, so shards are built in tasks of their own
    dealt = dealt.select("size", "shard", "embedding", "ids").repartition(min(_SPREAD * total, _MOST), "size", "shard")
    return written(dealt.groupBy("size", "shard").applyInPandas(run, "size int, shard int, index binary"), "index")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the ``k`` rows of ``rows`` found nearest to each row of
    ``queries`` (both vec_id, embedding), without the row of the query's own id.

    Vectors null, zero or with null or non-finite components take no part; equal scores go to the
    smaller vec_id; a query row given twice counts once; empty tables give no rows. Blocks of
    queries meet the shards in tasks of their own; each gives its best, and the best of those stay.
    """
    index = build_index(clean(rows), k, shard_points)
    asked = written(clean(queries).dropDuplicates(["vec_id"]).withColumn("size", F.size("embedding")), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    # the shards of a length, listed in one row of it (bounded as the lengths are; a shard is 4 bytes for its 16,384 points)
    known = index.groupBy("size").agg(F.collect_list("shard").alias("shards"))
    tasks = blocks * max(1, index.count())
    pairs = asked.join(F.broadcast(known), "size").withColumn("shard", F.explode("shards")).drop("shards")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs, held = (x.repartition(min(_SPREAD * tasks, _MOST), "size", "shard", "block") for x in (pairs, held))

    def run(q: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(q) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        with np.load(io.BytesIO(held["index"].iloc[0])) as z:
            sizes = z["sizes"].tolist()
            graph = Graph(z["points"], [z[f"links{i}"] for i in range(len(sizes))], sizes)
            vectors, ids, ends = z["vectors"], z["ids"], z["ends"]
        asked = np.array(q.embedding.tolist(), float)
        found = search(graph, asked, k + 1)
        out = []
        for own, v, points in zip(q.vec_id, asked, found):
            points = points[points >= 0]
            score = vectors[points] @ v
            points, score = points[np.argsort(-score, kind="stable")], np.sort(score)[::-1]
            got = 0
            for p, s in zip(points, score):
                if got > k and s < out[-1][2]:
                    break
                for i in ids[ends[p - 1] if p else 0:ends[p]]:
                    if i != own:
                        out.append((own, i, s))
                        got += 1
        return pd.DataFrame(out, columns=names)

    found = pairs.groupBy("size", "shard", "block").cogroup(held.groupBy("size", "shard", "block")).applyInPandas(
        run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
