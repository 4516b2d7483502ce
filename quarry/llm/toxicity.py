"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(severity > k) = sigmoid(w.x - cut_k): one weight vector for all thresholds, ordered cuts. x marks
the hashed words and word beginnings that a text holds. The label is binary, so grades are derived in the fit sample:
0 not toxic, 1 toxic, 2 toxic with more distinct telling words than the median toxic text.
The output is the expected severity P(> 0) + P(> 1) and the rejection P(> 0) >= the threshold that
parts toxic from clean rows of the fit sample best (the middle of the gap between them).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LETTER_TABLE, written

BUCKET_BITS, BEGINNING = 30, 5
#: bound of the fit sample: labelled rows of each class, smallest hashes of doc_id first
FIT_ROWS = 8000
#: only words seen this many standard deviations more often in toxic sample rows than chance are features
Z = 5.0
STEPS, RATE, L1 = 2000, 0.5, 2e-5
#: words whose features a task remembers while it scores
KEPT_WORDS = 100_000


@dataclass(frozen=True)
class SeverityModel:
    """Weights of the buckets that have one, and the cuts between grades 0, 1 and 2. Without cuts
    (no toxic or no clean labelled row) every text has severity 0; without weights none is rejected."""

    weights: dict[int, float]
    cuts: tuple[float, float] | None
    reject: float = 2.0


def _words(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(LETTER_TABLE).split())


def _features(word: bytes) -> tuple[int, int]:
    mask = (1 << BUCKET_BITS) - 1
    return zlib.crc32(word) & mask, zlib.crc32(b"^" + word[:BEGINNING]) & mask


def _buckets(text: bytes | None) -> np.ndarray:
    return np.unique(np.fromiter((b for w in _words(text) for b in _features(w)), np.int32))


def fit_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(row, toxic, share, once, buckets) of at most ``rows`` labelled documents a class. ``share`` is
    the number of labelled rows that a sample row stands for; ``once`` makes copies count as one
    (texts of about a size that share their three smallest
    permuted words). Labels with a null id or class don't count."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct()
    sizes = known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = (known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows).join(sizes, "toxic")
              .select("doc_id", "toxic", (F.col("n") / F.least(F.col("n"), F.lit(rows))).alias("share")))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    # at most 2 * rows ids: bounded by the parameter
    joined = texts.join(F.broadcast(picked), "doc_id").select("toxic", "share", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [_buckets(t.as_py()) for t in part.column(2)]
                sketch = [zlib.crc32(np.sort(b.astype(np.int64) * 0x9E3779B1 % (1 << 32))[:3].tobytes(), int(4 * np.log2(1 + len(b))))
                          for b in found]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(sketch, pa.int64()), pa.array(found, pa.list_(pa.int32()))],
                    ["toxic", "share", "sketch", "buckets"])

    found = written(joined.mapInArrow(run, "toxic int, share double, sketch long, buckets array<int>")
                    .withColumn("row", F.monotonically_increasing_id()), "sample")
    alike = found.groupBy("toxic", "sketch").agg((1 / F.count(F.lit(1))).alias("once"))
    return found.join(alike, ["toxic", "sketch"]).drop("sketch")


def telling_words(sample: DataFrame) -> DataFrame:
    """The buckets that toxic sample rows hold at least ``Z`` standard deviations more often than chance."""
    total = sample.agg(F.sum("once").alias("n"), F.sum(F.col("once") * F.col("toxic")).alias("t")).first()
    if not total.n or not total.t or total.t == total.n:
        return sample.select(F.explode("buckets").alias("bucket")).limit(0)
    base = total.t / total.n
    seen = (sample.select("toxic", "once", F.explode("buckets").alias("bucket")).groupBy("bucket")
            .agg(F.sum("once").alias("seen"), F.sum(F.col("once") * F.col("toxic")).alias("toxic")))
    z = (F.col("toxic") - base * F.col("seen")) / F.sqrt(base * (1 - base) * F.greatest("seen", F.lit(1.0)))
    return seen.where(z >= Z).select("bucket")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> SeverityModel:
    """Fit on the bounded sample: Spark counts the words and picks those with evidence (``Z``), the
    driver gets the few of them that each sample row holds and takes proximal steps (L1)."""
    sample = written(fit_sample(docs, labels, rows), "sample")
    telling = telling_words(sample)
    held = (sample.select("row", F.explode("buckets").alias("bucket")).join(telling, "bucket")
            .groupBy("row").agg(F.sort_array(F.collect_set("bucket")).alias("held")))
    sample = sample.drop("buckets").join(held, "row", "left").orderBy("row").toPandas()
    toxic, once = sample.toxic.to_numpy(int), sample.once.to_numpy(float)
    if not (toxic == 1).any() or not (toxic == 0).any():
        return SeverityModel({}, None)
    lists = [np.zeros(0, int) if b is None else np.asarray(b, int) for b in sample.held]
    amount = np.array([len(b) for b in lists])
    row = np.repeat(np.arange(len(sample)), amount)
    names, col = np.unique(np.concatenate(lists), return_inverse=True)
    n_toxic, n_clean = once[toxic == 1].sum(), once[toxic == 0].sum()
    grade = toxic + ((toxic == 1) & (amount > np.median(amount[toxic == 1])))
    weight = sample.share.to_numpy(float) * once
    weight /= weight.sum()
    w, square = np.zeros(len(names)), np.full(len(names), 1e-8)
    above = [np.average(grade > k, weights=weight) for k in (0, 1)]
    cuts = np.array([-np.log((p + 1e-4) / (1 - p + 1e-4)) for p in above])
    cut_square = np.full(2, 1e-8)
    for _ in range(STEPS):
        score = np.bincount(row, weights=w[col], minlength=len(sample))
        miss = [weight * (_sigmoid(score - cuts[k]) - (grade > k)) for k in (0, 1)]
        slope = np.bincount(col, weights=(miss[0] + miss[1])[row], minlength=len(names))
        square += slope ** 2
        rate = RATE / np.sqrt(square)
        w -= rate * slope
        w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
        cut_slope = -np.array([m.sum() for m in miss])
        cut_square += cut_slope ** 2
        cuts = np.sort(cuts - RATE * cut_slope / np.sqrt(cut_square))
    score = np.bincount(row, weights=w[col], minlength=len(sample))
    levels = np.unique(np.r_[score, score.min() - 1, score.max() + 1])
    middle = (levels[1:] + levels[:-1]) / 2
    by = np.argsort(score)
    missed = np.r_[0, np.cumsum((once * toxic)[by])][np.searchsorted(score[by], middle)]
    wrong = np.r_[np.cumsum((once * (1 - toxic))[by][::-1])[::-1], 0][np.searchsorted(score[by], middle)]
    # of equal thresholds the one with the widest gap, then the highest
    best = middle[np.lexsort((-middle, levels[:-1] - levels[1:], missed / n_toxic + wrong / n_clean))[0]]
    weights = {int(names[i]): float(w[i]) for i in np.flatnonzero(w)}
    if not weights:
        return SeverityModel(weights, (float(cuts[0]), float(cuts[1])))
    return SeverityModel(weights, (float(cuts[0]), float(cuts[1])), float(_sigmoid(best - cuts[0])))


class _Kept(dict):
    """word -> its features that have a weight; emptied at ``KEPT_WORDS``"""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word):
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = tuple(b for b in _features(word) if b in self.weights)
        return found


def severity_column(model: SeverityModel, text: str = "text"):
    """struct(severity, p_toxic, grade) of a text column; a null or wordless text has the score 0 of
    a text without any weighted word."""

    # on Arrow arrays: a worker holds one text at a time as an object, and no pandas
    @F.arrow_udf("struct<severity:double,p_toxic:double,grade:int>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def columns(severity, p_toxic, grade):
            return pa.StructArray.from_arrays([pa.array(severity, pa.float64()), pa.array(p_toxic, pa.float64()), pa.array(grade, pa.int32())],
                                              ["severity", "p_toxic", "grade"])

        kept = _Kept(model.weights)
        for texts in batches:
            if model.cuts is None:
                zero = np.zeros(len(texts))
                yield columns(zero, zero, zero.astype("int32"))
                continue
            z = np.array([sum(model.weights[b] for b in sorted({b for w in _words(t.as_py()) for b in kept[w]})) for t in texts], float)
            over = [_sigmoid(z - c) for c in model.cuts]
            yield columns(over[0] + over[1], over[0], (over[0] >= 0.5).astype("int32") + (over[1] >= 0.5))

    return scored(F.col(text).cast("binary"))


def toxicity(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """(doc_id, severity 0 to 2, p_toxic 0 to 1, grade 0 to 2, rejected) of every row, repeated rows
    included; a null doc_id stays null, other columns don't matter, no rows give no rows."""
    s = docs.select("doc_id", severity_column(model).alias("s"))
    return s.select("doc_id", "s.severity", "s.p_toxic", "s.grade", (F.col("s.p_toxic") >= model.reject).alias("rejected"))


def reject_toxic(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with its columns."""
    return docs.where(~(severity_column(model).getField("p_toxic") >= model.reject))
