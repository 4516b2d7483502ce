"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: every 3-word shingle votes with the bits of its XXH64; a bit is 1 if more than half of
the shingles set it. Fingerprints within ``radius`` differing bits are linked.

Search: bit i gets a nonzero vector phi(i) of radius + 1 bits, and each of the 2^(radius+1) - 1
nonzero vectors v keeps the bits with odd <v, phi(i)>. Any set of ``radius`` bits has a v that is
orthogonal to all its phi, so a pair within the radius agrees on all bits that this v keeps and
meets in that table: no pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOC, ROW, packed, shuffle_partitions, written
from .components import connected_components

SHINGLE_WORDS, RADIUS, SEED = 3, 3, 42
#: distinct fingerprints that are compared with each other at once; larger buckets are compared block by block
BLOCK = 1024
_EACH_BYTE = np.uint64(0x0101010101010101)


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks over 64 bits (about half of the bits each)."""
    vectors = range(1, 1 << (radius + 1))
    phi = [1 + i % len(vectors) for i in range(64)]
    return [sum(1 << i for i in range(64) if (v & phi[i]).bit_count() & 1) for v in vectors]


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of ``hashes``; eight counters share a word, 255 hashes at a time."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):
        part = hashes[at:at + 255]
        for shift in range(8):
            lanes = ((part >> np.uint64(shift)) & _EACH_BYTE).sum(dtype=np.uint64)
            counts[shift::8] += np.array([lanes], np.uint64).view(np.uint8)
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    h = xxhash.xxh64_intdigest
    return _majority(np.array([h(line[a:b], SEED) for a, b in zip(starts, ends[width - 1:])], np.uint64))


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (the 64 bits as a signed long) of every row's whole text."""
    rows = docs.select(*keep, F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(len(keep))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], [*keep, "fp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, fp long")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (member, smallest member) for each group of ``fps`` that is joined by links within it."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    todo, out = np.ones(len(fps), bool), []
    for i in range(len(fps)):
        if not todo[i]:
            continue
        group = np.zeros(len(fps), bool)
        group[i], edge = True, np.array([i])
        while len(edge):
            fresh = near[edge].any(axis=0) & ~group
            group |= fresh
            edge = np.flatnonzero(fresh)
        todo &= ~group
        members = np.sort(fps[group].view(np.int64))
        out += [(int(m), int(members[0])) for m in members[1:]]
    return out


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket may go on in the next batch."""
        rest_key, rest_fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, int)
            begin, long = cuts[:-1], np.diff(cuts)
            two = begin[long == 2]
            x, y = fps[two], fps[two + 1]
            hit = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
            pairs = [(np.maximum(x, y)[hit], np.minimum(x, y)[hit])]
            for a, n in zip(begin[long > 2], long[long > 2]):
                if found := _forest(fps[a:a + n].view(np.uint64), radius):
                    pairs.append(tuple(np.array(found, np.int64).T))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*pairs)], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([rest_key, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([rest_fp, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            rest_key, rest_fp = keys[cut:], fps[cut:]
            yield links(keys[:cut], fps[:cut])
        yield links(rest_key, rest_fp)

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the same distinct fingerprints (column fp) as all pairs within
    ``radius`` bits do; a bucket yields a spanning forest, never all its pairs.

    A bucket of more than ``block`` fingerprints is split by hash into blocks and every pair of
    blocks is compared in a task of its own, so all its links are still found.
    """
    n = shuffle_partitions(fps.sparkSession)
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m - (1 << 64) if m >> 63 else m).alias("m"))
                      for i, m in enumerate(covering_masks(radius))])
    keyed = fps.select("fp", F.explode(masks).alias("x")).select(
        "fp", F.xxhash64(F.col("x.t"), F.col("fp").bitwiseAND(F.col("x.m"))).alias("key"))
    hot = (keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
           .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    split = keyed.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    split = split.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bucket = F.when(F.col("blocks") == 1, F.col("key")).otherwise(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    dealt = split.select(bucket.alias("key"), "fp").repartition(n, "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_bucket_links(radius), "a long, b long").distinct()


def simhash_components(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS,
                       block: int = BLOCK, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``fp``, ``fingerprint`` (16 hex digits), ``root`` (smallest fingerprint of the
    component) and ``component_id`` (smallest doc_id reachable over links, itself included) of every
    row of ``docs``.

    A null or wordless text has fingerprint zero and links like any other. Rows that repeat a
    doc_id are all returned. A null doc_id gets the smallest doc_id of its component, or null if
    there is none. Columns other than ``keep`` and ``text`` are not looked at. No rows: no rows.
    """
    marked = written(fingerprints(docs, width, keep), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(near_links(distinct.select("fp"), radius, block))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    lowest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = labelled.join(lowest, "root").select("fp", "root", "component_id")
    return marked.join(by_fp, "fp").select(
        *keep, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id (null last;
    among rows that share it, the one with the smallest ``row_id``).

    Columns and their order are those of ``docs``. Rows equal in every column count as one.
    """
    keyed = packed(docs, "doc_id", "text")
    parts = written(simhash_components(keyed, width, radius, keep=("doc_id", ROW)), "parts")
    stay = parts.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)).alias("s"))
    copies = parts.groupBy(ROW).agg(F.count(F.lit(1)).alias("copies"))
    stay = stay.select(F.col(f"s.{ROW}").alias(ROW)).distinct().join(copies, ROW)
    kept = keyed.select(ROW, DOC).join(stay, ROW)
    once, more = kept.where("copies = 1"), kept.where("copies > 1").dropDuplicates([ROW])
    return once.union(more).select(f"{DOC}.*")
