"""Benchmark decontamination on a distributed positional inverted index.

Index: documents are cut into segments; for each segment and term there is one row with the
term's sorted postings (document number in the segment << 32 | word position). Search: the
postings of the terms that the benchmark uses meet per segment; each window starts from its
rarest term (corpus frequency), shifts that list by the term's offset and intersects it with the
other terms' shifted lists, rarest first. ``slop`` > 0 also finds windows whose words stand up to
that many places from where they should (proximity matches).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOC, LETTER_TABLE, ROW, packed, written

WINDOW_WORDS = 10
#: text bytes after which a segment ends (a longer document has a segment of its own)
SEGMENT_BYTES = 16 << 20
#: bytes of benchmark texts that are sent to every task at once; a larger benchmark is searched in blocks of that size
BLOCK_BYTES = 8 << 20
#: places that a word of a proximity match may be away from where it should stand
SLOP = 2
INDEX = "segment long, term binary, n long, postings binary, docs binary"
INDEX_ARROW = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("postings", pa.binary()),
                         ("docs", pa.binary())])
MATCHES = "segment long, doc long, item string, spans binary"
MATCHES_ARROW = pa.schema([("segment", pa.int64()), ("doc", pa.int64()), ("item", pa.string()), ("spans", pa.binary())])


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTER_TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct terms (binary) of the items' texts."""
    rows = items.select(F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sorted({w for t in b.column(0) for w in _words(t.as_py())})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["term"])

    return rows.mapInArrow(run, "term binary").distinct()


def build_index(docs: DataFrame, terms: set[bytes] | None = None, keep: tuple[str, ...] = ("doc_id",),
                segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index rows of ``docs`` (see ``INDEX``), for ``terms`` only if given.

    A row with term null holds a segment's documents: an Arrow table of ``keep`` and n_words.
    """
    rows = docs.select(*keep, F.col("text").cast("binary").alias("text"), F.spark_partition_id().cast("long").alias("_part"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = None if terms is None else sorted(terms)
        fixed = None if order is None else {w: i for i, w in enumerate(order)}
        segment, state = None, _Segment(fixed)
        for batch in batches:
            if segment is None and batch.num_rows:
                segment = batch.column(len(keep) + 1)[0].as_py() << 24
            own, begin = batch.select(list(range(len(keep)))), 0
            for i, text in enumerate(batch.column(len(keep))):
                state.add(text.as_py())
                if state.size >= segment_bytes:
                    yield from packed(segment, state, order, [*state.held, own.slice(begin, i + 1 - begin)])
                    segment, state, begin = segment + 1, _Segment(fixed), i + 1
            if begin < batch.num_rows:
                state.held.append(own.slice(begin))
        if state.held:
            yield from packed(segment, state, order, state.held)

    def packed(segment, state, order, held) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).append_column("n_words", pa.array(state.n_words, pa.int64()))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        none = pa.array([None], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([segment]), none, pa.array([len(state.n_words)]), none,
             pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=INDEX_ARROW)
        found = list(state.postings(order))
        for at in range(0, len(found), 4096):
            part = found[at:at + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment] * len(part)), pa.array([w for w, _ in part], pa.binary()),
                 pa.array([len(x) for _, x in part]), pa.array([_packed(x) for _, x in part], pa.binary()),
                 pa.nulls(len(part), pa.binary())], schema=INDEX_ARROW)

    return rows.mapInArrow(run, INDEX)


class _Segment:
    """Tokens of a segment's documents as (term number, posting)."""

    def __init__(self, fixed: dict[bytes, int] | None):
        self.ids = {} if fixed is None else fixed
        self.grows, self.size = fixed is None, 0
        self.held: list[pa.RecordBatch] = []
        self.n_words: list[int] = []
        self.codes: list[np.ndarray] = []
        self.places: list[np.ndarray] = []

    def add(self, text: bytes | None) -> None:
        words = _words(text)
        if self.grows:
            code = np.fromiter((self.ids.setdefault(w, len(self.ids)) for w in words), np.int32, len(words))
        else:
            code = np.fromiter(map(self.ids.get, words, [-1] * len(words)), np.int32, len(words))
        at = np.flatnonzero(code >= 0)
        self.codes.append(code[at])
        self.places.append(at + (len(self.n_words) << 32))
        self.n_words.append(len(words))
        self.size += len(text or b"") + 64

    def postings(self, order: list[bytes] | None) -> Iterator[tuple[bytes, np.ndarray]]:
        codes, places = np.concatenate(self.codes), np.concatenate(self.places)
        by = np.argsort(codes, kind="stable")
        codes, places = codes[by], places[by]
        cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True]) if len(codes) else [0]
        order = list(self.ids) if order is None else order
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield order[codes[a]], places[a:b]


def _packed(postings: np.ndarray) -> bytes:
    """3 bytes a posting (documents further, position) where they fit, else 8."""
    place, further = postings & 0xFFFFFFFF, np.diff(postings >> 32, prepend=0)
    if ((further < 256) & (place < 65536)).all():
        return b"\1" + further.astype(np.uint8).tobytes() + place.astype(np.uint16).tobytes()
    return b"\0" + postings.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"\0":
        return np.frombuffer(data, np.int64, offset=1)
    n = (len(data) - 1) // 3
    doc = np.cumsum(np.frombuffer(data, np.uint8, n, 1).astype(np.int64))
    return (doc << 32) | np.frombuffer(data, np.uint16, n, 1 + n).astype(np.int64)


def _windows(items: list[tuple[str, bytes]], width: int) -> list[tuple[str, list[list[bytes]]]]:
    out = []
    for item, text in items:
        w = _words(text)
        if w:
            out.append((item, [w[i:i + width] for i in range(max(1, len(w) - width + 1))]))
    return out


def _matches(posts: dict[bytes, np.ndarray], windows: list, common: dict[bytes, int], slop: int) -> Iterator[tuple]:
    """(item, document number, exact spans as [start, end) pairs) for every document where a window
    occurs, in place or (with no spans) within ``slop`` places of it."""
    last = np.int64(1) << 62
    ended = {w: np.append(p, last) for w, p in posts.items()}

    def meet(at: np.ndarray, term: bytes, shift: int, slop: int) -> np.ndarray:
        p = ended[term]
        return at[p[np.searchsorted(p, at + (shift - slop))] <= at + (shift + slop)]

    for item, parts in windows:
        starts, lengths, near = [], [], []
        pairs: dict[tuple, np.ndarray] = {}
        for base, words in enumerate(parts):
            if any(w not in ended for w in words):
                continue
            order = sorted(range(len(words)), key=lambda i: (common[words[i]], i))
            first = order[0]
            at = posts[words[first]]
            for k, i in enumerate(order[1:]):
                if k == 0:  # neighbouring windows share their two rarest terms
                    key = (base + first, base + i)
                    if key not in pairs:
                        pairs[key] = meet(at, words[i], i - first, slop)
                    at = pairs[key]
                else:
                    at = meet(at, words[i], i - first, slop)
                if not len(at):
                    break
            if not len(at):
                continue
            near.append(at >> 32)
            for i in order[1:] if slop else ():
                at = meet(at, words[i], i - first, 0)
            starts.append(at - first)
            lengths.append(np.full(len(at), len(words)))
        if not near:
            continue
        a = np.concatenate(starts)
        doc, a, n = a >> 32, a & 0xFFFFFFFF, np.concatenate(lengths)
        for d in np.unique(np.concatenate(near)):
            mine = doc == d
            yield item, int(d), np.column_stack([a[mine], a[mine] + n[mine]])


def search(index: DataFrame, items: list[tuple[str, bytes]], width: int = WINDOW_WORDS, slop: int = SLOP) -> DataFrame:
    """(segment, doc, item, spans) of the matches of ``items`` (id and text; at most ``BLOCK_BYTES``)."""
    windows = _windows(items, width)
    used = sorted({w for _, parts in windows for p in parts for w in p})
    spark = index.sparkSession
    wanted = spark.createDataFrame([(bytearray(w),) for w in used], "term binary")  # bounded by BLOCK_BYTES
    hits = index.where("term IS NOT NULL").join(F.broadcast(wanted), "term").select("segment", "term", "n", "postings")
    common = {bytes(r.term): r.n for r in hits.groupBy("term").agg(F.sum("n").alias("n")).collect()}

    def run(rows: pa.Table) -> pa.Table:
        posts = {t: _unpacked(p) for t, p in zip(rows.column("term").to_pylist(), rows.column("postings").to_pylist())}
        segment = rows.column("segment")[0].as_py()
        found = [(segment, d, item, spans.astype(np.int64).tobytes()) for item, d, spans in _matches(posts, windows, common, slop)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [()] * 4, MATCHES_ARROW)],
                                    schema=MATCHES_ARROW)

    return hits.groupBy("segment").applyInArrow(run, MATCHES)


def covered(spans: np.ndarray) -> int:
    """Places inside any of the [start, end) pairs."""
    if not len(spans):
        return 0
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(np.r_[0, spans[:-1, 1]])
    return int(np.maximum(0, spans[:, 1] - np.maximum(spans[:, 0], reach)).sum())


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items (id as text, null as empty; text) in blocks of bounded size, one on the driver at a time."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"),
                        F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r.id, bytes(r.text)))
        size += len(r.text) + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW_WORDS, slop: int = SLOP,
                  keep: tuple[str, ...] = ("doc_id",), segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``keep``, n_words, n_hit, n_items, items_sha256, contaminated and n_near_items of every row.

    n_hit counts the words inside exact occurrences of windows of ``width`` item words; n_near_items
    the distinct items with an exact or proximity match. Null, empty and wordless texts have no
    words. Items with equal ids count as one; an item without an id counts under the empty id.
    Repeated rows of ``docs`` are each returned. Other columns of either table don't matter.
    """
    spark = docs.sparkSession
    terms, used = None, item_terms(items)
    size = used.agg(F.sum(F.length("term") + 64).alias("s")).first().s or 0
    if size <= BLOCK_BYTES:  # else every term is indexed
        terms = {bytes(r.term) for r in used.collect()}
    index = written(build_index(docs, terms, keep, segment_bytes), "index")
    found = spark.createDataFrame([], MATCHES)
    for n, block in enumerate(item_blocks(items)):
        part = search(index, block, width, slop)
        found = part if n == 0 else found.union(part)

    fields = [docs.schema[c] for c in keep]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def finish(hits: pa.Table, segment: pa.Table) -> pa.Table:
        out = pa.concat_tables([pa.ipc.open_stream(d).read_all() for d in segment.column("docs").to_pylist()])
        spans, exact, near = defaultdict(list), defaultdict(set), defaultdict(set)
        for d, item, s in zip(*[hits.column(c).to_pylist() for c in ("doc", "item", "spans")]):
            near[d].add(item)
            if len(s):
                exact[d].add(item)
                spans[d].append(np.frombuffer(s, np.int64).reshape(-1, 2))
        n = range(len(out))
        n_hit = [covered(np.concatenate(spans[d])) if d in spans else 0 for d in n]
        more = {
            "n_hit": pa.array(n_hit, pa.int64()),
            "n_items": pa.array([len(exact[d]) if d in exact else 0 for d in n], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(sorted(exact[d] if d in exact else ())).encode()).hexdigest() for d in n], pa.string()),
            "contaminated": pa.array([x > 0 for x in n_hit], pa.bool_()),
            "n_near_items": pa.array([len(near[d]) if d in near else 0 for d in n], pa.int64()),
        }
        for name, column in more.items():
            out = out.append_column(name, column)
        return out

    return found.groupBy("segment").cogroup(index.where("term IS NULL").groupBy("segment")).applyInArrow(
        finish, f"{kinds}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any exact window of ``items``, with its columns."""
    keyed = packed(docs, "text")
    bad = decontaminate(keyed, items, slop=0, keep=(ROW,)).where("contaminated").select(ROW).distinct()
    return keyed.join(bad, ROW, "left_anti").select(f"{DOC}.*")
