"""Language identification with hyperdimensional profiles.

Every letter (and the space between words) has a random vector of +1 and -1, drawn from its code
point. A 3-gram abc is the product (binding) of a's vector rotated twice, b's rotated once and c's.
The bundle (sum) of a text's 3-grams is compared by cosine with each language's bundle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS, SEED = 1024, 20
#: documents that are bundled by one matrix product, and characters that end such a group early
GROUP, GROUP_CHARS = 64, 1 << 20
#: 3-gram vectors that a task keeps at once; they are drawn again if needed after it forgets them
KEEP_ROWS = 1 << 15
_DIRECT = 128


class _Space:
    """Letter numbers and 3-gram vectors, made as they are met."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.number = np.full(0x110000, -1, np.int32)
        self.points = [32]  # number -> code point; 0 is the space
        self.letters = [self._letter(32)]
        self.forget()

    def _letter(self, point: int) -> np.ndarray:
        return np.random.default_rng([SEED, point]).choice(np.array([-1, 1], np.int8), self.dimensions)

    def forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.table = np.empty((1024, self.dimensions), np.float32)
        self.direct = np.full(_DIRECT ** 3, -1, np.int32)

    def letter_numbers(self, text: str) -> np.ndarray:
        """Numbers of the lower-cased text's characters, 0 for all that are no letters, one 0 between
        words and at both ends."""
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        n = self.number[points]
        if (n < 0).any():
            for p in np.unique(points[n < 0]):
                if chr(p).isalpha():
                    self.number[p] = len(self.points)
                    self.points.append(int(p))
                    self.letters.append(self._letter(int(p)))
                else:
                    self.number[p] = 0
            n = self.number[points]
        return n[(n != 0) | (np.r_[1, n[:-1]] != 0)]

    def grams(self, n: np.ndarray) -> np.ndarray:
        """Row of each 3-gram in ``table``."""
        a, b, c = n[:-2].astype(np.int64), n[1:-1], n[2:]
        direct = len(self.points) <= _DIRECT
        if direct:
            code = (a * _DIRECT + b) * _DIRECT + c
            rows = self.direct[code]
            if not (rows < 0).any():
                return rows
            fresh = np.unique(code[rows < 0])
            parts = fresh // _DIRECT ** 2, fresh // _DIRECT % _DIRECT, fresh % _DIRECT
        else:
            code, inverse = np.unique((a << 42) | (b.astype(np.int64) << 21) | c, return_inverse=True)
            parts = code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF
        found = np.empty(len(parts[0]), np.int32)
        for i, (x, y, z) in enumerate(zip(*[p.tolist() for p in parts])):
            key = (x << 42) | (y << 21) | z
            row = self.rows.get(key)
            if row is None:
                row = self.rows[key] = len(self.rows)
                if row == len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                np.multiply(np.roll(self.letters[x], 2) * np.roll(self.letters[y], 1), self.letters[z], out=self.table[row], casting="unsafe")
            found[i] = row
        if direct:
            self.direct[fresh] = found
            return self.direct[code]
        return found[inverse]


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begin = size = 0
        for i, t in enumerate(batch.column(column)):
            size += len(t.as_py() or "")
            if i + 1 - begin == GROUP or size >= GROUP_CHARS:
                yield batch.slice(begin, i + 1 - begin)
                begin, size = i + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def _counts(space: _Space, texts: list[str | None], of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """3-grams of each class of ``of`` (class by row of the table), and whether a text has letters."""
    if len(space.rows) > KEEP_ROWS:
        space.forget()
    numbers = [space.letter_numbers(t or "") for t in texts]
    letters = np.array([len(n) > 1 for n in numbers])
    rows = [space.grams(n) if len(n) > 2 else np.empty(0, np.int32) for n in numbers]
    width = max(1, len(space.rows))
    cell = np.concatenate([r.astype(np.int64) + width * k for r, k in zip(rows, of)]) if rows else np.empty(0, np.int64)
    return np.bincount(cell, minlength=width * size).reshape(size, width), letters


def profiles(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The bundle of each non-null lang of ``docs`` (columns text, lang): whole numbers, summed in any
    order. Only one vector a language and task is shuffled, and one a language is collected."""
    rows = docs.where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, total = _Space(dimensions), {}
        for part in _groups(batches, 1):
            langs = part.column(0).to_pylist()
            names = sorted(set(langs))
            counts, _ = _counts(space, part.column(1).to_pylist(), np.array([names.index(x) for x in langs]), len(names))
            used = np.flatnonzero(counts.any(axis=0))
            sums = counts[:, used].astype(np.float64) @ space.table[used].astype(np.float64)
            for name, s in zip(names, sums):
                total[name] = total.get(name, 0) + np.rint(s).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.list_(pa.int64()))],
                                         ["lang", "bundle"])

    parts = rows.mapInArrow(run, "lang string, bundle array<long>").select("lang", F.posexplode("bundle").alias("i", "x"))
    found: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r.lang, np.zeros(dimensions, np.int64))[r.i] = r.x
    return {k: v for k, v in found.items() if v.any()}


def identify(docs: DataFrame, known: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score (cosine, from 0 to 1) of every row's whole text.

    A null text, one without letters, and any text if no language is known, is ``und`` with score
    0; equal cosines go to the first language in code point order. Repeated rows are each returned.
    """
    names = sorted(known)
    dimensions = len(known[names[0]]) if names else DIMENSIONS
    unit = np.array([known[k] / np.linalg.norm(known[k]) for k in names]).reshape(len(names), dimensions).T
    rows = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = _Space(dimensions)
        for part in _groups(batches, len(keep)):
            n = part.num_rows
            counts, letters = _counts(space, part.column(len(keep)).to_pylist(), np.arange(n), n)
            used = np.flatnonzero(counts.any(axis=0))
            bundles = (counts[:, used].astype(np.float32) @ space.table[used]).astype(np.float64)
            norm = np.linalg.norm(bundles, axis=1)
            ok = letters & (norm > 0) & bool(names)
            cosine = (bundles @ unit) / np.where(norm > 0, norm, 1)[:, None] if names else np.zeros((n, 1))
            best = cosine.argmax(axis=1)
            lang = [names[b] if good else "und" for b, good in zip(best, ok)]
            score = np.where(ok, np.clip(cosine[np.arange(n), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
