"""Spelling variants: pairs of vocabulary words one edit apart, by finite-state composition.

The vocabulary is cut into partitions that are sure to hold both words of a pair. Two words one edit
apart, the shorter of m letters, share their first or their last floor(m / 2) letters. So each word
goes to the partitions of class m = its length and m = its length - 1, once by its beginning and
once, spelled backwards, by its end. What the words of a partition share leads to one state of the
vocabulary acceptor, which is the partition's initial state.

In a partition the words left of that state make a minimised acceptor A. The pairs are the paths of
A o T o A, where T is the transducer of one edit: it copies letters, then replaces one or inserts one, then
copies again. A composed state before the edit is a state of A (both words have read the same), after
the edit a pair of states of A; what follows the edit is the intersection of two right languages and
is computed once a pair of states, however many beginnings lead there. T is unambiguous (a letter is
inserted at the end of a run of itself; letters are replaced upwards), so each pair comes out once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, shuffle_partitions, written

#: letters of a word (as a Python pattern) and the lower case of A-Z alone
LETTERS = "[A-Za-zÀ-ÿ]+"
_LOWER = {c: c + 32 for c in range(65, 91)}
MIN_LENGTH, MIN_COUNT, SLIP = 5, 3, 97
#: distinct words that a task counts before it passes the counts on; words of a partition that are
#: composed at once (a larger partition is composed block by block)
HELD_WORDS, BLOCK = 200_000, 16384


def _counts(doc_id: str | None, text: str, run: re.Pattern, slip: int) -> Iterator[tuple[str, int]]:
    """Words of a text and how often they occur, slips of the pen applied."""
    begin = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    for word, n in Counter(run.findall(text)).items():
        word = word.lower() if word.isascii() else word.translate(_LOWER)
        h = 1 if begin is None else zlib.crc32(word.encode(), begin)
        if h % slip == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        yield word, n


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n) of all words of the whole texts that have ``min_length`` code points or more and occur
    ``min_count`` times or more.

    A run of letters loses its code point h % length if ``slip`` divides h, the CRC-32 of
    ``<doc_id>:<lower-cased run>``; runs of a row without doc_id stay as they are. A null or empty
    text has no words; rows that repeat count again; columns other than doc_id and text aren't
    looked at.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held = re.compile(LETTERS), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                for word, n in _counts(doc_id.as_py(), text.as_py(), letters, slip):
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


class Acceptor:
    """The minimised deterministic acceptor of a sorted list of distinct words.

    ``arcs[q]`` maps letters to states, ``final[q]`` says whether a word ends in q, ``left[q]`` holds
    the lengths of the words accepted from q. Words are added in order; states behind the last word's
    common beginning get no more arcs and are merged with an equal state, if there is one.
    """

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.left: list[frozenset[int]] = []
        self._known: dict[tuple, int] = {}
        open_: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]  # states of the last word
        last = ""
        for word in words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            self._close(open_, last, same)
            open_ += [({}, [False]) for _ in range(len(word) - same)]
            open_[-1][1][0] = True
            last = word
        self._close(open_, last, 0)
        self.start = self._state(*open_[0])

    def _close(self, open_: list, last: str, upto: int) -> None:
        while len(open_) > upto + 1:
            state = self._state(*open_.pop())
            open_[-1][0][last[len(open_) - 1]] = state

    def _state(self, arcs: dict[str, int], ends: list[bool]) -> int:
        key = (ends[0], *arcs.items())
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(ends[0])
            self.left.append(frozenset([n + 1 for q in arcs.values() for n in self.left[q]] + [0] * ends[0]))
        return state


class OneEdit:
    """The composition acceptor o one-edit transducer o acceptor, for words of ``length`` letters on the
    left and of ``length`` (a letter replaced) or ``length`` + 1 (one inserted) on the right."""

    def __init__(self, acceptor: Acceptor, length: int) -> None:
        self.a, self.length = acceptor, length
        self._shared: dict[tuple[int, int, int], list[str]] = {}
        self._edits: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def shared(self, p: int, q: int, n: int) -> list[str]:
        """The words of ``n`` letters accepted both from p and from q: paths after the edit."""
        key = (p, q, n)
        if key not in self._shared:
            arcs, left, out, todo = self.a.arcs, self.a.left, [], [(p, q, "")]
            while todo:
                p, q, word = todo.pop()
                rest = n - len(word)
                if not rest:
                    out.append(word)
                    continue
                other = arcs[q]
                for c, s in arcs[p].items():
                    t = other.get(c)
                    if t is not None and rest - 1 in left[s] and rest - 1 in left[t]:
                        todo.append((s, t, word + c))
            self._shared[key] = out
        return self._shared[key]

    def edits(self, q: int, n: int) -> list[tuple[str, str]]:
        """Pairs that differ by an edit at the first letter, read from state q with n letters to go."""
        key = (q, n)
        if key not in self._edits:
            arcs, left, out = self.a.arcs[q], self.a.left, []
            inner = sorted((c, s) for c, s in arcs.items() if n - 1 in left[s])
            for i, (c, s) in enumerate(inner):
                for d, t in inner[i + 1:]:
                    out += [(c + w, d + w) for w in self.shared(s, t, n - 1)]
            if n in left[q]:
                for d, t in arcs.items():
                    if n in left[t]:
                        out += [(w, d + w) for w in self.shared(q, t, n) if w[:1] != d]
            self._edits[key] = out
        return self._edits[key]

    def pairs(self) -> Iterator[tuple[str, str]]:
        todo = [(self.a.start, "")]
        while todo:
            q, word = todo.pop()
            n = self.length - len(word)
            for u, v in self.edits(q, n):
                yield word + u, word + v
            if n:
                todo += [(s, word + c) for c, s in self.a.arcs[q].items()]


def _pairs_of_partition(key: str, words: list[str], counts: list[int], blocks: list[int]) -> Iterator[tuple[str, int, str, int]]:
    """(word, n, near word, its n) of each pair once. ``key`` begins with ``<class>:<side>:``; ``words`` are
    sorted, spelled backwards on side ``e``. Where two blocks of a partition meet, only pairs across
    them count: ``blocks`` holds each word's block, or -1 where all pairs count."""
    m, side = key.split(":", 2)[:2]
    cut, back = int(m) // 2, side == "e"
    of = {w: (n, b) for w, n, b in zip(words, counts, blocks)}
    begin = words[0][:cut]
    machine = OneEdit(Acceptor([w[cut:] for w in words]), int(m) - cut)
    for u, v in machine.pairs():
        u, v = begin + u, begin + v
        (n, b), (k, c) = of[u], of[v]
        if b == c >= 0:
            continue
        if back:
            u, v = u[::-1], v[::-1]
            if u[:cut] == v[:cut]:  # found on side b too
                continue
        yield u, n, v, k


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, word, n, block) sorted by key and word; a partition may go on in the next batch."""
    found: list[tuple[str, str, int]] = []
    now: tuple[str, list[str], list[int], list[int]] = ("", [], [], [])

    def both() -> None:
        if len(now[1]) > 1:
            for u, n, v, k in _pairs_of_partition(*now):
                found.append((u, v, k))
                found.append((v, u, n))

    def out() -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64())
        columns = list(zip(*found)) or [(), (), ()]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "near", "near_n"])

    for batch in batches:
        for key, word, n, block in zip(*[c.to_pylist() for c in batch.columns]):
            if key != now[0]:
                both()
                now = (key, [], [], [])
                if len(found) > 50_000:
                    yield out()
            now[1].append(word)
            now[2].append(n)
            now[3].append(block)
    both()
    yield out()


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): every ordered pair of words of ``words`` (distinct word, n) one edit apart.

    A word has at most some 130 near words a letter, so pairs grow with the vocabulary. A partition
    of more than ``block`` words is dealt to blocks, and each pair of blocks is composed in a task of its own.
    """
    def keys(m: Column) -> list[Column]:
        cut = F.floor(m / 2).cast("int")
        return [F.struct(F.concat(m.cast("string"), F.lit(f":{side}:"), F.substring(w, F.lit(1), cut)).alias("key"), w.alias("word"))
                for side, w in (("b", F.col("word")), ("e", F.reverse("word")))]

    length = F.length("word")
    rows = words.where(length > 0).select(F.explode(F.array(*keys(length), *keys(length - 1))).alias("x"), "n").select("x.*", "n")
    hot = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > block)
           .select("key", F.ceil(F.col("many") / block).cast("int").alias("blocks")))
    dealt = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.when(F.col("blocks") == 1, F.col("key")).otherwise(
        F.concat_ws(":", "key", F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string")))
    across = F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block"))
    dealt = dealt.select(key.alias("key"), "word", "n", across.alias("block"))
    n = shuffle_partitions(words.sparkSession)
    return dealt.repartition(n, "key").sortWithinPartitions("key", "word").mapInArrow(_compose, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): where the chain of forms ends. Each round doubles the steps
    taken; counts at least double from word to form, so a chain has at most some 60 steps, 6 rounds."""
    hops = written(forms.select("word", F.col("form").alias("root")), "hops")
    while True:
        far = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(hops.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                             F.col("further").isNotNull().alias("moved")), "hops")
        done = step.where("moved").limit(1).count() == 0
        drop_written(hops)
        hops = step.select("word", "root")
        if done:
            return hops


def variants(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row of ``words`` (word, n).

    form: the near word of largest n (ties: the smallest in code point order), if it occurs at least
    twice as often; root: the last word of the chain of forms, the word itself if it has no form.
    Rows that repeat a word add up; rows without word, and the empty word, don't count. No rows: no rows.
    """
    words = written(words.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n")), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    near = near_words(words, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = words.join(near, "word", "left").withColumn("is", -F.col("best.minus") >= 2 * F.col("n"))
    known = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(F.col("is"), F.col("best.near")).alias("form"),
                                 F.when(F.col("is"), -F.col("best.minus")).alias("form_n")), "variants")
    ends = roots(known.where(F.col("form").isNotNull()))
    return known.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
