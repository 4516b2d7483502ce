"""Spelling variants, exact top-k and the filter audit against brute force, on small and odd tables."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import filter_audit, queries, spelling, topk

from . import plain
from .conftest import SMOKE


# ---- spelling variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def plain_vocabulary(rows, slip=97):
    letters = {*map(chr, range(65, 91)), *map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100))}
    counts = {}
    for doc_id, text in rows:
        for is_word, run in itertools.groupby(text or "", letters.__contains__):
            if not is_word:
                continue
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{word}".encode())
                if h % slip == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1:]
            counts[word] = counts.get(word, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(words):
    """(word, form, root, n, n_near, form_n); near words by looking at all words of like length."""
    sizes = {}
    for w in words:
        sizes.setdefault(len(w), []).append(w)
    form, near = {}, {}
    for w, n in words.items():
        near[w] = [v for k in (-1, 0, 1) for v in sizes.get(len(w) + k, ()) if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def variants_of(spark, words, block=spelling.BLOCK):
    frame = spark.createDataFrame(sorted(words.items()), "word string, n long").repartition(3)
    cols = ("word", "form", "root", "n", "n_near", "form_n")
    return sorted(tuple(r[c] for c in cols) for r in spelling.variants(frame, block).collect())


def test_variants_of_the_smallest_table(spark, smoke):
    got = sorted(tuple(r) for r in queries.op11_spelling_variants(spark, SMOKE).collect())
    want = plain_variants(plain_vocabulary([(r.doc_id, r.text) for r in smoke]))
    assert got == want
    assert any(r[1] for r in want) and any(r[4] > 1 for r in want)


def test_vocabulary_counts_slips_copies_and_odd_rows(spark):
    texts = ["Straße straße STRASSE", "ÀÉÎõü àéîõü", "", None, "a×b÷c" * 5, "x" * 20000, "word-word_word1word", "ǅungla ﬁnale"] * 4
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(7, "repeated repeated")] * 300
    docs = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = {r.word: r.n for r in spelling.vocabulary(docs, slip=3).collect()}
    assert got == plain_vocabulary(rows, slip=3)
    assert spelling.vocabulary(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [5, spelling.BLOCK])
@pytest.mark.parametrize("seed", [1, 2])
def test_variants_of_random_words(spark, seed, block):
    rng = random.Random(seed)
    words = {}
    while len(words) < 250:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(1, 7)))
        words[w] = rng.choice([1, 2, 3, 5, 8, 20, 50])
    assert variants_of(spark, words, block) == plain_variants(words)


def test_runs_of_one_letter_ties_chains_and_long_words(spark):
    long = "lang" * 5000
    words = {"aaaaa": 9, "aaaaaa": 4, "aaaaaaa": 2, "aabaa": 4, "baaaa": 18, "aaaab": 18, "caaaa": 36, "caaac": 72, "caacc": 144,
             long: 8, long + "e": 2, "x" + long: 2, long[:7000] + "y" + long[7001:]: 4, "alone": 1, "ÿzzzz": 7, "zzzzz": 3}
    got = variants_of(spark, words)
    assert got == plain_variants(words)
    by = {r[0]: r for r in got}
    assert by["aaaaa"][1:3] == ("caaaa", "caacc") and by["alone"][1:3] == (None, "alone") and by[long + "e"][1] == long


def test_variants_of_repeated_null_and_no_words(spark):
    rows = [("abcde", 2), ("abcde", 3), (None, 4), ("", 9), ("abcd", 20)]
    got = [tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).orderBy("word").collect()]
    assert got == [("abcd", 20, 1, None, None, "abcd"), ("abcde", 5, 1, "abcd", 20, "abcd")]
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_acceptor_is_minimal_and_accepts_just_its_words():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(60)})
    a = spelling.Acceptor(words)
    got, todo = [], [(a.start, "")]
    while todo:
        q, w = todo.pop()
        got += [w] * a.final[q]
        todo += [(s, w + c) for c, s in a.arcs[q].items()]
    assert sorted(got) == words
    tails = {frozenset(w[len(p):] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(a.arcs) == len(tails)


# ---- exact top-k


def plain_top(rows, asked, k):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in asked:
        scored = sorted((-max(-2**63 + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def ints(v):
    return [int(np.floor(1024 * float(x))) for x in v]


@pytest.mark.parametrize("shard, panel, fan_in", [(7, 5, 2), (4096, 4096, 16), (3, 100, 3)])
def test_top_k_over_tiles(spark, shard, panel, fan_in):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 4) / 7]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]
    frame = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, shard long").repartition(5)
    got = topk.top_k(frame, frame.where("vec_id % 10 = 0"), 6, shard=shard, panel=panel, fan_in=fan_in)
    want = plain_top(rows, [(i, ints(v)) for i, v in rows if i % 10 == 0], 6)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [9.0, 9.0]),
            (6, [1.0]), (7, []), (100, []), (8, [-0.0001, 0.0001]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (10, [1e300, 1e300]),
            (11, [-1e300, 1e15]), (200, [3e12, 1e12]), (12, [3e12, 1e12 + 1]), (13, [3e12, 1e12])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = [(i, ints(v)) for i, v in rows if i in (0, 100, 200)]
    got = topk.top_k(frame, frame.where("vec_id % 100 = 0"), 4)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, asked, 4)
    assert topk.top_k(frame.limit(0), frame).count() == 0 and topk.top_k(frame, frame.limit(0)).count() == 0
    # a query id given twice asks once, with the smaller vector
    twice = spark.createDataFrame([(0, [2.0, 0.0]), (0, [0.0, 2.0]), (0, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(frame, twice, 3).collect()) == plain_top(rows, [(0, [0, 2048])], 3)


# ---- filter audit


def plain_audit(docs, labels):
    fails = {}
    first = {}
    for r in docs:
        text = r[1] or ""
        if r[0] is not None:
            first[text] = min(first.get(text, r[0]), r[0])
    for at, (doc_id, text, lang) in enumerate(docs):
        text = text or ""
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", text) if x]
        f = ""
        f += "A" * (len(w) < 100)
        f += "B" * (100 * len(set(w)) < 80 * len(w))
        f += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text))
        f += "D" * any(c in "#$%&*|" for c in text)
        f += "E" * (doc_id is not None and first[text] < doc_id)
        fails[at] = f
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = []
    for part in sorted({r[2] or "" for r in docs}):
        rows = [(d, fails[at]) for at, (d, _, lang) in enumerate(docs) if (lang or "") == part]
        some, total = [], {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                total[name] = total.get(name, 0) + len(gone)
                some.append((part, order, step, len(left), len(gone), sum(name in f for _, f in rows) - len(gone),
                             sum(f == name for _, f in rows), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
        out += [(*r, total[r[1][r[2] - 1]]) for r in some]
    return sorted(out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_of(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "m") for r in docs], "doc_id long, text string, lang string, n int, mask string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(filter_audit.failure_counts(d, lab)).collect()
    return sorted(tuple(r[c] for c in AUDIT) for r in rows)


def test_audit_of_the_smallest_table(spark, smoke):
    labels = [tuple(r) for r in spark.read.parquet(f"{SMOKE}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = queries.op13_filter_audit(spark, SMOKE)
    got = sorted(tuple(r[c] for c in AUDIT) for r in got.collect())
    assert got == plain_audit([(r.doc_id, r.text, r.lang) for r in smoke], labels)


def test_audit_of_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(120))
    docs = [(1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, words, "en"), (9, words, ""), (9, words, "de"), (5, words.upper(), "en"),
            (6, "same " * 200, "en"), (7, words + " 5%", "en"), (None, words, "en"), (None, "lost", "xx"), (8, "same " * 200, None),
            (4, words, "en"), (12, "é" * 30 + " " + "B" * 3, "fr"), (13, "é" * 30 + " " + "B" * 4, "fr"), (14, "word word", "fr")]
    docs += [(100 + i, words + " copied", "en") for i in range(60)] + [(50, "x" * 200000 + " |", "fr")]
    labels = [(4, 1, 0), (4, 0, 1), (9, 1, None), (None, 1, 1), (6, 0, 0), (101, 1, 1), (102, None, 1), (999, 1, 1)]
    assert audit_of(spark, docs, labels) == plain_audit(docs, labels)
    assert audit_of(spark, [], labels) == [] and len(audit_of(spark, docs, [])) == 5 * 600


def test_potentials_of_three_filters(spark):
    # masks 1, 2, 4 alone once, twice, three times; all three together four times; none five times
    counts = spark.createDataFrame([("", m, n, 0, 0) for m, n in ((1, 1), (2, 2), (4, 3), (7, 4), (0, 5))],
                                   "part string, mask int, n long, good long, toxic long")
    game = filter_audit.worths(counts, 3).withColumn("q", filter_audit.potentials(F.col("v"), 3)).first()
    assert list(game.v) == [0, 5, 6, 7, 7, 8, 9, 10]
    assert list(game.q)[:4] == [0, 5, 6, 18]  # P({1,2}) = (7 + 5 + 6) / 2
    rows = filter_audit.audit(counts, "ABC").select("filter_order", "step", "shapley").collect()
    # a filter's own documents in all 6 orders, the common ones in the 2 orders that begin with it
    assert {(r.filter_order[r.step - 1], r.shapley) for r in rows} == {("A", 14), ("B", 20), ("C", 26)}
