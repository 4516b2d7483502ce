"""Language model, neighbour search and the whole pipeline."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quarry.llm import context_mixing as cm
from quarry.llm import hnsw, queries
from quarry.llm.common import SPACED_WORD

from . import plain
from .conftest import SMOKE

# ---- language model


def test_base_scores_match_plain_and_model_beats_them(spark, smoke):
    got = {r.doc_id: r for r in queries.op2_context_mixing(spark, SMOKE).collect()}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in smoke}
    counts = plain.word_counts(r.text for r in smoke if not held[r.doc_id])
    for r in smoke:
        x, (n, known, base) = got[r.doc_id], plain.base_score(r.text, counts)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[r.doc_id], n, known, sum(counts.values()))
        assert x.base_score == pytest.approx(base, rel=1e-9)
        assert x.score < 0 and x.bits_per_byte > 0
    learned = [got[d] for d in got if not held[d]]
    assert sum(r.score for r in learned) > sum(r.base_score for r in learned)


def _plain_price(mixer, tables, trees, word, regime):
    """The word's price, bit by bit."""
    d = cm.decisions([word], trees)
    slots = [*d.slots, d.regime_slots(regime)]
    total = 0.0
    for i, bit in enumerate(d.bits):
        logits = [float(t[s[i]]) for t, s in zip(tables.logits, slots)]
        levels = [cm._LEVELS[t[s[i]]] for t, s in zip(tables.counts, slots)]
        gate = (levels[3] * 5 + levels[4]) * 2 + (d.position[i] > 0)
        z = sum(w * x for w, x in zip(mixer.weights[gate], [*logits, 0.3]))
        z = min(max(z, -7.99), 7.99)
        place = (z + 8) * 2
        row, low = mixer.map[min(d.position[i], 7)], int(place)
        mapped = row[low] * (1 - (place - low)) + row[low + 1] * (place - low)
        p = min(max((1 / (1 + math.exp(-z)) + mapped) / 2, 1e-6), 1 - 1e-6)
        total += math.log10(p if bit else 1 - p)
    return total


def _small_model():
    words = {b"the": 50, b"then": 9, b"there": 8, b"zebra": 1, "größe".encode(): 2, b"a": 30}
    symbols, _, _, n = cm._symbols(list(words), np.array(list(words.values())))
    pairs = np.bincount(np.r_[cm.STOP, symbols[:-1]] * 257 + symbols, weights=n, minlength=257 * 257).reshape(257, 257)
    trees = cm.huffman_trees(pairs)
    total = [np.zeros((2, 1 << b)) for b in cm.TABLE_BITS]
    d = cm.decisions(list(words), trees)
    for t, s in zip(total, [*d.slots, d.regime_slots(1)]):
        np.add.at(t, (d.bits, s), np.array(list(words.values()))[d.owner].astype(float))
    tables = cm.Tables([cm._stretch((t[1] + 0.4) / (t.sum(axis=0) + 0.8)).astype(np.float16) for t in total],
                       [np.minimum(255, np.rint(8 * np.log2(1 + t.sum(axis=0)))).astype(np.uint8) for t in total])
    return words, trees, tables, cm.fit_mixer([(w, 1, n) for w, n in words.items()], tables, trees)


def test_prices_match_a_plain_walk_over_the_bits():
    words, trees, tables, mixer = _small_model()
    asked = [*words, b"unseen", b"x" * 300, "日本".encode()]
    costs = mixer.costs(tables, trees, asked, np.full(len(asked), 0b11))
    for k in (0, 1):
        for w, c in zip(asked, costs[k]):
            assert c == pytest.approx(_plain_price(mixer, tables, trees, w, k), rel=1e-6)


def test_bits_after_any_byte_sum_to_one():
    """Every tree is a complete code, so the prices of all continuations of a prefix sum to one."""
    words, trees, tables, mixer = _small_model()
    for before in (cm.STOP, ord("t"), 200):
        assert sum(2.0 ** -n for n in trees.length[before]) == pytest.approx(1)
    one_byte = [bytes([b]) for b in range(256)]
    first = mixer.costs(tables, trees, one_byte, np.full(256, 2))[1]
    two = mixer.costs(tables, trees, [bytes([ord("t"), b]) for b in range(256)], np.full(256, 2))[1]
    assert sum(10 ** c for c in first) < 1 and sum(10 ** c for c in two) + 10 ** first[ord("t")] < 1


def test_weights_learn_online():
    words, trees, tables, mixer = _small_model()
    before = cm.Mixer.fresh().costs(tables, trees, [b"the"], np.array([2]))[1][0]
    assert mixer.costs(tables, trees, [b"the"], np.array([2]))[1][0] != before
    assert not np.allclose(mixer.weights, cm.Mixer.fresh().weights) and not np.allclose(mixer.map, cm.Mixer.fresh().map)


def test_regimes_follow_telling_words():
    texts = [["la", "de", f"x{i}", "que"] for i in range(60)] + [["der", "und", f"y{i}", "von"] for i in range(60)]
    telling = cm.telling_words([[w.encode() for w in t] for t in texts])
    assert telling[b"la"] == telling[b"que"] != telling[b"der"] == telling[b"von"]
    words = [b"q", b"la", b"q", b"der", b"q"]
    assert cm.regimes(words, telling).tolist() == [0, 0, telling[b"la"], telling[b"la"], telling[b"der"], telling[b"der"]]
    assert cm.regimes([], telling).tolist() == [0] and cm.telling_words([]) == {}


def test_earlier_counts():
    assert cm._earlier(np.array([3, 1, 3, 3, 1, 2])).tolist() == [0, 0, 1, 2, 1, 0]
    assert cm._earlier(np.array([], np.int64)).tolist() == []


@pytest.mark.parametrize("learned", ["true", "false"])
def test_model_odd_rows(spark, learned):
    rows = plain.odd_rows()
    docs = plain.frame(spark, rows).withColumn("learned", F.expr(learned))
    got = cm.score(docs, cm.learn(docs, "learned")).collect()
    counts = plain.word_counts(r[1] for r in rows) if learned == "true" else plain.word_counts([])
    want = [(r[0], plain.base_score(r[1], counts)[0]) for r in rows]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(want, key=repr)
    base = {r[0]: plain.base_score(r[1], counts) for r in rows if r[0] is not None}
    for r in got:
        assert math.isfinite(r.score) and r.score <= 0
        if r.doc_id is not None:
            assert r.base_score == pytest.approx(base[r.doc_id][2], rel=1e-9, abs=1e-9) and r.n_known == base[r.doc_id][1]
    none = plain.frame(spark, []).withColumn("learned", F.lit(True))
    assert cm.score(none, cm.learn(none, "learned")).count() == 0


# ---- neighbours


def _nearest(rows, asked, k):
    out = {}
    for q, v in asked:
        s = sorted(((-float(np.dot(np.array(v), np.array(x))), i) for i, x in rows if i != q))[:k]
        out[q] = s
    return out


def test_recall_on_the_smallest_table(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SMOKE}/embeddings.parquet").collect()]
    got = queries.op4_hnsw(spark, SMOKE).collect()
    want = _nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len({r.query_id for r in got}) == len(want) and len(got) == 20 * len(want)
    assert sum((q, i) in found for q, s in want.items() for _, i in s) >= 0.95 * 20 * len(want)


def test_recall_and_merge_over_shards(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 24))
    x *= rng.uniform(0.3, 3, (3000, 1))  # lengths differ: the largest inner product is no angle
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("extra"))
    got = hnsw.nearest(frame, frame.where("vec_id % 50 = 0"), 10, shard_points=700).collect()
    want = _nearest(rows, [r for r in rows if r[0] % 50 == 0], 10)
    found = {(r.query_id, r.vec_id): r.score for r in got}
    hit = [(q, i, s) for q, top in want.items() for s, i in top if (q, i) in found]
    assert len(hit) >= 0.9 * 10 * len(want)
    assert all(found[q, i] == pytest.approx(-s, rel=1e-12) for q, i, s in hit)
    for q in want:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(60)] + [(100, [0.0, 2.0, 0.0]), (101, [0.0, 0.0, 0.0]), (102, None), (103, [1.0, None, 0.0]),
            (104, [nan, 1.0, 1.0]), (105, [inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (106, []), (107, [3.0, 4.0]), (100, [0.0, 2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hnsw.nearest(frame, frame, 5).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == {*range(60), 100}  # 107 is alone with its length
    assert by[0] == [1, 2, 3, 4, 5] and by[3] == [0, 1, 2, 4, 5] and by[59] == [0, 1, 2, 3, 4]
    assert by[100] == [0, 1, 2, 3, 4]
    assert hnsw.nearest(frame.limit(0), frame).count() == 0 and hnsw.nearest(frame, frame.limit(0)).count() == 0


# ---- pipeline


def _documents(tmp_path, spark):
    rng = random.Random(7)
    bad = ["vile", "rotten", "dreadful"]
    text = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    bench = [(i, text(14)) for i in range(6)]
    rows, labels, kind = [], [], {}
    for i in range(240):
        t = text(rng.randint(30, 90))
        kind[i] = "clean"
        if i % 6 == 1:
            t, kind[i] = " ".join([t, *rng.choices(bad, k=4), "x"]), "toxic"
        elif i % 15 == 2:
            t, kind[i] = t + " " + bench[i % 6][1], "leak"
        elif i % 20 == 4:
            t, kind[i] = rows[0][1], "copy"
        if i % 3 or i % 6 == 1:
            labels.append((i, 1, int(kind[i] == "toxic")))
        rows.append(plain.row(i, t, source=f"s{i % 4}" if i % 5 else "hot"))
    plain.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, bench, kind


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows, bench, kind = _documents(tmp_path, spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    text = {r[0]: r[1] for r in rows}
    source = {r[0]: r[3] for r in rows}
    left = [d for d in text if kind[d] != "toxic"]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = queries.written(stage(spark, docs, str(tmp_path)), "test")
        if name == "near-duplicates":
            same = plain.components([(d, plain.fingerprint(text[d])) for d in left])
            left = [d for d, c in zip(left, same) if d == c]
        if name == "decontamination":
            left = [d for d in left if not plain.contamination(text[d], bench)[1]]
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(left), name
        assert docs.columns == list(plain.SCHEMA.names)
    assert {kind[d] for d in left} == {"clean"}
    mixed = queries.written(corpus_pipeline.to_target_weights(spark, docs, str(tmp_path)), "test")
    size = lambda d: len(plain.SPACED.findall(text[d]))
    sizes = {}
    for d in left:
        sizes[source[d]] = sizes.get(source[d], 0) + size(d)
    taken = {s: 0 for s in sizes}
    copies = {}
    for r in mixed.select("doc_id").collect():
        taken[source[r.doc_id]] += size(r.doc_id)
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3 and set(copies) <= set(left)
    for s, (_, target) in plain.mix_targets(sizes).items():
        assert abs(taken[s] - target) <= 45
    out = corpus_pipeline.to_shards(spark, mixed, str(tmp_path)).collect()
    assert len(out) == sum(copies.values())
    per = [sum(r.shard == k for r in out) for k in range(8)]
    assert max(per) - min(per) <= 1


def test_pipeline_of_no_rows(spark, tmp_path):
    plain.frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names and len(queries.QUERIES) == 13
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert SPACED_WORD.startswith("[^")


# ---- queries with SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    want = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SMOKE)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
