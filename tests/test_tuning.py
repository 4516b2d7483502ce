"""Adopt-gate replay: the published candidate log, and brute force on derived logs."""

import os
import random

import pytest

from quarry.operators import tuning as TU
from quarry.sources import derived as D

# A published tuning log: (cid, train acc %, train tokens, train negatives correct,
# DEV acc %, DEV tokens, DEV negatives correct) - DEV only for candidates that were DEV-evaluated.
LOG = [("seed", 91.67, 64589, 3, 100.0, 11462, 1), ("c01", 100.0, 145786, 3, 83.33, 14431, 1),
       ("c02", 100.0, 52157, 3, 100.0, 14686, 1), ("c03", 100.0, 146364, 3, 100.0, 10228, 1),
       ("c04", 91.67, 59710, 3, None, None, None), ("c05", 100.0, 152100, 3, None, None, None),
       ("c06", 100.0, 18752, 3, 100.0, 8963, 1), ("c07", 66.67, 17313, 3, None, None, None),
       ("c08", 83.33, 18468, 3, None, None, None), ("c09", 100.0, 19827, 3, None, None, None),
       ("c10", 91.67, 23815, 3, None, None, None)]


def test_published_log_reproduces(spark):
    import datetime as dt

    rows = [(1, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), i, a, t, n, da, dtk, dn)
            for i, (_, a, t, n, da, dtk, dn) in enumerate(LOG)]
    cands = spark.createDataFrame(rows, "run_id long, step_ts timestamp, cid long, train_acc double, train_tokens long, "
                                        "train_neg int, dev_acc double, dev_tokens long, dev_neg int")
    out = {r.cid: (bool(r.promising), bool(r.adopted), r.parent_cid) for r in TU.replay_adopt_gate(cands).collect()}
    names = [c[0] for c in LOG]
    promising = sorted(names[c] for c, v in out.items() if v[0] and c != 0)
    adopted = sorted(names[c] for c, v in out.items() if v[1])
    assert promising == ["c01", "c02", "c03", "c06"]
    assert adopted == ["c03", "c06", "seed"]
    assert names[out[9][2]] == "c06"        # c09 was judged against c06


def _fold(rows):
    """Direct sequential replay of the gate (brute force)."""
    out = {}
    runs = {}
    for r in rows:
        runs.setdefault(r.run_id, []).append(r)
    for run, steps in runs.items():
        steps.sort(key=lambda r: (r.step_ts, r.cid))
        seed = best = steps[0]
        out[seed.cid] = (True, True)
        for c in steps[1:]:
            p = ((c.train_acc, -c.train_tokens) > (best.train_acc, -best.train_tokens)) and c.train_neg >= best.train_neg
            a = p and (c.dev_acc, -c.dev_tokens) > (best.dev_acc, -best.dev_tokens) and c.dev_acc >= seed.dev_acc \
                and c.dev_neg >= seed.dev_neg
            out[c.cid] = (p, a)
            if a:
                best = c
    return out


def test_replay_equals_sequential_fold(catalog):
    cands = D.candidates(catalog)
    exp = _fold(cands.collect())
    got = {r.cid: (bool(r.promising), bool(r.adopted)) for r in TU.replay_adopt_gate(cands).collect()}
    assert got == exp


def _random_log(rng, runs, steps, step):
    """Rows of runs whose figures rise now and then (``step``: how fast), some of them missing."""
    rows = []
    for run in range(runs):
        level = 0
        for i in range(steps if run else 3 * steps):
            level += rng.random() < step
            some = lambda v: None if rng.random() < 0.03 else v
            rows.append((run, i // 3, run * 100_000 + i, some(level + rng.randint(0, 3)), some(rng.randint(5, 9)), some(rng.randint(0, 2) + level // 20),
                         some(float(level + rng.randint(0, 3))), some(rng.randint(5, 9)), some(rng.randint(0, 2))))
    return rows


def _gate_of(row, best, seed):
    def objective(acc, tokens):
        return None if acc is None or tokens is None else (acc, -tokens)

    def beats(a, b):
        return a is not None and b is not None and a > b

    def least(a, b):
        return a is not None and b is not None and a >= b

    promising = beats(objective(row[3], row[4]), objective(best[3], best[4])) and least(row[5], best[5])
    return promising, (promising and beats(objective(row[6], row[7]), objective(best[6], best[7]))
                       and least(row[6], seed[6]) and least(row[8], seed[8]))


@pytest.mark.parametrize("block", [1, 7, 512])
@pytest.mark.parametrize("step", [0.02, 0.9])
def test_replay_in_blocks_equals_the_fold(spark, block, step):
    """Long runs over many blocks and tasks, with few and with constant adoptions, missing figures included."""
    rng = random.Random(block + int(100 * step))
    rows = _random_log(rng, 6, 150, step)
    rng.shuffle(rows)
    schema = ("run_id long, step_ts int, cid long, train_acc int, train_tokens long, train_neg int, dev_acc double, dev_tokens long, dev_neg int")
    got = {(r.run_id, r.cid): tuple(r) for r in TU.replay_adopt_gate(spark.createDataFrame(rows, schema).repartition(3), block).collect()}
    want = {}
    for run in {r[0] for r in rows}:
        steps = sorted((r for r in rows if r[0] == run), key=lambda r: r[1:3])
        seed = best = steps[0]
        want[run, seed[2]] = (run, seed[2], seed[1], True, True, None, 0, seed[3], seed[6], seed[7])
        depth = 0
        for r in steps[1:]:
            p, a = _gate_of(r, best, seed)
            want[run, r[2]] = (run, r[2], r[1], p, a, best[2], depth + a, r[3], r[6], r[7])
            if a:
                best, depth = r, depth + 1
    assert got == want
    assert TU.replay_adopt_gate(spark.createDataFrame([], schema)).count() == 0


def test_replay_of_a_null_run_and_its_folders(spark, tmp_path):
    schema = "run_id long, step_ts int, cid long, train_acc int, train_tokens long, train_neg int, dev_acc double, dev_tokens long, dev_neg int"
    rows = [(None, 1, 1, 5, 10, 1, 5.0, 10, 1), (None, 2, 2, 6, 10, 1, 6.0, 10, 1), (3, 1, 3, 5, 10, 1, None, 10, 1), (3, 2, 4, 6, 10, 1, 6.0, 10, 1)]
    before = set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")))
    got = {(r.run_id, r.cid, r.promising, r.adopted, r.depth) for r in TU.replay_adopt_gate(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(None, 1, True, True, 0), (None, 2, True, True, 1), (3, 3, True, True, 0), (3, 4, True, False, 0)}
    left = set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:"))) - before
    assert len(left) == 1 and left.pop().startswith("quarry-replay-")


def test_ranking_and_lineage(catalog):
    cands = D.candidates(catalog)
    rep = TU.replay_adopt_gate(cands)
    lin = TU.candidate_lineage(rep).collect()
    by_run = {}
    for r in lin:
        by_run.setdefault(r.run_id, []).append(r)
    for run, chain in by_run.items():
        depths = sorted(r.depth for r in chain)
        assert depths == list(range(len(chain)))          # one adoption per depth
    ranks = TU.candidate_ranking(rep, cands).collect()
    per = {}
    for r in ranks:
        per.setdefault(r.run_id, []).append(r.rank)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in per.values())


def test_batched_truth_equals_per_question_plans(catalog):
    from quarry.plans import truth as TR
    from quarry.plans.questions import Semantic

    sem = Semantic(catalog)
    cols = ["id", "value_text", "value_num", "n_values"]
    a = TR.truth_table(sem, batched=True).select(*cols)
    b = TR.truth_table(sem, batched=False, checkpoint=False).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
