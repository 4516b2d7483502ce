"""Recall of large sets: the same figures as one substring test a member."""

import random

import pytest

from quarry.operators import set_recall as SR


def plain(answer, members, show=5):
    def norm(x):
        return " ".join((x or "").split()).lower()

    a, members = norm(answer), sorted((m for m in members if m[1] is not None), key=lambda m: m)
    found = [m for m in members if norm(m[1]) in a]
    recall = len(found) / len(members) if members else 1.0
    return (len(members), len(found), recall, recall >= 0.999, [m[1] for m in members if norm(m[1]) not in a][:show])


@pytest.mark.parametrize("chunk", [3, 50_000])
def test_equals_one_test_a_member(spark, chunk):
    rng = random.Random(chunk)
    word = lambda: "".join(rng.choice("abAB é") for _ in range(rng.randint(0, 6)))
    answers = {t: word() + "".join(rng.choice("abAB \t\né") for _ in range(40)) for t in range(12)}
    answers |= {20: None, 21: "", 22: "x  Y\nz", 23: "she sells hers"}
    members = [(t, i, word()) for t in range(12) for i in range(rng.randint(0, 25))]
    members += [(20, 0, "a"), (20, 1, ""), (21, 0, "b"), (22, 0, "X y Z"), (22, 1, None), (22, 2, "X y Z"), (99, 0, "no answer")]
    members += [(23, i, m) for i, m in enumerate(["he", "she", "hers", "hers", "sell", "her", "his"])]
    got = SR.long_set_recall(spark.createDataFrame(list(answers.items()), "task_id long, answer string"),
                             spark.createDataFrame(members, "task_id long, position int, value string").repartition(3), chunk).collect()
    want = {t: plain(a, [m[1:] for m in members if m[0] == t]) for t, a in answers.items()}
    assert {r.task_id: tuple(r)[1:] for r in got} == want


def test_a_set_of_100_000_members(spark):
    """One hot task: 100,000 members over several chunks, every seventh missing from the answer."""
    from pyspark.sql import functions as F

    members = spark.range(100_000).select(F.lit("t").alias("task_id"), F.col("id").alias("position"), F.concat(F.lit("Member <"), F.col("id"), F.lit(">")).alias("value"))
    text = " ".join(f"member <{i}>" for i in range(100_000) if i % 7)
    answers = spark.createDataFrame([("t", text), ("none", "x")], "task_id string, answer string")
    got = {r.task_id: r for r in SR.long_set_recall(answers, members, 20_000).collect()}
    t = got["t"]
    assert (t.n_expected, t.n_found, t.correct) == (100_000, 100_000 - 14_286, False)
    assert list(t.missing) == [f"Member <{7 * i}>" for i in range(5)] and got["none"].recall == 1.0
