"""Answer scoring edge cases (Column functions, no UDFs)."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import scoring as S


def one(spark, exprs, data, schema):
    return spark.createDataFrame(data, schema).select(*exprs).collect()


def test_extract_numbers_formats(spark):
    r = one(spark, [S.extract_numbers("a").alias("n")], [("avg 1,234.5 and 20. and -3 v2",)], "a string")
    assert r[0].n == [1234.5, 20.0, -3.0, 2.0]


def test_extract_numbers_null_and_none(spark):
    r = one(spark, [S.extract_numbers("a").alias("n")], [(None,), ("no digits here",)], "a string")
    assert [x.n for x in r] == [[], []]


@pytest.mark.parametrize("answer,ok", [("about 19.8", True), ("20.2 units", True), ("19.79", False),
                                       ("20.21", False), ("twenty", False), ("in 2020 it was 3", False)])
def test_scalar_tolerance(spark, answer, ok):
    r = one(spark, [S.score_scalar_numeric("a", "e").alias("ok")], [(answer, 20.0)], "a string, e double")
    assert r[0].ok is ok


def test_scalar_small_values_use_absolute_floor(spark):
    r = one(spark, [S.score_scalar_numeric("a", "e").alias("ok")], [("0.01", 0.0), ("0.011", 0.0)], "a string, e double")
    assert [x.ok for x in r] == [True, False]


def test_matched_number_reported(spark):
    r = one(spark, [S.matched_number("a", "e").alias("m")], [("Customer#000000516 placed 12 orders", 12.0)],
            "a string, e double")
    assert r[0].m == 12.0


def test_norm_collapses_unicode_whitespace(spark):
    r = one(spark, [S.norm("a").alias("n")], [("  Blue  Lake \t Reservoir\n",)], "a string")
    assert r[0].n == "blue lake reservoir"


def test_text_substring(spark):
    r = one(spark, [S.score_scalar_text("a", "e").alias("ok")], [("It is Spirogyra  spp.", "spirogyra spp."),
                                                               ("none", "Cyanobacteria")], "a string, e string")
    assert [x.ok for x in r] == [True, False]


def test_set_recall_cases(spark):
    df = spark.createDataFrame([("Blue Lake and Red Pond", ["Blue Lake", "Red Pond"]),
                                ("only Blue Lake", ["Blue Lake", "Red Pond"]),
                                ("anything", []),
                                (None, ["x"])], "a string, v array<string>")
    r = df.select(S.set_recall("a", "v").alias("r"), S.set_correct("a", "v").alias("ok"),
                  F.slice(S.set_missing("a", "v"), 1, 5).alias("miss")).collect()
    assert [(x.r, x.ok) for x in r] == [(1.0, True), (0.5, False), (1.0, True), (0.0, False)]
    assert r[1].miss == ["Red Pond"]


def test_refusal_verdict_first_then_keywords(spark):
    r = one(spark, [S.score_refusal("a", "v").alias("ok")],
            [("The data is not available.", None), ("Paris.", None), ("Paris.", True), ("I cannot say", False)],
            "a string, v boolean")
    assert [x.ok for x in r] == [True, False, True, False]


def test_grounding_markers(spark):
    df = spark.createDataFrame([([("fabric_kb_retrieve", "x")],), ([("function", "mcp")],), ([("mcp_call", "y")],),
                                ([],), (None,)], "t array<struct<type:string,name:string>>")
    r = df.select(S.grounded("t").alias("g")).collect()
    assert [x.g for x in r] == [True, False, True, False, False]


def test_task_cost_rounding(spark):
    r = one(spark, [S.task_cost("i", "o", "ri", "ro").alias("c")], [(1132, 46, 1.25, 10.0)],
            "i long, o long, ri double, ro double")
    assert r[0].c == pytest.approx(round((1132 / 1e6) * 1.25 + (46 / 1e6) * 10.0, 8), abs=1e-12)


def test_unknown_answer_type_raises(spark):
    df = spark.createDataFrame([("bogus",)], "t string")
    with pytest.raises(Exception, match="unknown answer_type"):
        df.select(S.dispatch_correct("t", F.lit(True), F.lit(True), F.lit(True))).collect()


def test_norm_nbsp_and_ideographic_space(spark):
    r = one(spark, [S.norm("a").alias("n"), S.score_scalar_text("a", "e").alias("ok")],
            [("Blue Lake　Reservoir", "blue lake reservoir")], "a string, e string")
    assert r[0].n == "blue lake reservoir" and r[0].ok is True


def test_py_strip_matches_python(spark):
    texts = ["  x y \t\n", " abc　", "plain", ""]
    r = one(spark, [S.py_strip("a").alias("s")], [(t,) for t in texts], "a string")
    assert [x.s for x in r] == [t.strip() for t in texts]


def test_randomised_extraction_and_normalisation_match_python(spark):
    """Number extraction and whitespace normalisation against plain Python on random strings."""
    import random
    import re

    rnd = random.Random(11)
    alphabet = list("0123456789,.-- abcXYZéÜ") + [" ", "\t", "\n", " ", "　", "\x1c", " "]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(600)]

    def py_numbers(t):
        out = []
        for tok in re.findall(r"-?\d[\d,]*\.?\d*", t):
            try:
                out.append(float(tok.replace(",", "")))
            except ValueError:
                pass
        return out

    def py_norm(t):
        return re.sub(r"\s+", " ", t).strip().lower()

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.n, r.s) for r in df.select("i", S.extract_numbers("t").alias("n"), S.norm("t").alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == py_numbers(t), repr(t)
        assert got[i][1] == py_norm(t), repr(t)


def test_randomised_set_recall_and_refusal_match_python(spark):
    import random
    import re

    rnd = random.Random(5)
    members = ["Blue Lake", "red  pond", "Ñandú Bay", "x", "Lake"]
    words = members + S.REFUSAL_PHRASES + ["data", "is", "none", "BLUE", " ", "\t", " ", "can", "not"]
    cases = []
    for _ in range(300):
        answer = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 8)))
        expected = rnd.sample(members, rnd.randint(0, 3))
        cases.append((answer if rnd.random() > 0.05 else None, expected))

    def norm(t):
        return re.sub(r"\s+", " ", t or "").strip().lower()

    df = spark.createDataFrame([(i, a, e) for i, (a, e) in enumerate(cases)], "i int, a string, e array<string>")
    got = {r.i: r for r in df.select("i", S.set_recall("a", "e").alias("rec"), S.set_correct("a", "e").alias("ok"),
                                     S.refusal_heuristic("a").alias("ref")).collect()}
    for i, (a, e) in enumerate(cases):
        found = [v for v in e if norm(v) in norm(a)]
        rec = len(found) / len(e) if e else 1.0
        assert got[i].rec == rec and got[i].ok == (rec >= 0.999), (a, e)
        assert got[i].ref == any(k in norm(a) for k in S.REFUSAL_PHRASES), a


def test_records_of_all_kinds_and_errors(spark):
    """Text scalars, errors with and without an answer, verdicts that an error voids, an unknown kind."""
    import pytest

    num = spark.createDataFrame([("a", "scalar", "about 12 of 40", 40.0, None, 1), ("b", "scalar", "none", 3.0, None, 2), ("c", "scalar", None, 3.0, "timeout", 3)],
                                "id string, answer_type string, answer string, expected_num double, error string, extra int")
    words = spark.createDataFrame([("d", "scalar", "It is  BLUE-green", "blue-GREEN"), ("e", "scalar", "red", "blue")],
                                  "id string, answer_type string, answer string, expected_text string")
    sets = spark.createDataFrame([("f", "set", "x and y", ["x", "y"]), ("g", "set", "x", ["x", "it's", "z"]), ("h", "set", None, []), ("i", "set", "", list("bcdefgh"))],
                                 "id string, answer_type string, answer string, expected_values array<string>")
    refusals = spark.createDataFrame([("j", "refusal", "no data", None, None), ("k", "refusal", "42", None, True), ("l", "refusal", "42", "timeout", True),
                                      ("m", "refusal", "I cannot", "timeout", False), ("n", "refusal", None, "timeout", None)],
                                     "id string, answer_type string, answer string, error string, judge_correct boolean")
    out = S.score_answers([num, words, sets, refusals])
    got = {r.id: (r.correct, r.set_recall, r.detail) for r in out.collect()}
    assert got == {
        "a": (True, None, "found 40.0 within tol of 40.0"), "b": (False, None, "expected 3.0 not found among numbers in answer"),
        "c": (False, None, "expected 3.0 not found among numbers in answer"), "d": (True, None, "substring match for 'blue-GREEN'"),
        "e": (False, None, "substring match for 'blue'"), "f": (True, 1.0, "recall 1.00"), "g": (False, 1 / 3, "recall 0.33, missing ['it's', 'z']"),
        "h": (True, 1.0, "recall 1.00"), "i": (False, 0.0, "recall 0.00, missing ['b', 'c', 'd', 'e', 'f']"),
        "j": (True, None, "refusal: judge-primary (heuristic)"), "k": (True, None, "refusal: judge-primary"),
        "l": (False, None, "refusal: judge-primary (heuristic)"), "m": (True, None, "refusal: judge-primary (heuristic)"),
        "n": (False, None, "refusal: judge-primary (heuristic)")}
    assert {"extra", "error", "judge_correct"} <= set(out.columns)
    assert {r.id: r.judge_correct for r in out.where("answer_type = 'refusal'").collect()} == {"j": None, "k": True, "l": None, "m": None, "n": None}
    with pytest.raises(Exception, match="no rule for answer_type essay"):
        S.score_answers([refusals.withColumn("answer_type", F.lit("essay"))]).collect()


def test_split_head_without_a_limit(spark):
    from quarry.plans import truth as TR

    tasks = spark.createDataFrame([(i, ("train", "dev", None)[i % 3]) for i in range(300)], "task_id long, split string").repartition(4)
    got = sorted((r.split, r.task_id, r["rank"]) for r in TR.split_head(tasks, {"train": None, "dev": 2}, "task_id").collect())
    assert got == [("dev", 1, 1), ("dev", 4, 2)] + [("train", 3 * i, i + 1) for i in range(100)]
    assert TR.split_head(tasks, {}, "task_id").count() == 0
