"""What the Python workers of the corpus pipeline hold."""

import pytest

from quarry.llm import decontaminate, toxicity

WORDS = 2_000


@pytest.fixture
def model():
    weights = {b: 0.01 * (i % 7 - 3) for i in range(0, WORDS, 3) for b in toxicity._features(b"word%d" % i)}
    return toxicity.SeverityModel(weights, (0.0, 1.0), 0.5)


def test_remembered_words_are_bounded(model, monkeypatch):
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 100)
    kept = toxicity._Kept(model.weights)
    for i in [*range(WORDS), *range(WORDS)]:
        word = b"word%d" % i
        assert kept[word] == tuple(b for b in toxicity._features(word) if b in model.weights)
        assert len(kept) <= 100


def test_severity_does_not_depend_on_what_is_remembered(spark, model, monkeypatch):
    texts = [(i, " ".join(f"Word{(i * 37 + j * j) % WORDS}" for j in range(60))) for i in range(50)] + [(50, ""), (51, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(1)
    whole = sorted(toxicity.toxicity(docs, model).collect())
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 10)
    assert sorted(toxicity.toxicity(docs, model).collect()) == whole
    assert len({r.severity for r in whole}) > 10 and whole[50].severity == whole[51].severity == pytest.approx(0.5 + 1 / (1 + 2.718281828459045))


def test_workers_get_by_without_pandas(spark, model):
    """Each worker that loads pandas holds 23 MB more for the rest of its life."""
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")

    for df in (toxicity.toxicity(docs, model), decontaminate.decontaminate(docs, items)):
        assert "Pandas" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == 2
