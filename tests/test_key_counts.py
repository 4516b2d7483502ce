"""Key contracts in tasks of a bounded number of rows."""

import re
from collections import Counter

import pytest

from quarry.plans import graph as G
from quarry.plans.bindings import parse_ontology
from quarry.sources.tables import Catalog

SPEC = {
    "entities": [
        {"name": "A", "table": "a", "key": ["id"], "display": "id", "properties": [{"name": "id", "type": "BigInt"}]},
        {"name": "B", "table": "b", "key": ["x", "y"], "display": "x",
         "properties": [{"name": "x", "type": "BigInt"}, {"name": "y"}]}],
    "relationships": [{"name": "r", "source": "A", "target": "B", "table": "b", "source_cols": ["a"], "target_cols": ["x", "y"]}],
}


@pytest.fixture
def tables(spark, tmp_path):
    a = [(k,) for k in range(700)] + [(3,), (3,), (None,), (None,)]
    # a hot end without a node, and keys that repeat or hold a NULL
    b = [(k, str(k % 7), k % 900) for k in range(1500)] + [(k, "z", 5000) for k in range(600)] + [(1, "1", 2), (None, "q", 1), (4, None, None)]
    spark.createDataFrame(a, "id long").write.parquet(str(tmp_path / "a.parquet"))
    spark.createDataFrame(b, "x long, y string, a long").write.parquet(str(tmp_path / "b.parquet"))
    return a, b, Catalog(spark, str(tmp_path)), parse_ontology(SPEC)


def _dealt(df, key):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, [int(n) for n in re.findall(rf"hashpartitioning\([^)]*{key}[^)]*, (\d+)\)", plan)]


def test_tasks_grow_in_number_with_the_rows(tables, monkeypatch):
    a, b, catalog, onto = tables
    monkeypatch.setattr(G, "TASK_ROWS", 100)
    keys = G.entity_key_violations(catalog, onto)
    _, dealt = _dealt(keys, "id")
    assert dealt == [8]  # 704 rows
    n = Counter(a)
    want = {("A", str(k) if k is not None else "NULL", c) for (k,), c in n.items() if c > 1 or k is None}
    n = Counter(r[:2] for r in b)
    want |= {("B", f"{'NULL' if x is None else x}:{'NULL' if y is None else y}", c) for (x, y), c in n.items() if c > 1 or None in (x, y)}
    assert {tuple(r) for r in keys.collect()} == want


def test_ends_without_nodes_in_many_tasks(tables, monkeypatch):
    a, b, catalog, onto = tables
    monkeypatch.setattr(G, "TASK_ROWS", 100)
    ends = G.dangling_ends(catalog, onto)
    plan, dealt = _dealt(ends, "node_key")
    assert "Join" not in plan and set(dealt) == {29, 43}  # 2,103 rows with 704 or with themselves
    have = {k for k, in a}
    used = Counter(r[2] for r in b if None not in r)
    assert {tuple(r) for r in ends.collect()} == {("r", "src_key", str(k), c) for k, c in used.items() if k not in have}
    assert G.key_violations(catalog.table("b"), ["x", "y"]).where("n = 2").count() == sum(c == 2 for c in Counter(r[:2] for r in b).values())
