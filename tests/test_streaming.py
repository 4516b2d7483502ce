"""Incremental graph refresh: the stream over appended files equals the batch projection."""

import os
import tempfile

from quarry.plans.bindings import driver_ontology
from quarry.streaming import refresh as RF


def test_stream_refresh_equals_batch(spark, catalog):
    onto = driver_ontology()
    rels = ["shippedLine", "ofPart"]
    li = catalog.lineitem
    base = tempfile.mkdtemp(prefix="quarry-stream-")
    src, sink, ckpt = (os.path.join(base, x) for x in ("src", "sink", "ckpt"))
    li.where("l_orderkey % 2 = 0").write.parquet(os.path.join(src, "part1"))
    q = RF.start_edge_refresh(spark, os.path.join(src, "*"), li.schema, onto, rels, sink, ckpt)
    q.awaitTermination()
    n1 = spark.read.parquet(sink).count()
    li.where("l_orderkey % 2 = 1").write.parquet(os.path.join(src, "part2"))
    q = RF.start_edge_refresh(spark, os.path.join(src, "*"), li.schema, onto, rels, sink, ckpt)
    q.awaitTermination()
    got = spark.read.parquet(sink)
    exp = RF.edges_of(li, onto, rels)
    assert n1 < got.count()
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0
    # a run with no new files appends nothing (files already committed are not read again)
    n2 = got.count()
    q = RF.start_edge_refresh(spark, os.path.join(src, "*"), li.schema, onto, rels, sink, ckpt)
    q.awaitTermination()
    assert spark.read.parquet(sink).count() == n2


def test_changes_equal_a_rebuild(spark, catalog, tmp_path):
    """Inserts, updates, deletes, late and re-delivered files, a replayed feed and a merge that failed halfway."""
    import random

    import pytest
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    onto, rels = driver_ontology(), ["placedOrder"]
    fact = catalog.orders
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fact.schema.fields], T.StructField("version", T.IntegerType()),
                           T.StructField("deleted", T.BooleanType())])
    rng = random.Random(6)
    live, files, version = {}, [], 0
    some = [tuple(r) for r in fact.limit(200).collect()]
    at = fact.columns.index("o_custkey")
    for _ in range(5):
        rows = []
        for r in rng.sample(some, 60):
            version += 1
            gone = rng.random() < 0.25
            new = (*r[:at], rng.randint(1, 9), *r[at + 1:])
            rows.append((*new, version, gone))
            live[r[0]] = None if gone else new
        files.append(rows)
    store = RF.FactStore(spark, str(tmp_path / "store"), schema, ["o_orderkey"], buckets=5)
    assert store.live().count() == 0
    src = tmp_path / "src"
    put = lambda i, name: spark.createDataFrame(files[i], schema).coalesce(1).write.parquet(str(src / name))
    run = lambda ckpt: RF.start_change_refresh(store, str(src / "*"), str(tmp_path / ckpt)).awaitTermination()

    def check():
        want = spark.createDataFrame([r for r in live.values() if r], fact.schema)
        got, exp = store.edges(onto, rels), RF.edges_of(want, onto, rels)
        assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0

    put(1, "b")     # the second file first
    run("c1")
    for i, name in ((0, "a"), (2, "c"), (4, "e")):
        put(i, name)
    run("c1")
    put(3, "d")
    put(2, "c-again")
    # a merge that fails before its commit leaves the last commit as it is
    before = sorted(map(repr, store.live().collect()))
    broken = spark.createDataFrame(files[3], schema).withColumn("o_custkey", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.merge(broken)
    assert sorted(map(repr, store.live().collect())) == before
    run("c1")
    check()
    run("c1")       # no new files
    run("c2")       # the whole feed once more, under a new checkpoint
    check()
    store.vacuum()
    check()
    assert len(os.listdir(tmp_path / "store" / "manifests")) == 1
