"""Readers, sinks, bindings and graph projection."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans import graph as G
from quarry.plans.bindings import driver_ontology, parse_ontology
from quarry.sources import tables as TB


def test_csv_declared_boolean(spark):
    d = tempfile.mkdtemp(prefix="quarry-csv-")
    p = os.path.join(d, "sites.csv")
    with open(p, "w") as f:
        f.write('site_id,notes,active\nS1,"warm, shallow",true\nS2,,false\n')
    schema = T.StructType([T.StructField("site_id", T.StringType()), T.StructField("notes", T.StringType()),
                           T.StructField("active", T.BooleanType())])
    rows = TB.read_csv_table(spark, p, schema).orderBy("site_id").collect()
    assert [(r.site_id, r.notes, r.active) for r in rows] == [("S1", "warm, shallow", True), ("S2", None, False)]


def test_jsonl_questions_and_truth_file(spark):
    d = tempfile.mkdtemp(prefix="quarry-json-")
    q = os.path.join(d, "q.jsonl")
    with open(q, "w") as f:
        f.write(json.dumps({"id": "S01", "category": "single_hop", "answerable": True, "answer_type": "scalar",
                            "question": "How many?", "sql": "SELECT 1", "expected_traversal": ["Site"]}) + "\n\n")
        f.write(json.dumps({"id": "N01", "category": "negative", "answerable": False, "answer_type": "refusal",
                            "question": "Why?", "expected_traversal": []}) + "\n")
    rows = TB.read_questions(spark, q).collect()
    assert [r.id for r in rows] == ["S01", "N01"] and rows[0].expected_traversal == ["Site"]
    t = os.path.join(d, "truth.json")
    with open(t, "w") as f:
        json.dump({"_meta": {"n": 2}, "ground_truth": {"S01": {"answer_type": "scalar", "value": 20},
                                                       "M03": {"answer_type": "set", "values": ["a", "b"], "count": 2}}},
                  f, indent=2)
    tr = {r.id: r for r in TB.read_truth_file(spark, t).collect()}
    assert tr["S01"].value == "20" and tr["M03"].values == ["a", "b"] and tr["M03"]["count"] == 2


def test_partitioned_sink_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="quarry-sink-")
    df = spark.createDataFrame([("m0", 1, 90.0), ("m1", 2, 80.0)], "model string, n int, pct double")
    TB.write_table(df, d, partition_by=["model"])
    back = spark.read.parquet(d).select("model", "pct").orderBy("model").collect()
    assert [(r.model, r.pct) for r in back] == [("m0", 90.0), ("m1", 80.0)]


def test_parse_rejects_unknown_end():
    with pytest.raises(ValueError):
        parse_ontology({"entities": [], "relationships": [{"name": "r", "source": "A", "target": "B", "table": "t",
                                                           "source_cols": ["a"], "target_cols": ["b"]}]})


def test_source_tables_deduplicated():
    assert driver_ontology().source_tables() == ["customer", "supplier", "nation", "part", "orders", "lineitem"]


def test_traverse_equals_direct_join(catalog):
    onto = driver_ontology()
    t = G.traverse(catalog, onto, ["Supplier", "shippedLine", "LineItem", "ofPart", "Part"],
                   where={"Part": "part_type = 'PROMO'"}, select={"Supplier": ["supplier_name"]})
    got = sorted(r.supplier_supplier_name for r in t.distinct().collect())
    li, s, p = catalog.lineitem, catalog.supplier, catalog.part
    exp = sorted(r.s_name for r in li.join(p.where("p_type = 'PROMO'"), li.l_partkey == p.p_partkey)
                 .join(s, li.l_suppkey == s.s_suppkey).select("s_name").distinct().collect())
    assert got == exp


def test_edges_keys_match_nodes(catalog):
    onto = driver_ontology()
    nodes = G.graph_nodes(catalog, onto)
    edges = G.graph_edges(catalog, onto)
    assert G.dangling_edges(edges, nodes, "dst_key").count() == 0
    assert G.dangling_edges(edges, nodes, "src_key").count() == 0


def test_traversal_does_not_self_join_fact_table(catalog):
    onto = driver_ontology()
    t = G.traverse(catalog, onto, ["Supplier", "shippedLine", "LineItem", "ofPart", "Part"],
                   select={"Supplier": ["supplier_name"]})
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem.parquet") <= 1 or plan.count("Relation") == 3
