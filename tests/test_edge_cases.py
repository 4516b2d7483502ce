"""NULL groups, odd CSV and JSON text, fingerprints of near misses, row-count rules, checkpoint folders."""

import json

import pytest
from pyspark.sql import functions as F

from quarry import session
from quarry.operators import compare as CMP
from quarry.operators import evidence as EV
from quarry.operators import order_stats as OS
from quarry.operators import scorecard as SC
from quarry.sources import contracts as CT
from quarry.sources import tables as TB


def test_null_group_keeps_its_percentiles(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), (None, 2), ("m", 10)], "model string, v long")
    picks = {"p50": OS.upper_median}
    for got in (OS.order_statistics(df, ["model"], "v", picks),
                OS.order_statistics(df.withColumn("v", F.col("v").cast("double")), ["model"], "v", picks)):
        assert {(r.model, r.n, r.p50) for r in got.collect()} == {(None, 3, 2), ("m", 1, 10)}


def test_null_group_is_ranked_and_capped(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("q", 5)], "question_id string, ref_no long")
    ranked = OS.rank_within_groups(df, ["question_id"], [F.col("ref_no")])
    assert {(r.question_id, r.ref_no, r["rank"]) for r in ranked.collect()} == {(None, 1, 1), (None, 2, 2), ("q", 5, 1)}
    capped = EV.cap_blocks(df, 1)
    assert {(r.question_id, r.ref_no, r.n_total) for r in capped.collect()} == {(None, 1, 2), ("q", 5, 1)}


def test_rollup_tells_null_from_total(spark):
    df = spark.createDataFrame([(None, "a", True), ("m", None, False), ("m", "a", True)], "model string, category string, correct boolean")
    got = {(r.model, r.category, r.n, r.is_total) for r in SC.scorecard_by_category(df).collect()}
    assert got == {(None, "a", 1, False), (None, "ALL", 1, True), ("m", None, 1, False), ("m", "a", 1, False), ("m", "ALL", 2, True)}


@pytest.mark.parametrize("raw, drop, want", [
    ('a,b,c\n1,"x\ny",3', ["c"], 'a,b\n1,"x\ny"'),
    ("a,,c\n1,2,3", ["c"], "a,\n1,2"),
    ("a,b\r\n1,2\r\n", ["a"], "b\n2"),
    ("a,b\n1\n", ["a"], "b\n"),
    ("", ["a"], ""),
])
def test_csv_text_probes(spark, raw, drop, want):
    got = spark.createDataFrame([(raw,)], "raw string").select(EV.project_csv_text(F.col("raw"), drop).alias("p")).first().p
    assert got == want.rstrip("\n")


def test_csv_text_of_many_columns(spark):
    names = [f"c{i}" for i in range(40)]
    raw = ",".join(names) + "\n" + ",".join(str(i) for i in range(40))
    got = spark.createDataFrame([(raw,), (None,)], "raw string").select(EV.project_csv_text(F.col("raw"), ["c0", "c39"]).alias("p"))
    rows = [r.p for r in got.collect()]
    assert rows[0] == ",".join(names[1:39]) + "\n" + ",".join(str(i) for i in range(1, 39)) and rows[1] is None


def test_json_strings_escape_every_control_character(spark):
    text = "".join(map(chr, range(0x20))) + "\x7f\"\\é"
    got = spark.createDataFrame([(text,), ("plain\n",)], "s string").select(EV.json_string(F.col("s")).alias("j")).collect()
    assert [r.j for r in got] == [json.dumps(text, ensure_ascii=False), json.dumps("plain\n")]


def _fingerprint(spark, rows, schema):
    return CT.table_fingerprint(spark.createDataFrame(rows, schema), "t").first().fingerprint


def test_fingerprints_tell_near_misses(spark):
    two = "a string, b string"
    assert _fingerprint(spark, [("x|y", "z")], two) != _fingerprint(spark, [("x", "y|z")], two)
    assert _fingerprint(spark, [(None, "z")], two) != _fingerprint(spark, [("N", "z")], two)
    seen = {_fingerprint(spark, [(v,)], "v double") for v in (1e14, float("nan"), float("inf"), 0.1, 0.1 + 1e-12, -0.1, None, 3e30)}
    assert len(seen) == 8


def test_every_double_has_its_own_exact_image(spark):
    import math
    import random
    import struct
    rng = random.Random(9)
    values = [0.0, 1e-20, 1e-300, 5e-324, 1e-323, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 1e37, 1e38, 3e30,
              0.1, 0.1 + 1e-17 * 3, math.nextafter(1, 0), math.nextafter(1, 2), -1e-300, math.inf, -math.inf, math.nan]
    values += [s * math.ldexp(1, k) for k in range(-1074, 1024, 37) for s in (1, -1)]
    values += [math.nextafter(math.ldexp(1, k), 0) for k in range(-1070, 1024, 41)]
    values += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    got = {struct.pack("<d", r.v): r.i for r in CT.with_images(df, {"i": "v"}).collect()}
    for v, image in ((struct.unpack("<d", k)[0], i) for k, i in got.items()):
        bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert image == (2047 * 2 ** 52 + 1 if math.isnan(v) else -bits if v < 0 else bits), v
    order = sorted((v for v in values if not math.isnan(v)), key=lambda v: (v, 0))
    assert [got[struct.pack("<d", v)] for v in order] == sorted(got[struct.pack("<d", v)] for v in order)
    texts = {r.t for r in df.select(F.expr(CT.double_text("v")).alias("t")).collect()}
    assert len(texts) == len({v + 0.0 for v in values if not math.isnan(v)}) + 1
    zero = {_fingerprint(spark, [(v,)], "v double") for v in (0.0, 1e-20, 1e-300, 5e-324, 1e37, 1e38, -1e38, 1e300)}
    assert len(zero) == 8 and _fingerprint(spark, [(0.0,)], "v double") == _fingerprint(spark, [(-0.0,)], "v double")


def test_fingerprint_follows_added_and_removed_rows(spark):
    schema = "k long, s string, d double, ts timestamp, a array<double>, w array<string>"
    import datetime
    rows = [(i, f"s{i}" if i % 3 else None, i / 7 if i % 4 else None, datetime.datetime(2024, 1, 1 + i % 28), [i / 3, None], ["a", None, str(i)])
            for i in range(60)] + [(1, None, None, None, None, None)] * 3
    frame = lambda r: CT.table_fingerprint(spark.createDataFrame(r, schema).repartition(3), "t")
    stored = frame(rows)
    gone, fresh = rows[5:9] + rows[-1:], [(7, "new", 1e-300, None, [], [])] * 2
    now = [r for r in rows if r not in gone] + [rows[-1]] * 2 + fresh
    want = frame(now).first()
    got = CT.combined(stored, frame(fresh), frame(gone)).first()
    assert (got.n_rows, got.fingerprint) == (want.n_rows, want.fingerprint) and got.n_rows == 60
    assert CT.combined(stored, stored, stored).first().fingerprint == stored.first().fingerprint
    none = frame([]).first()
    assert (none.n_rows, none.fingerprint) == (0, "0:0")
    parts = CT.fingerprint_by(spark.createDataFrame(rows, schema).withColumn("part", F.col("k") % 4), ["part"])
    whole = CT.table_fingerprint(spark.createDataFrame(rows, schema).withColumn("part", F.col("k") % 4), "t").first()
    total = CT.combined(parts.select(F.lit("t").alias("table_name"), "n_rows", "fingerprint")).first()
    assert (total.n_rows, total.fingerprint) == (whole.n_rows, whole.fingerprint)


def test_row_count_rules(spark, catalog):
    assert all(r.ok for r in CT.row_count_contract(catalog).collect())
    CT.check_row_counts(catalog)
    with pytest.raises(ValueError, match="nation has 25"):
        CT.check_row_counts(catalog, {"nation": (None, 24, 24, 0)})


def test_csv_with_other_header_fails(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a\n1,2\n")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    with pytest.raises(Exception, match="(?i)header"):
        TB.read_csv_table(spark, str(tmp_path / "t.csv"), schema).collect()


def test_bootstrap_has_one_method_at_any_size(spark):
    counts = spark.createDataFrame([("c", 24, 20, 1, 2)], "challenger string, m long, c11 long, c10 long, c01 long")
    assert CMP.bootstrap_table(counts, 50, 1).count() == 1
    with pytest.raises(ValueError):
        CMP.bootstrap_table(counts, 50, 1, "auto")


class _Cluster:
    """A session whose master is not local."""

    def __init__(self, spark, shared="false"):
        self.conf = type("C", (), {"get": staticmethod(lambda k, d=None: shared if "sharedMount" in k else d)})()
        self.sparkContext = type("S", (), {"master": "spark://host:7077", "_jsc": spark.sparkContext._jsc})()


def test_machine_local_checkpoint_folder_is_refused_on_a_cluster(spark):
    for folder in ("file:///tmp/x", "/tmp/x"):
        with pytest.raises(RuntimeError):
            session._refuse_local(_Cluster(spark), folder)
        session._refuse_local(_Cluster(spark, "true"), folder)
    session._refuse_local(_Cluster(spark), "hdfs://nn/x")
    session._refuse_local(spark, "file:///tmp/x")
