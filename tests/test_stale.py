"""Stale truth by dependencies: unchanged tables and files aren't read, the result is that of a full rerun."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from quarry.plans import stale as ST
from quarry.plans import truth as TR
from quarry.plans.questions import QUESTIONS, Semantic
from quarry.sources import contracts as CT
from quarry.sources.tables import Catalog

from .conftest import SMOKE

NEEDED = ["customer", "lineitem", "nation", "orders", "part", "supplier"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables; lineitem in four files."""
    to = tmp_path_factory.mktemp("tables")
    for t in NEEDED:
        if t == "lineitem":
            spark.read.parquet(f"{SMOKE}/{t}.parquet").repartition(4).write.parquet(str(to / f"{t}.parquet"))
        else:
            shutil.copy(f"{SMOKE}/{t}.parquet", to / f"{t}.parquet")
    return str(to)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_dependencies_name_the_tables_read(catalog):
    needs = ST.dependencies(Semantic(catalog))
    assert needs["S01"] == {"orders"} and needs["S02"] == {"customer"} and needs["M02"] == {"lineitem", "supplier", "part"}
    assert all(needs[q.id] == set() for q in QUESTIONS if q.answer_type == "refusal")


def test_only_stale_questions_are_answered_again(spark, folder, tmp_path):
    sem = Semantic(Catalog(spark, folder))
    state = ST.table_state(sem.catalog, NEEDED)
    state.write.parquet(str(tmp_path / "state"))
    state = spark.read.parquet(str(tmp_path / "state"))
    assert state.where("table_name = 'lineitem'").count() == 4 and state.where("table_name <> 'lineitem'").count() == 5
    whole = CT.combined(state.select("table_name", "n_rows", "fingerprint"))
    assert rows_of(whole) == rows_of(CT.fingerprints(sem.catalog, NEEDED).select("table_name", "n_rows", "fingerprint"))
    TR.truth_table(sem).write.parquet(str(tmp_path / "truth"))
    truth = spark.read.parquet(str(tmp_path / "truth"))

    # nothing changed: no table is read, the stored truth stands
    again = ST.table_state(Catalog(spark, folder), NEEDED, state)
    assert not any("lineitem" in f or "supplier" in f for f in again.inputFiles())
    assert ST.changed_tables(state, again) == set() and ST.refreshed_truth(sem, truth, set()) is truth

    # the customers move, one file of lineitem is written anew with the same rows
    spark.read.parquet(f"{folder}/customer.parquet").withColumn("c_mktsegment", F.concat(F.lit("NEW "), "c_mktsegment")).coalesce(1).write.parquet(
        str(tmp_path / "customer"))
    part = next(f for f in os.listdir(tmp_path / "customer") if f.endswith(".parquet"))
    shutil.copy(tmp_path / "customer" / part, f"{folder}/customer.parquet")
    for crc in (".customer.parquet.crc",):
        if os.path.exists(f"{folder}/{crc}"):
            os.remove(f"{folder}/{crc}")
    one = next(f for f in sorted(os.listdir(f"{folder}/lineitem.parquet")) if f.endswith(".parquet"))
    os.utime(f"{folder}/lineitem.parquet/{one}", (1, 1))
    spark.catalog.clearCache()
    fresh = Semantic(Catalog(spark, folder))
    now = ST.table_state(fresh.catalog, NEEDED, state)
    read = {f.rsplit("/", 1)[-1] for f in now.inputFiles() if "/quarry-" not in f and "state" not in f}
    assert not any("orders" in f or "supplier" in f or "part.parquet" == f for f in read)
    changed = ST.changed_tables(state, now)
    assert changed == {"customer"}
    stale = {q.id for q in ST.stale_questions(fresh, changed)}
    assert "S02" in stale and "S01" not in stale and "M02" not in stale
    got = ST.refreshed_truth(fresh, truth, changed)
    assert rows_of(got.select("id", "value_text", "value_num", "n_values")) == rows_of(TR.truth_table(fresh).select("id", "value_text", "value_num", "n_values"))
    drift = {r.id for r in TR.truth_drift(truth, got).collect()}
    assert drift and drift <= stale
