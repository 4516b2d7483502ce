"""Stale truth by dependencies (D5): only questions whose tables changed are answered again.

A state has one row per part of a table: its files' names, lengths and times, and the multiset hash of its
rows (``contracts.fingerprint_by``). Files are listed without being read; a part whose files are the same
keeps its hash, and only parts with other files are read again. Parts add up to tables, so a table that was
merely written anew counts as unchanged. What a question depends on is recorded while its plan is built:
the tables it asks the catalog for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.questions import QUESTIONS, Question, Semantic
from quarry.plans.truth import SnapshotCatalog, truth_drift, truth_table
from quarry.session import materialize
from quarry.sources import contracts as CT
from quarry.sources.tables import TABLES

STATE = "table_name string, part string, files string, n_rows long, fingerprint string"


class RecordingCatalog:
    """A catalog that notes the tables it is asked for."""

    def __init__(self, catalog):
        self._c = catalog
        self.spark, self.sf_dir = catalog.spark, catalog.sf_dir
        self.asked: set[str] = set()

    def table(self, name: str) -> DataFrame:
        self.asked.add(name)
        return self._c.table(name)

    def __getattr__(self, name: str):
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def dependencies(sem: Semantic, questions: list[Question] | None = None) -> dict[str, set[str]]:
    """question id -> names of the tables its plan reads. Plans are built, none is run."""
    out = {}
    for q in questions or QUESTIONS:
        seen = RecordingCatalog(sem.catalog)
        if q.answer_type != "refusal" and q.build is not None:
            q.build(Semantic(seen, sem.onto))
        out[q.id] = seen.asked
    return out


def part_files(catalog, tables: list[str]) -> DataFrame:
    """(table_name, part, files): the files of each part of each table. A part is a file, named without the
    folder; ``files`` holds its length and time. Only listings are read, no contents."""
    listed = []
    for t in tables:
        path = f"{catalog.sf_dir}/{t}.parquet"
        files = catalog.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        name = F.element_at(F.split("path", "/"), -1)
        listed.append(files.select(F.lit(t).alias("table_name"), name.alias("part"),
                                   F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).alias("files")))
    every = reduce(DataFrame.unionByName, listed)
    return every.where(F.lower("part").endswith(".parquet"))


def table_state(catalog, tables: list[str] | None = None, stored: DataFrame | None = None) -> DataFrame:
    """The state of ``tables``. With the ``stored`` state of an earlier time, parts whose files are as they were are
    taken from it, and only the others are read (nothing at all, if there are none)."""
    tables = sorted(tables or TABLES)
    spark = catalog.spark
    now = materialize(part_files(catalog, tables), "state-files")
    old = spark.createDataFrame([], STATE) if stored is None else stored.where(F.col("table_name").isin(tables))
    known = now.join(old, ["table_name", "part", "files"], "left").select("table_name", "part", "files", "n_rows", "fingerprint")
    known = materialize(known, "state-known")
    # names of changed files, table by table: the files to read, which only the driver can hand to a reader
    fresh: dict[str, list[str]] = {}
    for r in known.where("fingerprint IS NULL").select("table_name", "part").toLocalIterator():
        fresh.setdefault(r.table_name, []).append(r.part)
    parts = []
    for t, names in fresh.items():
        rows = catalog.table(t).withColumn("_part", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        rows = rows.where(F.col("_part").isin(names))
        hashed = CT.fingerprint_by(rows.drop("_part"), []) if len(names) == 1 else _by_part(rows)
        parts.append(hashed.select(F.lit(t).alias("table_name"), F.lit(names[0]).alias("part") if len(names) == 1 else "part", "n_rows", "fingerprint"))
    kept = known.where("fingerprint IS NOT NULL")
    if not parts:
        return kept
    read = reduce(DataFrame.unionByName, parts)
    # a file without rows has no group
    missing = known.where("fingerprint IS NULL").drop("n_rows", "fingerprint").join(read, ["table_name", "part"], "left")
    missing = missing.select("table_name", "part", "files", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("fingerprint", F.lit("0:0")).alias("fingerprint"))
    return kept.unionByName(missing)


def _by_part(rows: DataFrame) -> DataFrame:
    cols = [c for c in rows.columns if c != "_part"]
    digests = CT.row_digests(rows.select(*cols, "_part"), by=["_part"], cols=cols)
    return CT.summed(digests, ["_part"]).withColumnRenamed("_part", "part")


def changed_tables(stored: DataFrame, now: DataFrame) -> set[str]:
    """Names of the tables whose rows differ between two states (tables of one state alone included)."""
    def whole(state: DataFrame, name: str) -> DataFrame:
        sums = CT.combined(state.select("table_name", "n_rows", "fingerprint"))
        return sums.select("table_name", F.concat_ws("/", F.col("n_rows").cast("string"), "fingerprint").alias(name))

    both = whole(stored, "was").join(whole(now, "is"), "table_name", "full_outer")
    return {r.table_name for r in both.where(~F.col("was").eqNullSafe(F.col("is"))).select("table_name").collect()}


def stale_questions(sem: Semantic, changed: set[str], questions: list[Question] | None = None) -> list[Question]:
    needs = dependencies(sem, questions)
    return [q for q in questions or QUESTIONS if needs[q.id] & changed]


def refreshed_truth(sem: Semantic, stored: DataFrame, changed: set[str], questions: list[Question] | None = None) -> DataFrame:
    """The truth table with the questions that depend on ``changed`` answered again and the others' rows taken
    from ``stored``: the same rows as ``truth_table``, unchanged tables read only beside changed ones."""
    stale = stale_questions(sem, changed, questions)
    if not stale:
        return stored
    fresh = truth_table(sem, stale)
    return stored.where(~F.col("id").isin([q.id for q in stale])).select(*fresh.columns).unionByName(fresh)


def drift_between(sem: Semantic, filters: dict[str, str]) -> DataFrame:
    """D5 against an earlier state of the tables given by ``filters`` (table -> condition its rows met): the
    drift rows of ``truth_drift``. Questions that read none of these tables can't have changed and are not asked."""
    stale = stale_questions(sem, set(filters))
    if not stale:
        return truth_drift(truth_table(sem), truth_table(sem)).limit(0)
    before = Semantic(SnapshotCatalog(sem.catalog, filters), sem.onto)
    return truth_drift(truth_table(before, stale), truth_table(sem, stale))
