"""Incremental graph refresh.

Edges are stateless projections of their fact table, so new source files can be turned into
new edges by a file-source stream: no watermark and no state store are needed. The batch form
(``incremental_edges``) computes the same delta from a cutoff on the fact table. Source rows that
change or go need state: ``FactStore`` merges a feed of changes by key, and its edges are those of a rebuild.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.bindings import Ontology
from quarry.plans.graph import edges_from_fact
from quarry.session import materialize, release


def edges_of(fact: DataFrame, onto: Ontology, relationships: list[str]) -> DataFrame:
    """Edge projection of an arbitrary (possibly streaming) frame of one fact table, one pass."""
    return edges_from_fact(fact, onto, [onto.relationship(r) for r in relationships])


def incremental_edges(catalog, onto: Ontology, relationships: list[str], since_col: str, since: str) -> DataFrame:
    """Batch refresh delta: edges from fact rows with ``since_col >= since`` (pushed to the scan)."""
    table = {onto.relationship(r).table for r in relationships}
    if len(table) != 1:
        raise ValueError("relationships must share one fact table")
    fact = catalog.table(table.pop()).where(F.col(since_col) >= F.lit(since).cast("timestamp_ntz"))
    return edges_of(fact, onto, relationships)


def start_edge_refresh(spark: SparkSession, source_dir: str, schema, onto: Ontology, relationships: list[str],
                       sink_dir: str, checkpoint_dir: str, fmt: str = "parquet"):
    """Run the refresh as a stream: Parquet files landing in ``source_dir`` become appended edge
    files in ``sink_dir``. ``availableNow`` processes what is there and stops; the checkpoint makes
    the next run pick up only new files (exactly-once file sink)."""
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    edges = edges_of(stream, onto, relationships)
    return (edges.writeStream.format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint_dir).outputMode("append").trigger(availableNow=True).start())


# --- changed and removed source rows ----------------------------------------------------------------

class FactStore:
    """The live rows of a fact table kept up to date from a change feed, in a folder of Parquet files.

    A change row has the fact's columns, ``version`` (a larger one is later) and ``deleted``. Of each key the
    largest version stays; a deleted row stays as a tombstone, so that an older version that arrives late can't
    bring it back. Merging is thus idempotent and independent of order: a batch run again after a failure,
    a file delivered twice or a feed replayed from its begin all end in the same rows. (Two changes of one key
    and version are told apart by their columns, so the choice is the same in any order.)

    Keys are hashed to a fixed number of buckets. A merge reads and writes only the buckets its keys fall
    into, and commits by a manifest (bucket -> folder) written last; readers follow the newest manifest, and
    folders of a merge that failed before it are never looked at.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, keys: list[str], version: str = "version", deleted: str = "deleted",
                 buckets: int = 64):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.keys, self.version, self.deleted, self.buckets = keys, version, deleted, buckets
        self._values = [f.name for f in schema.fields if f.name not in {*keys, version, deleted}]

    def _manifest(self) -> tuple[int, dict[int, str]]:
        """Number of the newest manifest (-1: none) and the folder of each bucket: one row a bucket."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return -1, {}
        done = [s.getPath() for s in fs.listStatus(path)]
        done = [p.getName() for p in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        if not done:
            return -1, {}
        newest = max(done, key=int)
        rows = self.spark.read.schema("bucket int, folder string").parquet(f"{self.folder}/manifests/{newest}").collect()
        return int(newest), {r.bucket: r.folder for r in rows}

    def _held(self, folders: dict[int, str]) -> DataFrame:
        """Rows, tombstones included, of the given buckets."""
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{f}/bucket={b}" for b, f in sorted(folders.items())])

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row a key: the largest version."""
        order = F.struct(F.col(self.version), F.col(self.deleted), *[F.col(c) for c in self._values])
        best = rows.groupBy(*self.keys).agg(F.max(order).alias("_best"))
        return best.select(*[F.col(c) if c in self.keys else F.col(f"_best.{c}").alias(c) for c in self.schema.names])

    def merge(self, changes: DataFrame) -> None:
        """Merge a batch of changes and commit. Only the set of touched buckets reaches the driver."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        changes = materialize(self._latest(changes.select(*self.schema.names)), "changes")
        touched = {r.b for r in changes.select(bucket.alias("b")).distinct().collect()}
        if touched:
            number, folders = self._manifest()
            merged = self._latest(self._held({b: f for b, f in folders.items() if b in touched}).unionByName(changes))
            target = f"{self.folder}/data/{uuid.uuid4().hex}"
            merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(target)
            rows = sorted((folders | {b: target for b in touched}).items())
            (self.spark.createDataFrame(rows, "bucket int, folder string").coalesce(1)
             .write.mode("errorifexists").parquet(f"{self.folder}/manifests/{number + 1}"))
        release(changes)

    def live(self) -> DataFrame:
        """The fact's rows as of the newest commit, without tombstones and change columns."""
        rows = self._held(self._manifest()[1])
        return rows.where(~F.col(self.deleted)).drop(self.version, self.deleted)

    def edges(self, onto: Ontology, relationships: list[str]) -> DataFrame:
        """The edges of the live rows: those of a rebuild from the changed table."""
        return edges_of(self.live(), onto, relationships)

    def vacuum(self) -> None:
        """Delete data folders and manifests that the newest commit doesn't use (no reader may be at them)."""
        number, folders = self._manifest()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        used = {f.rsplit("/", 1)[-1] for f in folders.values()} | {str(number)}
        for kind in ("data", "manifests"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
            fs = path.getFileSystem(conf)
            for s in fs.listStatus(path) if fs.exists(path) else []:
                if s.getPath().getName() not in used:
                    fs.delete(s.getPath(), True)


def start_change_refresh(store: FactStore, source_dir: str, checkpoint_dir: str, fmt: str = "parquet"):
    """Run the merge as a stream: change files landing in ``source_dir`` are merged batch by batch;
    ``availableNow`` processes what is there and stops."""
    stream = store.spark.readStream.schema(store.schema).format(fmt).load(source_dir)
    return (stream.writeStream.foreachBatch(lambda batch, _: store.merge(batch)).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())
