"""Session helpers.

Cluster settings are read from the session; local defaults are only applied when a
setting is absent (tests, bench on one machine).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quarry") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    builder = (builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator and is used as-is; if it is unset, a folder of the warehouse,
    which all machines share as well. A path that could be each machine's own disk is tried out once.
    Only in local mode, when it is unset (tests, bench), do we create a scratch folder for it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not configured and sc.master.startswith("local"):
            configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
        sc.setCheckpointDir(configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quarry-checkpoints")
        current = sc.getCheckpointDir() or configured
    try:
        _refuse_local(spark, current)
    except RuntimeError:
        # a mount that all machines share looks the same: what tasks write there tells
        if not _comes_back(spark, current):
            raise
    return current


#: folders tried out so far, by application
_TRIED: dict[tuple[str, str], bool] = {}


def _comes_back(spark: SparkSession, folder: str) -> bool:
    """Whether rows that tasks write below ``folder`` are all read back, as ``materialize`` needs. On each
    machine's own disk the driver finds no file of another machine's tasks. Tried once a folder."""
    import uuid

    sc = spark.sparkContext
    key = (sc.applicationId, folder)
    if key not in _TRIED:
        path, n = f"{folder.rstrip('/')}/quarry-probe-{uuid.uuid4().hex}", max(8, 2 * sc.defaultParallelism)
        spark.range(0, n, 1, n).write.parquet(path)
        probe = spark.read.schema("id long").parquet(path)
        _TRIED[key] = probe.count() == n
        release(probe)
    return _TRIED[key]


def _refuse_local(spark: SparkSession, folder: str) -> None:
    """On a cluster a path without a shared scheme is each machine's own disk. A mount that all
    machines share is allowed unseen by setting ``spark.quarry.checkpoint.sharedMount`` to true."""
    sc = spark.sparkContext
    if sc.master.startswith("local") or spark.conf.get("spark.quarry.checkpoint.sharedMount", "false") == "true":
        return
    scheme = folder.split(":", 1)[0] if ":" in folder else ""
    default = sc._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if scheme == "file" or (not scheme and default.startswith("file:")):
        raise RuntimeError(f"spark.checkpoint.dir {folder} is a machine-local path; name a shared folder")


def materialize(df, tag: str = "stage"):
    """Cut lineage by writing ``df`` once as Parquet under the shared checkpoint folder and reading
    it back. Unlike ``Dataset.checkpoint`` (which evaluates the plan for the count and again for
    the write) the plan runs once; the files survive executor loss."""
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/quarry-{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames) -> None:
    """Delete the folders of frames made by ``materialize`` that no later read needs. Other frames, and
    folders that hold no files, are left alone."""
    for df in frames:
        files = df.inputFiles()
        folder = files[0].rsplit("/", 1)[0] if files else ""
        if re.search(r"/quarry-[\w-]+-[0-9a-f]{32}$", folder):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
