"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import ensure_checkpoint_dir

#: words of the contracts: runs of anything but ASCII whitespace, and runs of letters, digits and
#: non-ASCII characters (as Java patterns)
SPACED_WORD = r"[^\x20\x09-\x0D]+"
LETTER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: bytes.translate table: A-Z in lower case, every byte outside ``LETTER_WORD`` a space
LETTER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                     for b in range(256))


#: names of the helper columns that hold a row's ``row_id`` and the whole row
ROW, DOC = "_llm_row", "_llm_doc"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet below ``spark.checkpoint.dir`` and read it back: lineage is cut
    and the files survive lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the folder of a frame made by ``written`` that nothing will read again."""
    files = df.inputFiles()
    if not files:
        return
    folder = files[0].rsplit("/", 1)[0]
    if re.search(r"/llm-[\w-]+-[0-9a-f]{32}$", folder):
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_index(df: DataFrame, keys: list[Column], name: str, tag: str) -> DataFrame:
    """``df`` written once with a gapless 0-based position ``name`` in the order of ``keys``.

    Rows are range-partitioned on the keys and the running row number, so a hot key spreads over
    tasks; inside a task ``monotonically_increasing_id`` holds (task, position), and the only
    window runs over one row per task. Rows equal in all keys take any order among themselves.
    """
    spark = df.sparkSession
    tie = F.monotonically_increasing_id()
    dealt = (df.withColumn("_tie", tie).repartitionByRange(shuffle_partitions(spark), *keys, F.col("_tie"))
             .sortWithinPartitions(*keys, F.col("_tie")).drop("_tie")
             .withColumn("_spot", F.monotonically_increasing_id()))
    dealt = written(dealt, tag)
    task, place = F.shiftright(F.col("_spot"), 33), F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
              .select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    # one row per task of the write: bounded by the number of shuffle partitions
    return (dealt.withColumn("_task", task).join(F.broadcast(starts), "_task")
            .withColumn(name, F.col("_start") + place).drop("_task", "_start", "_spot"))


def seeded(seed: str, *cols: Column) -> Column:
    """A uniform double in (0, 1) drawn by hashing ``seed`` and the columns; the same on any run and
    in any engine with md5."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    digits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(float(1 << 48))


def row_id(df: DataFrame) -> Column:
    """128 bits (32 hex digits of an md5) that name a row by all its columns: each cell's text with its
    length in front, a NULL as ``N``, so neither a NULL nor a neighbour's text is mistaken for another
    cell. Rows equal in every column have equal ids."""
    def text(f: T.StructField) -> Column:
        c = df[f.name]
        if isinstance(f.dataType, T.BinaryType):
            return F.hex(c)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.when(c.isNotNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}))
        return c.cast("string")

    cell = lambda t: F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("N"))
    return F.md5(F.concat(F.lit(""), *[cell(text(f)) for f in df.schema.fields]))


def packed(df: DataFrame, *keep: str) -> DataFrame:
    """``ROW`` (the ``row_id``), the columns ``keep``, and the whole row as the struct ``DOC``: helper columns
    then clash with no column of ``df``. ``select(f"{DOC}.*")`` unpacks it."""
    return df.select(row_id(df).alias(ROW), *[df[c] for c in keep], F.struct(*[df[c] for c in df.columns]).alias(DOC))
