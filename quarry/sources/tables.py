"""Table access.

Every read is lazy; Catalyst prunes columns and pushes filters into the Parquet scan,
so callers select only what they use and never read a whole row set they do not need.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarry.sources.quoted_csv import read_quoted_csv

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Catalog:
    """Names -> DataFrames for one data folder. DataFrame objects are reused, data is not cached."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @property
    def scale_factor(self) -> float | None:
        m = re.search(r"sf([0-9.]+)", os.path.basename(self.sf_dir))
        return float(m.group(1)) if m else None


# --- file formats of the evaluation inputs (declared schemas, never inferred) -----------------------

QUESTION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("answerable", T.BooleanType()),
    T.StructField("answer_type", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("sql", T.StringType()),
    T.StructField("expected_traversal", T.ArrayType(T.StringType())),
    T.StructField("notes", T.StringType()),
])

TRUTH_RECORD_SCHEMA = T.StructType([
    T.StructField("answer_type", T.StringType()),
    T.StructField("answerable", T.BooleanType()),
    T.StructField("value", T.StringType()),
    T.StructField("values", T.ArrayType(T.StringType())),
    T.StructField("count", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("expected_traversal", T.ArrayType(T.StringType())),
    T.StructField("sql", T.StringType()),
])


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """A1: CSV with a header row read against a declared schema (``true``/``false`` text -> BOOLEAN).

    A header that differs from the schema's names fails. Files are split over tasks; ``multi_line``
    says that quoted cells may hold line breaks (splits are then read as ``quoted_csv`` says).
    """
    if multi_line:
        return read_quoted_csv(spark, path, schema)
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("escape", '"').csv(path))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A3: JSON-lines question set; blank lines are skipped by the JSON reader."""
    return spark.read.schema(QUESTION_SCHEMA).json(path)


def read_truth_file(spark: SparkSession, path: str) -> DataFrame:
    """A4: one nested JSON document ``{"ground_truth": {id: record}}`` -> one row per id."""
    from pyspark.sql import functions as F

    doc_schema = T.StructType([T.StructField("ground_truth", T.MapType(T.StringType(), TRUTH_RECORD_SCHEMA))])
    doc = spark.read.schema(doc_schema).option("multiLine", True).json(path)
    return doc.select(F.explode("ground_truth").alias("id", "rec")).select("id", "rec.*")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """One source -> one table, overwritten; optional partition columns (e.g. model)."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
