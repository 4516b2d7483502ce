"""Corpus pipeline: toxic documents out, one of each group of near copies, benchmark passages out,
sources mixed to target weights, rows dealt to shards.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, mixing, queries, simhash, toxicity
from quarry.llm.common import table, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the severity model, fitted on the labelled ones among them, doesn't reject."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component."""
    return simhash.keep_one(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, text_crc32, law, shard, slot) of every row."""
    return queries.sharded(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("near-duplicates", near_copies_out),
    ("decontamination", leaks_out),
    ("mixing", to_target_weights),
    ("sharding", to_shards),
]

#: the severity model and the fingerprints have no SQL form; tests/llm compares run() with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
