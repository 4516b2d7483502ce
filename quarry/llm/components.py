"""Connected components of an undirected link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node of ``links`` (columns a, b).

    Each round takes the smallest label among a node's neighbours and then follows that label one
    step (pointer jumping), so long chains halve. Rounds are written to the checkpoint folder; links,
    labels and components stay distributed, only a count of changed labels reaches the driver.
    Self-links, repeated links and an empty table are fine; rows with a null end are no links.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node"))
                     .agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "root"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low")))
        step = (labels.join(near, "node", "left")
                .select("node", F.least("root", "low").alias("to"), F.col("root").alias("was")))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("further"))
        fresh = written(step.join(jump, "to", "left")
                        .select("node", F.least("to", "further").alias("root"), "was"), "labels")
        changed = fresh.where(F.col("root") != F.col("was")).limit(1).count()
        drop_written(labels)
        labels = fresh.select("node", "root")
        if not changed:
            drop_written(both)
            return labels
