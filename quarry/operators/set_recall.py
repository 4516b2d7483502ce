"""Recall of large answer sets (E5): all members looked for in one pass over the answer.

``functions.scoring.set_recall`` tests each member of an array apart, which suits sets of a handful. Here members come in
long form, one row each, as the truth table holds them. A task's members are dealt to chunks of bounded
size; a chunk's members make one Aho-Corasick automaton that reads the answer once and finds every member in
it, overlapping and nested ones included. So a set of any size spreads over tasks, and the work is the
answer's length a chunk plus the members' length, not their product.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scoring import norm
from quarry.session import materialize, release

#: members of an automaton
CHUNK = 50_000


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, chunk, member, position, text) sorted by task, chunk and member (the answer, whose member is NULL,
    first): the member rows with whether the answer holds them. A chunk may go on in the next batch."""
    import ahocorasick

    key, answer, places = None, "", []
    tasks, spots, texts, hits = [], [], [], []

    def chunk() -> None:
        automaton = ahocorasick.Automaton()
        for _, member, _ in places:
            if member:
                automaton.add_word(member, member)
        held = {""}
        if len(automaton):
            automaton.make_automaton()
            held |= {member for _, member in automaton.iter(answer)}
        for spot, member, text in places:
            tasks.append(key[0])
            spots.append(spot)
            texts.append(text)
            hits.append(member in held)

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(tasks, pa.string()), pa.array(spots, pa.int64()), pa.array(texts, pa.string()),
                                           pa.array(hits, pa.bool_())], ["task", "position", "value", "found"])
        for c in (tasks, spots, texts, hits):
            c.clear()
        return made

    for batch in batches:
        for task, part, member, spot, text in zip(*[c.to_pylist() for c in batch.columns]):
            if (task, part) != key:
                chunk()
                key, answer, places = (task, part), "", []
                if len(tasks) > 10_000:
                    yield out()
            if member is None:
                answer = text
            else:
                places.append((spot, member, text))
    chunk()
    yield out()


def long_set_recall(answers: DataFrame, members: DataFrame, chunk: int = CHUNK, show: int = 5) -> DataFrame:
    """E5 in long form: ``(task_id, n_expected, n_found, recall, correct, missing)`` of every row of ``answers`` (task_id,
    answer), given ``members`` (task_id, position, value; one row an expected member).

    A member counts as found if its normalised text is a substring of the normalised answer; repeated members
    count each, NULL members not at all. No members: recall 1.0. A NULL answer holds only empty members. ``missing``
    has the first ``show`` members not found, by position. Members of tasks without an answer are left out;
    task_id is unique in ``answers``.
    """
    n = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = answers.schema["task_id"].dataType
    known = members.where(F.col("value").isNotNull()).join(answers.select("task_id"), "task_id", "left_semi")
    sizes = materialize(known.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_expected")), "set-sizes")
    chunks = sizes.withColumn("chunks", F.ceil(F.col("n_expected") / chunk).cast("int"))
    dealt = known.join(chunks, "task_id").select(
        F.col("task_id").cast("string").alias("task"), F.pmod(F.xxhash64("position", "value"), F.col("chunks")).cast("int").alias("chunk"),
        norm("value").alias("member"), F.col("position").cast("long").alias("position"), F.col("value").alias("text"))
    asked = answers.join(chunks, "task_id").select(
        F.col("task_id").cast("string").alias("task"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.lit(None).cast("string").alias("member"), F.lit(None).cast("long").alias("position"), norm("answer").alias("text"))
    rows = dealt.unionByName(asked).repartition(n, "task", "chunk").sortWithinPartitions("task", "chunk", F.col("member").asc_nulls_first())
    looked = materialize(rows.mapInArrow(_found, "task string, position long, value string, found boolean"), "set-members")
    release(sizes)
    found = looked.groupBy("task").agg(F.count(F.lit(1)).alias("n_expected"), F.count_if("found").alias("n_found"))
    first = Window.partitionBy("task").orderBy("position", "value")
    lacks = looked.where("NOT found").withColumn("r", F.row_number().over(first)).where(F.col("r") <= show)
    lacks = lacks.groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("missing"))
    per = found.join(lacks, "task", "left").withColumn("task_id", F.col("task").cast(kind)).drop("task")
    out = answers.select("task_id").join(per, "task_id", "left")
    n_expected, n_found = F.coalesce("n_expected", F.lit(0)), F.coalesce("n_found", F.lit(0))
    recall = F.when(n_expected == 0, 1.0).otherwise(n_found / n_expected)
    return out.select("task_id", n_expected.alias("n_expected"), n_found.alias("n_found"), recall.alias("recall"), (recall >= 0.999).alias("correct"),
                      F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))
