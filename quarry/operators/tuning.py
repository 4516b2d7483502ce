"""Tuning-log analytics (I1-I8): replay the adopt gate over logged candidates, many runs at once.

The gate is a fold: a candidate is judged against the best so far, and the best moves only on adoption.
An adopted candidate beats the best in train objective and DEV objective, and holds its train
negatives; this order is transitive, so a stretch of a run can be summed up without knowing the best it
will start from. Of a block of steps only its *records* can be the first adoption, whatever the best
before: steps that no earlier step of the block equals or passes in all three figures. Each record
knows the best that the block ends with if it is the first adoption. The replay is a segmented
prefix scan in three passes: mark the records of all blocks, carry each run's best over its records from
block to block, then label the steps of each block from the best it starts with. The log is written
once, however many adoptions there are, and no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.order_stats import join_same, rank_within_groups, top_k_per_group
from quarry.session import materialize, release

CAND_COLS = ["run_id", "step_ts", "cid", "train_acc", "train_tokens", "train_neg", "dev_acc", "dev_tokens", "dev_neg"]
#: the figures that a best is known by
BEST = ["cid", "train_acc", "train_tokens", "train_neg", "dev_acc", "dev_tokens"]
#: steps of a block
BLOCK = 512


def objective_gt(acc: Column, tokens: Column, best_acc: Column, best_tokens: Column) -> Column:
    """Lexicographic (accuracy up, then tokens down) strictly better."""
    return (acc > best_acc) | ((acc == best_acc) & (tokens < best_tokens))


def _better(a: tuple, b: tuple, strictly: bool = True) -> bool:
    """I1 for the (accuracy, tokens) pairs a and b; False where a figure is missing."""
    if None in a or None in b:
        return False
    x, y = (a[0], -a[1]), (b[0], -b[1])
    return x > y if strictly else x >= y


def _promising(c: tuple, best: tuple) -> bool:
    """``c`` and ``best`` begin with the figures of ``BEST``."""
    return c[3] is not None and best[3] is not None and c[3] >= best[3] and _better(c[1:3], best[1:3])


def _adopted(c: tuple, best: tuple, floor: bool) -> bool:
    """``floor``: DEV negatives are at least the seed's. DEV accuracy then is too: it rises along the chain."""
    return floor and _promising(c, best) and _better(c[4:6], best[4:6])


def _covers(a: tuple, b: tuple) -> bool:
    """Whatever best ``b`` is adopted over, ``a`` would be."""
    return a[3] >= b[3] and _better(a[1:3], b[1:3], False) and _better(a[4:6], b[4:6], False)


def _ends(steps: list[tuple], floors: list[bool]) -> list[tuple[int, int] | None]:
    """For each step None, or, if it is the block's first step or a record, the step that the chain of
    adoptions begun with it ends with and the number of adoptions after it."""
    records: list[tuple] = []
    known: dict[int, tuple[int, int]] = {}

    def end(i: int) -> tuple[int, int]:
        chain = []
        while i not in known:
            after = next((j for j in range(i + 1, len(steps)) if _adopted(steps[j], steps[i], floors[j])), None)
            if after is None:
                known[i] = (i, 0)
            else:
                chain.append(i)
                i = after
        last, hops = known[i]
        for j in reversed(chain):
            hops += 1
            known[j] = (last, hops)
            i = j
        return known[i]

    out: list[tuple[int, int] | None] = []
    for i, (s, floor) in enumerate(zip(steps, floors)):
        able = floor and None not in s[1:6]
        record = able and not any(_covers(r, s) for r in records)
        if record:
            records.append(s)
        out.append(end(i) if record or i == 0 else None)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[list[tuple]]:
    """Runs of rows equal in their first ``keys`` columns (at most ``most`` rows each), over batch ends."""
    now: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if now and (row[:keys] != now[0][:keys] or len(now) == most):
                yield now
                now = []
            now.append(row)
    if now:
        yield now


def _to_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield out()
            held = []
    if held:
        yield out()


def _map(df: DataFrame, schema: str, rows) -> DataFrame:
    """``df`` mapped by ``rows`` (record batches -> tuples) to ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    kinds = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return df.mapInArrow(lambda batches: _to_batches(rows(batches), kinds), schema)


def replay_adopt_gate(cands: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(run_id, cid, step_ts, promising, adopted, parent_cid, depth, train_acc, dev_acc, dev_tokens)``
    for every logged step.

    promising = train objective > best's AND train negatives >= best's;
    adopted = promising AND DEV objective > best's AND DEV accuracy >= seed's AND DEV negatives >= seed's.
    The first step of a run (by ``(step_ts, cid)``) is the seed (adopted, depth 0). A missing figure
    passes no comparison; a NULL run is a run like any other.
    """
    n = int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = {f.name: f.dataType.simpleString() for f in cands.schema.fields}
    c = cands.select(*CAND_COLS)
    seeds = c.groupBy("run_id").agg(F.min(F.struct("step_ts", "cid", "dev_neg")).alias("s")).select("run_id", F.col("s.dev_neg").alias("_floor"))
    c = join_same(c, seeds, ["run_id"]).withColumn("_ok", F.coalesce(F.col("dev_neg") >= F.col("_floor"), F.lit(False)))
    order = ["run_id", "step_ts", "cid"]
    dealt = c.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_spot", F.monotonically_increasing_id())

    def mark(batches):
        for rows in _groups(batches, 1, block):
            steps = [r[2:8] for r in rows]
            for r, e in zip(rows, _ends(steps, [r[8] for r in rows])):
                yield (*r, rows[0][9], *((None,) * 7 if e is None else (*steps[e[0]], e[1])))

    head = ["run_id", "step_ts", *BEST]
    ends = ", ".join([f"x_{c} {types[c]}" for c in BEST])
    columns = ", ".join(f"{c} {types[c]}" for c in head) + ", _ok boolean, _spot long"
    log = materialize(_map(dealt.select(*head, "_ok", "_spot"), f"{columns}, _block long, {ends}, x_hops int", mark), "replay-log")

    def carry(batches):
        """The best that each block starts with, run by run over the records alone."""
        run, best, depth, now = None, None, 0, None
        for row in (r for group in _groups(batches, 1, 4096) for r in group):
            key, at, figures, floor, end = row[0], row[1], row[2:8], row[8], row[9:15]
            if best is None or key != run:
                run, best, depth, now, adopted = key, None, 0, None, False
            if at != now:
                now, adopted = at, False
                yield (at, *(best or (None,) * 6), None if best is None else depth)
            if best is None:
                best, depth, adopted = end, row[15], True
            elif not adopted and _adopted(figures, best, floor):
                best, depth, adopted = end, depth + 1 + row[15], True

    records = log.where("x_hops IS NOT NULL").select("run_id", "_block", *BEST, "_ok", *[f"x_{c}" for c in BEST], "x_hops", "_spot")
    records = records.repartition(n, "run_id").sortWithinPartitions("run_id", "_spot").drop("_spot")
    states = materialize(_map(records, "_block long, " + ", ".join(f"b_{c} {types[c]}" for c in BEST) + ", b_depth int", carry), "replay-states")

    def label(batches):
        for rows in _groups(batches, 1):
            best, depth = rows[0][10:16], rows[0][16]
            for r in rows:
                step, floor = r[3:9], r[9]
                if depth is None:
                    best, depth = step, 0
                    yield (r[1], step[0], r[2], True, True, None, 0, step[1], step[4], step[5])
                    continue
                promising, adopted = _promising(step, best), _adopted(step, best, floor)
                yield (r[1], step[0], r[2], promising, adopted, best[0], depth + adopted, step[1], step[4], step[5])
                if adopted:
                    best, depth = step, depth + 1

    whole = log.select("_block", *head, "_ok", "_spot").repartition(n, "_block").join(states, "_block")
    whole = whole.select("_block", *head, "_ok", *[f"b_{c}" for c in BEST], "b_depth", "_spot").sortWithinPartitions("_block", "_spot")
    out = _map(whole.drop("_spot"), f"run_id {types['run_id']}, cid {types['cid']}, step_ts {types['step_ts']}, promising boolean, adopted boolean, "
               f"parent_cid {types['cid']}, depth int, train_acc {types['train_acc']}, dev_acc {types['dev_acc']}, dev_tokens {types['dev_tokens']}", label)
    out = materialize(out, "replay")
    release(log, states)
    return out


def candidate_ranking(replay: DataFrame, cands: DataFrame | None = None) -> DataFrame:
    """Validated (DEV-evaluated = promising) candidates ranked by DEV objective, stable by step."""
    v = replay.where("promising").select("run_id", "cid", "step_ts", "dev_acc", "dev_tokens")
    r = rank_within_groups(v, ["run_id"], [F.col("dev_acc").desc(), F.col("dev_tokens").asc(), F.col("step_ts").asc(),
                                           F.col("cid").asc()], "rank")
    return r.select("run_id", "cid", "dev_acc", "dev_tokens", F.col("rank").cast("long").alias("rank"))


def candidate_lineage(replay: DataFrame) -> DataFrame:
    """I4: the adopted chain of every run: each adopted candidate with its parent and depth."""
    return replay.where("adopted").select("run_id", "cid", "parent_cid", "depth")


def recent_rejects(replay: DataFrame, k: int = 6) -> DataFrame:
    """The last k rejected edits of every run (most recent first)."""
    rej = replay.where(~F.col("adopted"))
    return top_k_per_group(rej, ["run_id"], [F.col("step_ts").desc(), F.col("cid").desc()], k, "rank").select(
        "run_id", "cid", "rank")


def overfit_gap(replay: DataFrame, cands: DataFrame | None = None) -> DataFrame:
    """I8: the final winner of every run and its DEV-minus-train accuracy gap (one grouped pass)."""
    win = replay.where("adopted").groupBy("run_id").agg(
        F.max(F.struct("depth", "cid", "train_acc", "dev_acc")).alias("w"))
    return win.select("run_id", F.col("w.cid").alias("winner_cid"), F.col("w.depth").alias("depth"),
                      F.col("w.train_acc").alias("train_acc"), F.col("w.dev_acc").alias("dev_acc"),
                      (F.col("w.dev_acc") - F.col("w.train_acc")).alias("gap"))


def top_costly(tasks: DataFrame, by: str = "model", k: int = 3) -> DataFrame:
    """The k most token-expensive tasks per run (ties: lower task id first)."""
    t = tasks.withColumn("tokens", F.col("input_tokens") + F.col("output_tokens"))
    return top_k_per_group(t, [by], [F.col("tokens").desc(), F.col("task_id").asc()], k, "rank").select(
        by, "task_id", "tokens", "rank")
