"""CSV with line breaks inside quoted cells, read by many tasks (A1).

Whether a line begins inside a quoted cell depends on everything before it in its file. Each split is
therefore read once under both hypotheses, "begins a row" and "begins inside quotes": every line keeps
its state and record number under each. A scan over one row per split then tells which hypothesis
holds, and only the lines of records that span lines are shuffled, to be joined to one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import materialize

_SPLIT = ["file", "block"]
_LINE_SCHEMA = ("file string, block long, no long, line string, open0 int, open1 int, blank boolean, "
                "in0 int, in1 int, rec0 long, rec1 long")


def _after(line: Column) -> Column:
    """State after a line (1: inside quotes) if it began a row (``open0``) or inside quotes (``open1``).

    Cell by cell between commas: a cell that starts with a quote opens; a quoted cell is closed by an odd
    run of quotes, and what follows up to the comma is plain text. Quotes inside an unquoted cell mean nothing.
    """
    def step(state: Column, piece: Column) -> Column:
        opens = piece.startswith('"')
        body = F.when(state == 1, piece).when(opens, F.substring(piece, 2, (1 << 31) - 1))
        return F.when(F.coalesce(~body.rlike(r'(?<!")(?:"")*"(?!")'), F.lit(False)), 1).otherwise(0)

    both = F.aggregate(F.split(line, ",", -1), F.struct(F.lit(0).alias("open0"), F.lit(1).alias("open1")),
                       lambda s, p: F.struct(step(s["open0"], p).alias("open0"), step(s["open1"], p).alias("open1")))
    return F.when(F.contains(line, F.lit('"')), both).otherwise(
        F.struct(F.lit(0).alias("open0"), F.lit(1).alias("open1")))


def _both_ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the lines of each split and carry state and record number under both hypotheses; the lines
    of a split arrive together and in order."""
    import numpy as np

    split, carry = None, None
    for batch in batches:
        file, block = batch["file"].to_numpy(), batch["block"].to_numpy()
        cut = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for lo, hi in zip([0, *cut], [*cut, len(batch)]):
            if lo == hi:
                continue
            part = batch.iloc[lo:hi].copy()
            if (file[lo], block[lo]) != split:
                split, carry = (file[lo], block[lo]), {"no": 0, "in": [0, 1], "rec": [0, 0]}
            a, b, blank = (part[c].to_numpy() for c in ("open0", "open1", "blank"))
            at = np.arange(hi - lo)
            fixed = np.maximum.accumulate(np.where(a == b, at, -1))  # last line whose end doesn't depend on its begin
            flips = np.cumsum((a == 1) & (b == 0))
            part["no"] = carry["no"] + at
            for h in (0, 1):
                since = flips - np.where(fixed >= 0, flips[fixed], 0)
                after = np.where(fixed >= 0, a[fixed], carry["in"][h]) ^ (since & 1)
                before = np.concatenate([[carry["in"][h]], after[:-1]])
                rec = carry["rec"][h] + np.cumsum((before == 0) & ~blank)
                part[f"in{h}"], part[f"rec{h}"] = before, rec
                carry["in"][h], carry["rec"][h] = int(after[-1]), int(rec[-1])
            carry["no"] += hi - lo
            yield part[[f.split()[0] for f in _LINE_SCHEMA.split(", ")]]


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(record, header)``: the text of every record of the files under ``path``, ``header`` for a file's first.

    Records end at a line break outside quotes (``\\n`` or ``\\r\\n``); blank lines between records are
    skipped; an unclosed quote runs to the end of its file. A record must fit in one row, a file or a
    split need not. Files are read once, each split by its own task.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    lines = lines.select("*", _after(F.col("line")).alias("s")).select(
        *_SPLIT, "line", "s.open0", "s.open1", F.col("line").isin("", "\r").alias("blank"))
    # written once: the states of splits and the lines both come from the same splits, whatever is lost
    lines = materialize(lines.mapInPandas(_both_ways, _LINE_SCHEMA), "csv-lines")

    out = [F.when(F.col(f"in{h}") == 0, F.col("open0")).otherwise(F.col("open1")) for h in (0, 1)]
    ends = lines.groupBy(*_SPLIT).agg(F.max_by(F.struct(out[0].alias("e0"), out[1].alias("e1"), "rec0", "rec1"), "no").alias("z"))
    ends = ends.select(*_SPLIT, "z.*")
    # one row per split: the state before a split is that of the last split with one end for both hypotheses, flipped
    # by every split since that flips
    upto = Window.partitionBy("file").orderBy("block")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    flips = F.sum(((F.col("e0") == 1) & (F.col("e1") == 0)).cast("int")).over(upto)
    known = F.when(F.col("e0") == F.col("e1"), F.struct(F.col("e0").alias("e"), F.col("flips")))
    splits = (ends.withColumn("flips", flips)
              .withColumn("known", F.last(known, ignorenulls=True).over(before))
              .withColumn("seen", F.coalesce(F.lag("flips").over(upto), F.lit(0))))
    splits = splits.withColumn("begins", (F.coalesce(F.col("known.e"), F.lit(0))
                                          + F.col("seen") - F.coalesce(F.col("known.flips"), F.lit(0))) % 2)
    n = F.when(F.col("begins") == 0, F.col("rec0")).otherwise(F.col("rec1"))
    owner = F.last(F.when(n > 0, F.struct(F.col("block").alias("block"), n.alias("rec"))), ignorenulls=True).over(before)
    first = F.min(F.when(n > 0, F.col("block"))).over(Window.partitionBy("file"))
    splits = splits.select(*_SPLIT, "begins", owner.alias("owner"), first.alias("first"))

    here = lines.join(F.broadcast(splits), _SPLIT)  # one row per split, like the offsets of a ranking
    pick = lambda c: F.when(F.col("begins") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    here = here.select("*", pick("in").alias("inside"), pick("rec").alias("rec"))
    ends_inside = F.when(F.col("inside") == 0, F.col("open0")).otherwise(F.col("open1"))
    here = here.where(~((F.col("inside") == 0) & F.col("blank"))).select(
        "file", F.when(F.col("rec") == 0, F.col("owner.block")).otherwise(F.col("block")).alias("at"),
        F.when(F.col("rec") == 0, F.col("owner.rec")).otherwise(F.col("rec")).alias("rec"),
        "first", "block", "no", "line", ((F.col("inside") == 1) | (ends_inside == 1)).alias("many"))
    is_header = ((F.col("at") == F.col("first")) & (F.col("rec") == 1)).alias("header")
    trimmed = lambda c: F.regexp_replace(c, "\r$", "")
    single = here.where(~F.col("many")).select(trimmed(F.col("line")).alias("record"), is_header)
    joined = (here.where("many").groupBy("file", "at", "rec", "first")
              .agg(F.array_sort(F.collect_list(F.struct("block", "no", "line"))).alias("l"))  # one record, which is one row
              .select(trimmed(F.array_join(F.col("l.line"), "\n")).alias("record"), is_header))
    return single.unionByName(joined)


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1 for cells with line breaks: like ``read_csv_table``, but a file is cut into splits.

    Every file's header must hold the schema's names in order, else ``ValueError``. Short rows are
    filled with NULL, further cells are ignored, cells that don't fit their type are NULL, an empty
    unquoted cell is NULL. Files in UTF-8; compressed files have one split. No files' rows: no rows.
    """
    options = {"escape": '"', "multiLine": "true"}
    records = csv_records(spark, path)
    names = [f.name for f in schema.fields]
    # one more column than declared: a longer header is another header
    text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
    head = F.from_csv(F.ltrim(F.col("record"), F.lit("\ufeff")), text.simpleString()[len("struct<"):-1].replace(":", " "), options)
    heads = records.where("header").select(F.array(*[head[f"c{i}"] for i in range(len(names) + 1)]).alias("h"))
    same = F.array(*[F.lit(n) for n in names], F.lit(None).cast("string"))
    for odd in heads.where(F.col("h") != same).limit(1).collect():
        raise ValueError(f"header {[h for h in odd.h if h is not None]} is not {names}")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records.where(~F.col("header")).select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
