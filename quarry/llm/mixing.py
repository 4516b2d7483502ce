"""Mixing sources to target weights by Pareto order sampling; DataFrame operations only.

Every document of a source first gets the whole copies that its target holds for sure,
floor(target / source size). The words that remain are drawn without replacement and with unequal
probability among the documents that fit into them: document i has the inclusion probability
lambda_i = min(1, c * size), c such that the expected words are the remaining words, and the rank
(u_i / (1 - u_i)) / (lambda_i / (1 - lambda_i)). The documents of smallest rank are taken up to the
first that doesn't fit. The gap that it leaves is filled from the documents behind it: by size class
(powers of two), largest first, in rank order up to the first of the class that doesn't fit. A class
then leaves less than twice its smallest document, so that two last documents, each the one whose
size comes nearest to what is left, if it does better than none, end within half the shortest
document that still fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DOC, ROW, SPACED_WORD, global_index, packed, seeded, written

WEIGHTS, MOST_COPIES, SEED = (5, 2, 1), 3, "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, weigh 5, 2, 1, 5, ...; targets share the sum of all
    sizes by weight, but stop at 3 times the source's size, and the excess goes to the others by
    weight. In order of 3 * size / weight the sources that stop are a prefix: source j stops if
    its share of what the earlier ones leave is above its limit. The windows run over one row a
    source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    w = total.withColumn("w", F.element_at(weights, ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    w = w.withColumn("most", F.col("source_size") * MOST_COPIES)
    rank = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    earlier, everything = rank.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(earlier), F.lit(0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))
    level = w.withColumn("level", F.when(weight_left > 0, left / weight_left))
    level = level.withColumn("stops", F.col("level") * F.col("w") > F.col("most"))
    # the first source that doesn't stop sets the level of all that follow
    free = F.min(F.when(~F.col("stops"), F.struct(F.col("most") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(everything)
    return level.select("source", "source_size", F.when(F.col("stops"), F.col("most").cast("double"))
                        .otherwise(free["level"] * F.col("w")).alias("target"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(key, doc_id, source, size, source_size, target, copies, taken) of every row of ``docs``
    (columns key, doc_id, source, size); taken = copies * size, copies from 0 to 3.

    Rows that repeat a key are drawn apart, each with its own number. A null source is a source of
    its own; a document without words is taken in whole copies only. No rows: no rows.
    """
    counted = written(docs.groupBy("key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "units")
    units = _numbered(counted)
    targets = written(source_targets(units.select("source", "size")), "targets")
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = written(targets.withColumnRenamed("source", "source_"), "plan")
    rows = units.join(plan, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    levels = written(_chance_levels(rows), "levels")
    rows = rows.join(levels, F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_")
    able = (F.col("size") > 0) & (F.col("size") <= F.col("rest"))
    chance = F.when(F.col("upto").isNull() | (F.col("size") > F.col("upto")), 1.0).otherwise(F.col("c") * F.col("size"))
    rows = rows.withColumn("chance", F.when(able, chance)).withColumn("u", seeded(seed, F.col("doc_id"), F.col("key"), F.col("unit")))
    rank = F.when(F.col("chance") >= 1, 0.0).when(F.col("chance") > 0, (F.col("u") / (1 - F.col("u"))) / (
        F.col("chance") / (1 - F.col("chance"))))
    rows = rows.withColumn("rank", rank).drop("chance", "u", "c", "upto")
    return _cut(rows).select("key", "doc_id", "source", "size", "source_size", "target", "copies",
                             (F.col("copies") * F.col("size")).alias("taken"))


def _chance_levels(rows: DataFrame) -> DataFrame:
    """(s_, upto, c): a document of source s_ with ``upto`` words or fewer has the chance c * size, a longer one
    1, so that the expected words are those to draw; no row where all documents that fit are needed.
    The windows run over one row a size of a source."""
    sizes = rows.where((F.col("size") > 0) & (F.col("size") <= F.col("rest"))).groupBy("source", "size").agg(
        F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"))
    # running sums from the shortest size up: what is longer is the rest of the source's words
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = F.col("n") * F.col("size")
    square = F.col("n").cast("decimal(18,0)") * (F.col("size") * F.col("size")).cast("decimal(18,0)")
    left = F.col("rest") - (F.sum(words).over(Window.partitionBy("source")) - F.sum(words).over(upto))
    sizes = sizes.withColumn("c", left / F.sum(square).over(upto).cast("double"))
    first = sizes.where((F.col("c") > 0) & (F.col("c") * F.col("size") <= 1)).groupBy("source").agg(F.max(F.struct("size", "c")).alias("x"))
    return first.select(F.col("source").alias("s_"), F.col("x.size").alias("upto"), F.col("x.c").alias("c"))


def _numbered(counted: DataFrame, step: int = 65536) -> DataFrame:
    """One row, numbered by ``unit`` from 1, for each of the ``rows`` that a row of ``counted`` stands
    for; in two steps, so that no array holds more than ``step`` numbers of a row repeated often."""
    blocks = counted.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(step).cast("long"))))
    upto = F.least(F.col("rows") - F.col("from"), F.lit(step).cast("long"))
    return blocks.withColumn("unit", F.explode(F.sequence(F.lit(1).cast("long"), upto))).withColumn(
        "unit", F.col("unit") + F.col("from")).drop("rows", "from")


def _running(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``: the running sum of size, the row included, along ``at`` for each value of ``keys``. Sums of
    blocks of neighbouring rows, then a window inside each block: a hot source spreads over tasks."""
    by = [F.col(k).alias(f"k_{k}") for k in keys]
    sums = rows.groupBy(*by, F.col("block").alias("b_")).agg(F.sum("size").alias("part"))
    earlier = Window.partitionBy(*[f"k_{k}" for k in keys]).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("part").over(earlier), F.lit(0))).drop("part")
    inside = Window.partitionBy(*keys, "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("block") == F.col("b_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    run = rows.withColumn("_in", F.sum("size").over(inside)).join(before, same)
    return run.withColumn(name, F.col("before") + F.col("_in")).drop("before", "_in", "b_", *[f"k_{k}" for k in keys])


def _cut(rows: DataFrame) -> DataFrame:
    """Adds ``copies``: the draw in rank order, the gap filled by size class, two closing documents."""
    keys = [F.col("source").asc_nulls_last(), F.col("rank").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("key"), F.col("unit")]
    at = global_index(rows, keys, "at", "ranked")
    able = F.col("rank").isNotNull()
    at = at.withColumn("block", F.floor(F.col("at") / 4096)).withColumn("class", F.when(able, F.floor(F.log2("size"))).cast("int"))
    run = _running(written(at, "blocks"), ["source"], "upto")
    run = written(run.withColumn("drawn", able & (F.col("upto") <= F.col("rest"))).drop("upto"), "drawn")
    gap = run.groupBy(F.col("source").alias("s_")).agg((F.first("rest") - F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0))).alias("gap"))
    gap = written(gap, "gaps")
    behind = run.where(able & ~F.col("drawn")).join(gap, F.col("source").eqNullSafe(F.col("s_"))).drop("s_").where(F.col("size") <= F.col("gap"))
    behind = _running(behind, ["source", "class"], "upto")
    behind = written(behind.where(F.col("upto") <= F.col("gap")).select("source", "class", "at", "upto", "gap"), "behind")
    # of each class the running sums below the gap: together fewer numbers than twice the gap has words
    sums = behind.groupBy("source", "class").agg(F.first("gap").alias("gap"), F.collect_list("upto").alias("sums"))
    sums = sums.groupBy("source").agg(F.first("gap").alias("gap"), F.sort_array(F.collect_list(F.struct("class", "sums")), asc=False).alias("classes"))

    def fill(state: Column, one: Column) -> Column:
        most = F.coalesce(F.array_max(F.filter(one["sums"], lambda x: x <= state["left"])), F.lit(0).cast("long"))
        taken = F.concat(state["taken"], F.array(F.struct(one["class"].alias("class"), most.alias("most"))))
        return F.struct((state["left"] - most).alias("left"), taken.alias("taken"))

    none = F.expr("CAST(array() AS array<struct<class: int, most: bigint>>)")
    filled = sums.select("source", F.explode(F.aggregate("classes", F.struct(F.col("gap").alias("left"), none.alias("taken")), fill)["taken"]).alias("t"))
    filled = filled.select(F.col("source").alias("s_"), F.col("t.class").alias("c_"), F.col("t.most").alias("most"))
    more = behind.join(filled, F.col("source").eqNullSafe(F.col("s_")) & (F.col("class") == F.col("c_")) & (F.col("upto") <= F.col("most")))
    run = written(run.join(more.select("at", F.lit(True).alias("fills")), "at", "left")
                  .withColumn("drawn", F.col("drawn") | F.coalesce("fills", F.lit(False))).drop("fills", "class", "block"), "filled")
    for closing in ("closed", "closed-again"):
        run = written(_close(run), closing)
    return run.withColumn("copies", F.col("whole").cast("long") + F.when(F.col("drawn"), 1).otherwise(0))


def _close(run: DataFrame) -> DataFrame:
    """Draws, in each source, the one document more that comes nearest to what is left, if it does better
    than none. A document longer than the words to draw had no chance before; it has one here."""
    gap = run.groupBy(F.col("source").alias("s_")).agg((F.first("rest") - F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0))).alias("gap"))
    last = (run.where((F.col("size") > 0) & ~F.col("drawn")).join(gap, F.col("source").eqNullSafe(F.col("s_")))
            .where(F.abs(F.col("gap") - F.col("size")) < F.abs("gap"))
            .groupBy("s_").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), F.coalesce("rank", F.lit(float("inf"))).alias("rank"), "at")).alias("x"))
            .select(F.col("x.at").alias("at"), F.lit(True).alias("closes")))
    return run.join(last, "at", "left").withColumn("drawn", F.col("drawn") | F.coalesce("closes", F.lit(False))).drop("closes")


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` repeated as often as the mix takes them, with its columns."""
    keyed = packed(docs, "doc_id", "source", "text")
    sizes = written(keyed.select(F.col(ROW).alias("key"), "doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    plan = written(mix(sizes, seed), "mix")
    plan = plan.groupBy("key").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    taken = keyed.select(ROW, DOC).join(plan.withColumnRenamed("key", ROW), ROW)
    once, more = taken.where("rows = 1"), taken.where("rows > 1").dropDuplicates([ROW])
    return once.union(more).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(f"{DOC}.*")
