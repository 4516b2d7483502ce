"""Exact order statistics and rankings that survive hot groups.

``order_statistics`` picks the value at a 0-based rank per group without sorting a group in
one task: values are first counted per (group, value) with partial aggregation (a hot value
collapses to one row per map task), then a radix select resolves the 64-bit image of the wanted
value some bits at a time. Every window therefore sees at most ``2**radix_bits`` rows per group,
however many rows or distinct values the group has, and whatever numbers they are.
"""

from __future__ import annotations

import math
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.numbers import with_images
from quarry.session import materialize


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL (a NULL group is a group like any other); the keys
    come from the left side."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return left.join(named, cond, how).drop(*[f"_r_{c}" for c in keys])


_SIGN = -(1 << 63)


def _with_keys(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``_key``: a long whose 64 bits, read without a sign, sort as ``value`` does. Whole numbers and
    decimals of up to 18 digits are that number, doubles (and wider decimals, cast to double) their image."""
    t = df.schema[value].dataType
    if isinstance(t, (T.FloatType, T.DoubleType)) or (isinstance(t, T.DecimalType) and t.precision > 18):
        keyed = with_images(df, {"_key": value})
    elif isinstance(t, T.DecimalType):
        keyed = df.withColumn("_key", (F.col(value).cast("decimal(38,18)") * F.lit(10 ** t.scale).cast("decimal(19,0)")).cast("long"))
    elif isinstance(t, T.IntegralType):
        keyed = df.withColumn("_key", F.col(value).cast("long"))
    else:
        raise TypeError(f"{value} is no number: {t.simpleString()}")
    return keyed.withColumn("_key", F.col("_key").bitwiseXOR(F.lit(_SIGN)))


def order_statistics(df: DataFrame, by: list[str], value: str,
                     picks: dict[str, Callable[[Column], Column]], radix_bits: int = 12) -> DataFrame:
    """Per group, the value at each 0-based rank ``picks[name](n)`` where n is the group size.

    Returns ``by + [n] + list(picks)``. Exact (no interpolation), for any numbers: the value v with
    ``count(< v) <= rank < count(<= v)``; -0.0 counts as 0.0, NaN follows all numbers, NULLs don't count.

    Radix select: values are counted per (group, value) once (written to the checkpoint folder), then
    the bits below those that all values of a group share are resolved ``radix_bits`` at a time. At
    each level only the values whose higher bits match the prefix found so far are counted per next
    digit, and the digit holding the wanted rank is kept. Every window sees at most ``2**radix_bits`` rows;
    the number of levels is fixed by the first bit in which values of a group differ, 6 at most.
    """
    keyed = _with_keys(df.where(F.col(value).isNotNull()).select(*by, value), value)
    # -0.0 and 0.0 have one image and NaNs have one: one value stands for them
    hist = materialize(keyed.groupBy(*by, "_key").agg(F.count(F.lit(1)).alias("_c"), F.max(value).alias("_value")), "radix-hist")
    low, high = (f(F.col("_key").bitwiseXOR(F.lit(_SIGN))).bitwiseXOR(F.lit(_SIGN)) for f in (F.min, F.max))
    sizes = materialize(hist.groupBy(*by).agg(F.sum("_c").alias("n"), low.alias("_low"), high.alias("_high")), "radix-sizes")
    differ = F.col("_low").bitwiseXOR(F.col("_high"))
    bits = sizes.agg(F.max(F.when(differ < 0, 64).otherwise(F.length(F.bin(differ)))).alias("b")).first().b or 1
    levels = max(1, math.ceil(bits / radix_bits))

    def above(c: Column, shift: int) -> Column:
        return F.lit(0).cast("long") if shift >= 64 else F.shiftrightunsigned(c, shift)

    state = sizes.select(*by, "n", "_low", F.explode(F.array(*[
        F.struct(F.lit(name).alias("_pick"), fn(F.col("n")).cast("long").alias("_rank")) for name, fn in picks.items()
    ])).alias("_t")).select(*by, "n", "_t._pick", "_t._rank", above(F.col("_low"), radix_bits * levels).alias("_prefix"),
                            F.lit(0).cast("long").alias("_base"))
    mask = (1 << radix_bits) - 1
    for level in range(levels):
        shift = radix_bits * (levels - level - 1)
        cand = (join_same(hist, state, by).where(above(F.col("_key"), shift + radix_bits) == F.col("_prefix"))
                .withColumn("_digit", above(F.col("_key"), shift).bitwiseAND(F.lit(mask))))
        per = cand.groupBy(*by, "n", "_pick", "_rank", "_prefix", "_base", "_digit").agg(F.sum("_c").alias("_dc"))
        w = Window.partitionBy(*by, "_pick").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        per = per.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_dc").over(w), F.lit(0)))
        chosen = per.where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_dc")))
        # one consumer per level and a handful of levels over the written histogram: no write needed
        state = chosen.select(*by, "n", "_pick", "_rank", F.shiftleft(F.col("_prefix"), radix_bits).bitwiseOR(F.col("_digit")).alias("_prefix"),
                              F.col("_before").alias("_base"))
    found = join_same(hist, state.withColumnRenamed("_prefix", "_key"), [*by, "_key"])
    return found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("_pick") == name, F.col("_value"))).alias(name) for name in picks])


def upper_median(n: Column) -> Column:
    """sorted[n // 2]."""
    return F.floor(n / 2)


def index_rank(p: float) -> Callable[[Column], Column]:
    """sorted[min(n - 1, int(p * n))] with the product taken in double precision."""
    return lambda n: F.least(n - 1, F.floor(F.lit(float(p)) * n))


def last_rank(n: Column) -> Column:
    return n - 1


def top_k_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Top-k per group with ``row_number() <= k``.

    Spark plans this with a partial WindowGroupLimit before the shuffle, so each map task ships
    at most k rows per group: a hot group costs k x #tasks rows at the final window, not its size.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def rank_within_groups(df: DataFrame, by: list[str], order: list[Column], rank_col: str = "rank",
                       num_partitions: int | None = None) -> DataFrame:
    """Full 1-based row number per group, without putting a group in one task.

    The frame is range-partitioned on ``by + order`` (sampled boundaries split a hot group over
    many tasks; ``order`` must end in a unique tiebreak). Each task numbers its own rows, per-task
    row counts (one row per task) give global offsets, and a row's rank is its global position
    minus the position of its group's first row.
    """
    keys = [F.col(c) for c in by] + order
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # (task, place in the task) of the sorted rows in one number: the range shuffle is the only one of
    # the rows; written, because counts and positions both read it
    spot = F.monotonically_increasing_id()
    local = materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_spot", spot), "ranked")
    task, place = F.shiftright(F.col("_spot"), 33), F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = (local.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
              .select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    # one row per task of the range shuffle
    pos = local.withColumn("_task", task).join(F.broadcast(starts), "_task").withColumn("_g", F.col("_start") + place)
    first = pos.groupBy(*by).agg(F.min("_g").alias("_g0"))
    return (join_same(pos, first, by).withColumn(rank_col, F.col("_g") - F.col("_g0") + 1)
            .drop("_task", "_start", "_spot", "_g", "_g0"))
