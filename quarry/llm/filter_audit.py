"""Filter interaction audit by the potential of the removal game.

A coalition is a set of filters; its worth v(S) is the number of documents that fail a filter of S.
The potential of a game (Hart and Mas-Colell) is P(empty) = 0 and
P(S) = (v(S) + sum over i in S of P(S without i)) / |S|; the Shapley value of filter i is
P(all) - P(all without i). It is held as whole numbers Q(S) = |S|! * P(S), for which
Q(S) = (|S| - 1)! * v(S) + sum of Q(S without i), so 120 times the value is Q(all) - 5 * Q(all without i).
What a step of an order removes is v(earlier filters and this one) - v(earlier filters).
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 100, 80, 10, r"[#$%&*|]"
_SPACES = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text alone (A 1, B 2, C 4, D 8); ``text`` isn't null."""
    words = F.array_remove(F.split(text, _SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    fails = (n < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * capitals > CAPITALS_PERCENT * F.length(text), F.rlike(text, F.lit(SYMBOLS)))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just the filters of ``mask``, and
    how many of those are labelled good or toxic.

    Texts are compared by SHA-256. Copies are counted before they meet: rows of one text become one
    row per (part, labels), so neither a text nor a part that holds a third of the table makes a
    large group. A document whose doc_id is null has no label and no smaller doc_id, and is none to others.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_failures(text).alias("mask"),
                       F.sha2(text.cast("binary"), 256).alias("digest"))
    rows = written(rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")), "masks")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    named = rows.where(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left")
    none = rows.where(F.col("doc_id").isNull()).select(*rows.columns, F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    rows = named.unionByName(none).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    # of each text: its smallest doc_id with the rows that hold it, per (part, labels)
    groups = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.col("n").alias("rows")))).alias("first"))
    groups = written(groups.select("digest", "mask", "part", "good", "toxic", "n", "unnamed",
                                   F.col("first.doc_id").alias("doc_id"), F.col("first.rows").alias("rows")), "texts")
    lowest = groups.groupBy("digest").agg(F.min("doc_id").alias("lowest"))
    groups = groups.join(lowest, "digest")
    stay = F.col("unnamed") + F.when(F.col("doc_id") == F.col("lowest"), F.col("rows")).otherwise(0)
    either = groups.withColumn("x", F.explode(F.array(F.struct(F.col("mask").alias("mask"), stay.alias("n")),
                                                     F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - stay).alias("n")))))
    return either.groupBy("part", "x.mask").agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"),
                                                F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def worths(counts: DataFrame, filters: int) -> DataFrame:
    """(part, total, v, good, toxic): of each part the number of documents and, as arrays over the
    2^filters coalitions, how many documents, good ones and toxic ones a coalition removes."""
    everyone = 1 << filters
    hit = F.explode(F.sequence(F.lit(0), F.lit(everyone - 1)))
    met = F.col("mask").bitwiseAND(F.col("s")) != 0
    sums = (counts.withColumn("s", hit).groupBy("part", "s").agg(
        F.sum("n").alias("total"), *[F.sum(F.when(met, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]))
    # one row per coalition: at most 2^filters
    at = F.sort_array(F.collect_list(F.struct("s", "n", "good", "toxic")))
    packed = sums.groupBy("part").agg(F.max("total").alias("total"), at.alias("at"))
    return packed.select("part", "total", F.col("at.n").alias("v"), F.col("at.good").alias("good"), F.col("at.toxic").alias("toxic"))


def potentials(v: Column, filters: int) -> Column:
    """|S|! times the potential of every coalition S, from the array ``v`` of worths, smaller sets first."""
    ahead = F.array(*[F.lit(factorial(s.bit_count() - 1)) for s in range(1, 1 << filters)])

    def add(q: Column, s: Column) -> Column:
        without = [F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(q, s - (1 << i))).otherwise(0) for i in range(filters)]
        return F.concat(q, F.array((F.get(ahead, s - 1) * F.get(v, s) + sum(without, F.lit(0))).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("long")), add)


def steps(names: str) -> list[tuple[str, int, int, int, int]]:
    """(order, step, i, before, upto) of every step of every order; i is the filter's number, before
    and upto the coalitions of the filters applied before and after the step."""
    rows = []
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            i = names.index(name)
            rows.append(("".join(order), step, i, before, before | 1 << i))
            before |= 1 << i
    return rows


def audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of
    each step of each order of the filters ``names`` for each part of ``counts`` (part, mask, n, good, toxic).

    Shapley values are summed over all orders. No rows: no rows. Besides ``counts`` only the steps
    (5 * 120 for five filters) and arrays of 2^5 worths a part are handled.
    """
    k = len(names)
    everyone = (1 << k) - 1
    games = worths(counts, k).withColumn("q", potentials(F.col("v"), k))
    games = games.withColumn("shapley", F.array(*[F.get("q", F.lit(everyone)) - k * F.get("q", F.lit(everyone - (1 << i))) for i in range(k)]))
    games = games.withColumn("unique", F.array(*[F.get("v", F.lit(everyone)) - F.get("v", F.lit(everyone - (1 << i))) for i in range(k)]))
    # every part takes all steps: an array of fixed size, not a join
    columns = ("filter_order", "step", "i", "before", "upto")
    table = F.from_json(F.lit(json.dumps([dict(zip(columns, row)) for row in steps(names)])),
                        "array<struct<filter_order: string, step: int, i: int, before: int, upto: int>>")
    rows = games.withColumn("t", F.explode(table)).select("part", "total", "v", "good", "toxic", "shapley", "unique", "t.*")

    def more(game: str) -> Column:
        return F.get(game, F.col("upto")) - F.get(game, F.col("before"))

    return rows.select(
        "part", "filter_order", "step", (F.col("total") - F.get("v", F.col("upto"))).alias("kept"), more("v").alias("removed"),
        (F.get("v", F.expr("shiftleft(1, i)")) - more("v")).alias("redundant"), F.get("unique", F.col("i")).alias("unique_fails"),
        more("good").alias("good_lost"), more("toxic").alias("toxic_lost"), F.get("shapley", F.col("i")).alias("shapley"))
