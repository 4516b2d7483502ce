"""Skew-safe order statistics and rankings vs brute force, including a hot group and a hot value."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.order_stats import (index_rank, last_rank, order_statistics, rank_within_groups,
                                          top_k_per_group, upper_median)


def _data(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 != 0 else f"g{i % 7}"          # two thirds of rows in one group
        v = 500 if i % 5 == 0 else rnd.randint(0, 100000)  # one value repeated many times
        rows.append((i, g, v))
    return rows, spark.createDataFrame(rows, "id long, g string, v long")


def test_order_statistics_exact(spark):
    rows, df = _data(spark)
    got = {r.g: (r.n, r.p50, r.p95, r.max) for r in order_statistics(
        df, ["g"], "v", {"p50": upper_median, "p95": index_rank(0.95), "max": last_rank}, radix_bits=8).collect()}
    groups = {}
    for _, g, v in rows:
        groups.setdefault(g, []).append(v)
    for g, vs in groups.items():
        vs.sort()
        n = len(vs)
        assert got[g] == (n, vs[n // 2], vs[min(n - 1, int(0.95 * n))], vs[-1])


def test_rank_within_groups_matches_sort(spark):
    rows, df = _data(spark)
    got = {r.id: r.rank for r in rank_within_groups(df, ["g"], [F.col("v").desc(), F.col("id").asc()], num_partitions=6)
           .collect()}
    groups = {}
    for i, g, v in rows:
        groups.setdefault(g, []).append((-v, i))
    for g, items in groups.items():
        for rank, (_, i) in enumerate(sorted(items), 1):
            assert got[i] == rank


def test_top_k_per_group(spark):
    rows, df = _data(spark)
    got = sorted((r.g, r.id) for r in top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 3).collect())
    exp = []
    groups = {}
    for i, g, v in rows:
        groups.setdefault(g, []).append((-v, i))
    for g, items in groups.items():
        exp += [(g, i) for _, i in sorted(items)[:3]]
    assert got == sorted(exp)


def test_radix_order_statistics_exact(spark):
    rows, df = _data(spark)
    rows += [(10 ** 6 + i, "wide", v) for i, v in enumerate([-5, 0, 7, 7, 2 ** 40, 2 ** 40 + 3, 123456789])]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    got = {r.g: (r.n, r.p50, r.p95, r.max, r.min) for r in order_statistics(
        df, ["g"], "v", {"p50": upper_median, "p95": index_rank(0.95), "max": last_rank, "min": lambda n: n * 0},
        radix_bits=8).collect()}
    groups = {}
    for _, g, v in rows:
        groups.setdefault(g, []).append(v)
    for g, vs in groups.items():
        vs.sort()
        n = len(vs)
        assert got[g] == (n, vs[n // 2], vs[min(n - 1, int(0.95 * n))], vs[-1], vs[0]), g


def test_batch_reducers_match_brute_force(spark):
    """plans.batch: every reducer against plain Python on rows with NULL members and values."""
    from pyspark.sql import functions as F

    from quarry.plans.batch import BatchQuestion as BQ
    from quarry.plans.batch import evaluate

    rows = [(i, ["a", "b", None, "c"][i % 4] if i % 7 else None, float(i % 5) if i % 6 else None, i % 3)
            for i in range(200)]
    df = spark.createDataFrame(rows, "id long, m string, v double, g int")
    c = F.col
    qs = [BQ("cnt", "count", c("g") == 1), BQ("cd", "count_distinct", member=c("m")),
          BQ("set", "set", c("g") == 2, member=c("m")), BQ("avg", "avg", value=c("v")),
          BQ("max", "max", c("g") == 0, value=c("v")), BQ("top", "top1", member=c("m")),
          BQ("setl", "set", c("g") == 0, member=c("id") % 10), BQ("empty", "count", c("g") == 9)]
    got = {}
    for r in evaluate(df, qs).collect():
        got.setdefault(r.id, []).append(r)
    ms = [r[1] for r in rows]
    vs = [r[2] for r in rows if r[2] is not None]
    assert got["cnt"][0].value_num == sum(1 for r in rows if r[3] == 1)
    assert got["cd"][0].value_num == len({m for m in ms if m is not None})
    assert sorted(x.value_text for x in got["set"]) == sorted({r[1] for r in rows if r[3] == 2 and r[1] is not None})
    assert got["avg"][0].value_num == round(sum(vs) / len(vs), 2)
    assert got["max"][0].value_num == max(r[2] for r in rows if r[3] == 0 and r[2] is not None)
    counts = {}
    for m in ms:
        counts[m] = counts.get(m, 0) + 1
    best = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0] is None, kv[0] or ""))[0][0]
    assert got["top"][0].value_text == best
    assert sorted(x.value_text for x in got["setl"]) == sorted({str(r[0] % 10) for r in rows if r[3] == 0})
    assert got["empty"][0].value_num == 0.0     # nothing matched: a count is 0, as COUNT(*) says


def test_percentiles_of_any_numbers(spark):
    """Seconds within one unit, ratios, signs, subnormals, infinities and NaN, decimals, the ends of a long;
    one group of a single value, one NULL group."""
    import decimal
    import math

    rng = random.Random(11)
    doubles = {"unit": [rng.random() for _ in range(900)], "signs": [rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(700)] + [0.0, -0.0],
               "tiny": [k * 5e-324 for k in range(50)], "ends": [math.inf, -math.inf, 1.0, -1.0, 2.5], "same": [0.1] * 40, None: [0.25, 0.5, 0.125]}
    longs = {"ends": [-(2 ** 63), 2 ** 63 - 1, 0, -1, 1], "near": [10 ** 15 + rng.randint(0, 9) for _ in range(300)], "same": [-7] * 9}
    money = {"a": [decimal.Decimal(rng.randint(-10 ** 6, 10 ** 6)).scaleb(-2) for _ in range(200)]}
    picks = {"p50": upper_median, "p95": index_rank(0.95), "max": last_rank, "min": lambda n: n * 0}
    for kind, groups in (("double", doubles), ("long", longs), ("decimal(12,2)", money), ("decimal(30,2)", money)):
        df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], f"g string, v {kind}").repartition(3)
        got = {r.g: (r.n, r.p50, r.p95, r.max, r.min) for r in order_statistics(df, ["g"], "v", picks).collect()}
        for g, vs in groups.items():
            s, n = sorted(vs), len(vs)
            assert got[g] == (n, s[n // 2], s[min(n - 1, int(0.95 * n))], s[-1], s[0]), (kind, g)
    last = spark.createDataFrame([("x", math.nan), ("x", 1.0), ("x", math.inf)], "g string, v double")
    assert math.isnan(order_statistics(last, ["g"], "v", {"max": last_rank}).first()["max"])
    assert order_statistics(last.limit(0), ["g"], "v", picks).count() == 0
    with pytest.raises(TypeError):
        order_statistics(spark.createDataFrame([("a", "b")], "g string, v string"), ["g"], "v", picks)
