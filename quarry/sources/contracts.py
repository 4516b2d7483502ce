"""Table contracts (A7, A8): an order-insensitive content fingerprint and row-count checks.

Both are single-pass aggregations per table (no sort, no shuffle beyond the final combine).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.numbers import double_text, with_images  # noqa: F401
from quarry.session import materialize

_MOD = str(1 << 64)


def _is_number(t: T.DataType) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType))


def _text(c: str, t: T.DataType) -> str:
    if _is_number(t):
        return double_text(f"double({c})" if isinstance(t, T.FloatType) else c)
    if isinstance(t, T.TimestampNTZType):
        # wall-clock microseconds since the epoch, independent of the session time zone
        return f"string(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c}))"
    if isinstance(t, T.TimestampType):
        return f"string(unix_micros({c}))"
    if isinstance(t, T.ArrayType):
        one = double_text("v") if _is_number(t.elementType) else "md5(string(v))"
        held = f"cast({c} as array<double>)" if _is_number(t.elementType) else c
        return f"array_join(transform({held}, v -> coalesce({one}, 'N')), ',')"
    return f"string({c})"


def row_digests(df: DataFrame, by: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    """``by`` columns and the two halves (hi, lo, as decimals) of the 128-bit digest of every row
    (of its columns ``cols``, all by default).

    A cell's text (integers and strings as they are, doubles by ``double_text``, timestamps as epoch
    microseconds, arrays of numbers element by element) goes into the row with its length in bytes in
    front, a NULL as ``N``, so neighbouring cells can't be confused. Texts are a projection of their own: each
    is made once, although its length is used too. Written as SQL text: one call to the JVM a table, not
    one a function.
    """
    by, fields = by or [], [f for f in df.schema.fields if cols is None or f.name in cols]
    cells = df.select(*[F.col(c).alias(f"by_{i}") for i, c in enumerate(by)], *[F.col(f.name).alias(f"c{i}") for i, f in enumerate(fields)])
    texts = cells.selectExpr(*[f"by_{i} AS `{c}`" for i, c in enumerate(by)], *[f"{_text(f'c{i}', f.dataType)} AS _t{i}" for i, f in enumerate(fields)])
    row = ", ".join(f"coalesce(concat(string(octet_length(_t{i})), ':', _t{i}), 'N')" for i in range(len(fields)))
    hashed = texts.selectExpr(*[f"`{c}`" for c in by], f"md5(concat({row})) AS _row")
    half = "cast(conv(substring(_row, {}, 16), 16, 10) as decimal(20,0)) AS {}"
    return hashed.selectExpr(*[f"`{c}`" for c in by], half.format(1, "hi"), half.format(17, "lo"))


def _wrap(c: Column) -> Column:
    return (c % F.lit(_MOD).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")


def fingerprint_by(df: DataFrame, by: list[str]) -> DataFrame:
    """``by + (n_rows, fingerprint)``: the multiset hash of the rows of each part of a table.

    fingerprint = the two 64-bit halves of the row digests, each summed modulo 2^64. Sums don't depend on
    row order or file layout, and fingerprints of disjoint parts add up to the whole's (``combined``).
    """
    return summed(row_digests(df, by), by)


def summed(digests: DataFrame, by: list[str]) -> DataFrame:
    """``by + (n_rows, fingerprint)`` of the rows of ``row_digests``."""
    sums = digests.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
    zero = F.lit(0).cast("decimal(30,0)")
    return sums.select(*by, "n_rows", F.concat_ws(":", _wrap(F.coalesce("hi", zero)), _wrap(F.coalesce("lo", zero))).alias("fingerprint"))


def table_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """``(table_name, n_rows, fingerprint)`` of a whole table, in one pass (see ``fingerprint_by``)."""
    return fingerprint_by(df, []).select(F.lit(name).alias("table_name"), "n_rows", "fingerprint")


def combined(stored: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None,
             by: tuple[str, ...] = ("table_name",)) -> DataFrame:
    """``by + (n_rows, fingerprint)`` of stored fingerprints after rows were added and removed, from the
    fingerprints of these rows alone: the table is not read again. A changed row is removed and added."""
    parts = [x.select(*by, F.lit(sign).alias("_sign"), "n_rows", "fingerprint")
             for x, sign in ((stored, 1), (added, 1), (removed, -1)) if x is not None]
    every = reduce(DataFrame.unionByName, parts).withColumn("_half", F.split("fingerprint", ":"))
    part = lambda i: F.sum(F.element_at("_half", i).cast("decimal(20,0)") * F.col("_sign"))
    sums = every.groupBy(*by).agg(F.sum(F.col("n_rows") * F.col("_sign")).alias("n_rows"), part(1).alias("hi"), part(2).alias("lo"))
    up = lambda c: _wrap(F.pmod(F.col(c), F.lit(_MOD).cast("decimal(20,0)")))
    return sums.select(*by, "n_rows", F.concat_ws(":", up("hi"), up("lo")).alias("fingerprint"))


def fingerprints(catalog, tables: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [table_fingerprint(catalog.table(t), t) for t in tables])


# The row-count contract of the driver tables. A count lies between the anchor's count times
# the two factors (without an anchor: between the factors), and never below the floor.
ROW_COUNT_RULES: dict[str, tuple[str | None, float, float, int]] = {
    # table: anchor, smallest and largest rows an anchor row, floor
    "region": (None, 5, 5, 0), "nation": (None, 25, 25, 0),
    "customer": ("supplier", 15, 15, 0), "part": ("supplier", 20, 20, 0), "orders": ("customer", 10, 10, 0),
    "lineitem": ("orders", 4, 4, 0), "events": ("supplier", 100, 100, 0), "documents": ("supplier", 10, 10, 200),
    "embeddings": ("supplier", 2, 2, 500), "pages": ("supplier", 2.5, 2.5, 50), "benchmark": ("supplier", 0.2, 0.2, 40),
    "labels": ("documents", 0.3, 0.5, 0), "conversations": ("supplier", 4, 9, 0),
}


def row_count_contract(catalog, rules: dict[str, tuple[str | None, float, float, int]] | None = None) -> DataFrame:
    """``(table_name, actual, least, most, ok)`` for every rule; see ``check_row_counts`` to raise."""
    rules = rules or ROW_COUNT_RULES
    names = sorted(set(rules) | {r[0] for r in rules.values() if r[0]})
    counts = reduce(DataFrame.unionByName, [catalog.table(t).agg(F.count(F.lit(1)).alias("actual"))
                                           .select(F.lit(t).alias("table_name"), "actual") for t in names])
    # one row per table, read twice below (actual and anchor): written once so each table is counted once
    counts = materialize(counts, "row-counts")
    spec = catalog.spark.createDataFrame([(t, a, float(lo), float(hi), n) for t, (a, lo, hi, n) in rules.items()],
                                         "table_name string, anchor string, lo double, hi double, floor_n long")
    anchors = counts.select(F.col("table_name").alias("anchor"), F.col("actual").alias("anchor_n"))

    def bound(factor: str, whole) -> Column:
        n = whole(F.col(factor) * F.coalesce("anchor_n", F.lit(1))).cast("long")
        return F.greatest(n, F.col("floor_n"))

    exp = spec.join(anchors, "anchor", "left").select("table_name", bound("lo", F.floor).alias("least"),
                                                      bound("hi", F.ceil).alias("most"))
    return counts.join(exp, "table_name").select("table_name", "actual", "least", "most",
                                                 F.col("actual").between(F.col("least"), F.col("most")).alias("ok"))


def check_row_counts(catalog, rules: dict[str, tuple[str | None, float, float, int]] | None = None) -> None:
    """Raise if a table's row count breaks its rule (one row a broken rule reaches the driver)."""
    broken = row_count_contract(catalog, rules).where(~F.col("ok")).orderBy("table_name").collect()
    if broken:
        raise ValueError("row counts: " + "; ".join(f"{r.table_name} has {r.actual}, not {r.least} to {r.most}" for r in broken))
