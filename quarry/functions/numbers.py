"""Doubles as whole numbers and as exact text, written as SQL text (one call to the JVM an expression)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ONE = 1 << 52


def _bits(up: int, scale: int) -> str:
    return f"((s.e + {1022 + up}L) * {_ONE}L + cast(s.m * {float(1 << scale)!r}D as bigint))"


#: the image of s.x from its guess s.e and mantissa s.m; a guess beside the exponent is put right here
_IMAGE = (f"CASE WHEN s.x IS NULL THEN NULL WHEN isnan(s.x) THEN {2047 * _ONE + 1}L "
          f"WHEN abs(s.x) = double('Infinity') THEN cast(signum(s.x) as bigint) * {2047 * _ONE}L WHEN s.x = 0 THEN 0L "
          f"ELSE cast(signum(s.x) as bigint) * CASE WHEN s.m >= 2 THEN {_bits(1, 51)} WHEN s.m >= 1 OR s.e = -1022 THEN {_bits(0, 52)} "
          f"ELSE {_bits(-1, 53)} END END")


def double_images(array: str) -> str:
    """SQL of the images of an array of doubles: the 64 bits of each as a long that sorts as the doubles do.

    For x >= 0 the IEEE bits, else minus those of |x| (so -0.0 is 0.0; infinities and NaN follow the finite
    numbers). From floor(log2 |x|), which may be one off, and |x| / 2^that: every step is exact or put
    right, so any engine with log2 and power gets the same. Guess and mantissa are fields of a struct, made
    once a number.
    """
    guess = "cast(greatest(least(floor(log2(abs(x))), 1023), -1022) as bigint)"
    return (f"transform(transform(transform({array}, x -> struct(x AS x, {guess} AS e)), "
            f"s -> struct(s.x AS x, s.e AS e, abs(s.x) / power(2D, s.e) AS m)), s -> {_IMAGE})")


def with_images(df: DataFrame, named: dict[str, str]) -> DataFrame:
    """``df`` with a column holding the image of each named column: ``named`` maps new names to columns."""
    if not named:
        return df
    numbers = ", ".join(f"double(`{c}`)" for c in named.values())
    out = df.withColumn("_images", F.expr(double_images(f"array({numbers})")))
    return out.withColumns({name: F.get("_images", F.lit(i)) for i, name in enumerate(named)}).drop("_images")


def double_text(x: str) -> str:
    """SQL of the exact text of a double. 0 and magnitudes from 2^-10 to 2^63: whole part, colon, fraction in
    units of 2^-62 (both fit a long, no bit lies below); others by their image, from a lambda that only they run."""
    usual = f"{x} = 0 OR (abs({x}) < {2.0 ** 63!r}D AND abs({x}) >= {2.0 ** -10!r}D)"
    return (f"CASE WHEN {usual} THEN concat(string(bigint({x})), ':', string(bigint(({x} - double(bigint({x}))) * {2.0 ** 62!r}D))) "
            f"ELSE concat('b', string(get({double_images(f'array({x})')}, 0))) END")
