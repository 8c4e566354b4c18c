"""Numeric expressions: lenient parsing, pandas-style rounding, guarded ratios
and exact money sums.  All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesledger.functions._col import as_col
from salesledger.functions.text import strip_ws

# Shape of a plain decimal number as a lenient numeric parser accepts it:
# optional sign, digits with an optional point (or a leading point), optional
# exponent.  Thousands separators, currency signs and type suffixes ('5d')
# are rejected, which a bare try_cast would not do for the suffix case.
NUMBER_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Money is summed exactly: every amount is taken to 4 decimal places (our
# inputs have at most 2, and a 2-decimal price times a 2-decimal rate has 4)
# and accumulated as a decimal, so totals do not depend on partitioning or
# on the order in which executors add them up.
MONEY_DECIMAL = "decimal(28,4)"
# What of an amount beyond 4 places is a double's own rounding.
NOISE = 1e-12


def coerce_number(c: Column | str, default: float | None = None, numeric_input: bool = False) -> Column:
    """``to_numeric(errors='coerce')`` then ``fillna(default)``.

    String input is stripped, checked against ``NUMBER_SHAPE`` and
    ``try_cast``; anything else becomes ``default``.  ANSI mode is on, so a
    plain ``cast`` would fail the job on the first bad cell.
    """
    col = as_col(c)
    if numeric_input:
        parsed = col.cast("double")
    else:
        s = strip_ws(col.cast("string"))
        parsed = F.when(s.rlike(NUMBER_SHAPE), s.try_cast("double"))
    parsed = F.when(F.abs(parsed) < F.lit(float("inf")), parsed)  # '1e999' is no number either
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def coerce_int(c: Column | str, default: int = 1, numeric_input: bool = False) -> Column:
    """Numeric coercion with an integer default, truncated toward zero."""
    parsed = coerce_number(c, None, numeric_input)
    return F.coalesce(parsed.try_cast("bigint"), F.lit(int(default)).cast("bigint"))


def round_half_even(c: Column | str, digits: int = 2) -> Column:
    """numpy-style ``round``: ``rint(x * 10^d) / 10^d``.

    0.125 → 0.12, 2.345 → 2.35, 1.005 → 1.0; Spark's ``round`` (half-up) and
    ``bround`` (half-even on the decimal form) each differ on one of these.
    """
    scale = float(10**digits)
    return F.rint(as_col(c) * F.lit(scale)) / F.lit(scale)


def round_half_up(c: Column | str, digits: int = 1) -> Column:
    """Display rounding: half away from zero, on the number's decimal digits (so
    1.45 gives 1.5, where a browser's ``toFixed`` rounds the binary value to 1.4)."""
    return F.round(as_col(c), digits)


def safe_ratio(num: Column | str, den: Column | str, default: float = 0.0) -> Column:
    """``num / den`` when ``den > 0`` else ``default`` (ANSI division by zero
    raises, and a non-positive total has no meaningful share)."""
    n, d = as_col(num), as_col(den)
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(float(default)))


def share_pct(part: Column | str, total: Column | str, digits: int = 2) -> Column:
    """Percentage of total, half-even rounded; 0.0 when the total is ≤ 0."""
    t = as_col(total)
    return F.when(t > 0, round_half_even(as_col(part).cast("double") / t.cast("double") * F.lit(100.0), digits)).otherwise(
        F.lit(0.0)
    )


def money_parts(c: Column | str) -> tuple[Column, Column]:
    """The sums that make up a total: exactly summed decimals, and as double
    what does not fit them.  Parts of groups add up (``total_of_parts``)."""
    x = as_col(c).cast("double")
    exact = x.try_cast(MONEY_DECIMAL)
    off = F.coalesce(x - exact.cast("double"), x)
    rest = F.when(F.abs(off) > F.abs(x) * NOISE, off).otherwise(F.when(x.isNotNull(), F.lit(0.0)))
    return F.sum(exact), F.sum(rest)


def total_of_parts(exact: Column | str, rest: Column | str) -> Column:
    """The total of groups whose ``money_parts`` are in two columns."""
    return F.coalesce(F.sum(exact).cast("double"), F.lit(0.0)) + F.sum(rest)


def money_total(c: Column | str) -> Column:
    """Sum of amounts as double; null for no rows.

    The part of each amount that fits ``MONEY_DECIMAL`` is summed exactly, so
    ordinary totals do not depend on order; what does not fit (beyond its
    range, or finer than 4 places) is added as double, so nothing is lost.
    """
    exact, rest = money_parts(c)
    return F.coalesce(exact.cast("double"), F.lit(0.0)) + rest


def count_total(c: Column | str) -> Column:
    """Sum of whole numbers, as a decimal: longs that add up beyond a long stay exact."""
    return F.sum(as_col(c).cast("decimal(20,0)")).cast("decimal(38,0)")


def money_sum(c: Column | str) -> Column:
    """``money_total``, 0.0 for no rows."""
    return F.coalesce(money_total(c), F.lit(0.0))
