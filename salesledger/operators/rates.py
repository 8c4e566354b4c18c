"""Currency rates: the rate table, refresh from a feed, conversion, and the
per-currency comparison grid.

Rates are "units per 1 INR".  The rate table is limited to the known
currencies, so it has at most ``len(KNOWN_CURRENCIES)`` rows and is always
safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The known currencies and their fallback rates (units per INR).
BASE_RATES = (
    ("INR", 1.0),
    ("USD", 0.012),
    ("EUR", 0.011),
    ("GBP", 0.0095),
    ("AED", 0.044),
    ("SGD", 0.016),
    ("JPY", 1.88),
    ("CAD", 0.016),
)
KNOWN_CURRENCIES = tuple(c for c, _ in BASE_RATES)
# Currencies shown in the comparison grid, in display order.
GRID_CURRENCIES = ("USD", "EUR", "GBP", "AED", "SGD", "JPY", "CAD")


def base_rates(spark: SparkSession) -> DataFrame:
    """The fallback rate table, built on the JVM side (no Python rows)."""
    rows = [F.struct(F.lit(c).alias("currency"), F.lit(float(r)).alias("rate")) for c, r in BASE_RATES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def refresh_rates(current: DataFrame, feed: DataFrame, order_col: str | None = None) -> DataFrame:
    """Known currencies only; take the feed's rate where it is set and
    non-zero, else keep the current one.

    Of several feed rates for a currency the last by ``order_col`` counts (the
    highest of equally late ones; rows without an order are the earliest);
    without an order column, the highest.
    """
    order = [F.col(order_col).alias("_order")] if order_col else []
    feed = feed.select(*order, F.col("currency"), F.col("rate").alias("_feed_rate")).filter(F.col("currency").isin(list(KNOWN_CURRENCIES)))
    cur = current.filter(F.col("currency").isin(list(KNOWN_CURRENCIES)))
    # one row per code, so at most len(KNOWN_CURRENCIES) rows are broadcast
    set_rates = feed.filter(~F.isnan("_feed_rate") & (F.col("_feed_rate") != 0))
    last = F.max(F.struct(*(["_order"] if order_col else []), "_feed_rate"))
    usable = set_rates.groupBy("currency").agg(last.alias("_last")).select("currency", "_last._feed_rate")
    joined = cur.join(F.broadcast(usable), "currency", "left")
    return joined.select("currency", F.coalesce("_feed_rate", "rate").alias("rate"))


def _is_code(c: str | Column) -> bool:
    return isinstance(c, str) and c in KNOWN_CURRENCIES


def convert(
    df: DataFrame,
    rates: DataFrame,
    amount_col: str = "amount",
    from_currency: str | Column = "INR",
    to_currency: str | Column = "USD",
    out_col: str = "converted",
) -> DataFrame:
    """``amount / rate[from] * rate[to]``; null for a missing or ≤ 0 amount
    or an unknown currency.

    A currency given as a code is one rate: a scalar subquery on the rate
    table, no join.  A currency given as a column is a broadcast hash join
    on the bounded rate table; the fact side is not shuffled.
    """
    r = rates.filter(F.col("currency").isin(list(KNOWN_CURRENCIES))).groupBy("currency").agg(F.max("rate").alias("rate"))
    out = df
    rate_cols = {}
    for side, cur in (("from", from_currency), ("to", to_currency)):
        name = f"_rate_{side}"
        if isinstance(cur, str) and not _is_code(cur) and cur not in df.columns:
            rate_cols[side] = F.lit(None).cast("double")  # an unknown code has no rate
        elif _is_code(cur):
            rate_cols[side] = r.filter(F.col("currency") == F.lit(cur)).select(F.max("rate")).scalar()
        else:
            key = f"_{side}"
            lookup = F.broadcast(r.select(F.col("currency").alias(key), F.col("rate").alias(name)))
            out = out.withColumn(key, cur if isinstance(cur, Column) else F.col(cur)).join(lookup, key, "left").drop(key)
            rate_cols[side] = F.col(name)
    amt = F.col(amount_col).cast("double")
    valid = amt.isNotNull() & (amt > 0) & (rate_cols["from"] > 0)
    value = F.when(valid, amt / rate_cols["from"] * rate_cols["to"])
    return out.withColumn(out_col, value).drop("_rate_from", "_rate_to")


def rates_grid(rates: DataFrame, base_amount: float = 100.0) -> DataFrame:
    """What ``base_amount`` INR is in each grid currency."""
    return rates.filter(F.col("currency").isin(list(GRID_CURRENCIES))).select(
        "currency", (F.lit(float(base_amount)) * F.col("rate")).alias("value")
    )
