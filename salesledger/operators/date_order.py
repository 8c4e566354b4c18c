"""Day first or month first: decided for a whole column, or for each file.

``13/01/2026`` can only be read with the day first, ``01/13/2026`` only with the
month first, ``12/01/2026`` both ways. One pass counts the three kinds; a column in
which some texts need the day first and none needs the month first is read
day first throughout. Where both are needed, or neither, the order is not known
(``mixed``, ``unclear``) and the month comes first, as it does without a choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesledger.functions.dates import date_part, year_last_parts
from salesledger.functions.text import strip_ws

DAY_FIRST = "_day_first"
#: Groups up to which the choice is part of the expression.
FEW = 1000


def date_orders(df: DataFrame, col: str, by: Column | None = None) -> DataFrame:
    """One row per ``date_group`` (the value of ``by``; one group without it):
    n_day_first, n_month_first and n_either (texts of each kind), day_first, mixed,
    unclear. Every group has a row, also one without such texts."""
    text = F.col(f"`{col}`")
    parts = year_last_parts(date_part(strip_ws(text.cast("string"))))
    rows = df.select((F.lit(None).cast("string") if by is None else by).alias("date_group"), F.explode(F.array(parts)).alias("_parts"))
    first, second = (F.element_at("_parts", k).cast("int") for k in (1, 2))
    counted = rows.groupBy("date_group").agg(
        F.count_if((first > 12) & (second <= 12)).alias("n_day_first"),
        F.count_if((first <= 12) & (second > 12)).alias("n_month_first"),
        F.count_if((first <= 12) & (second <= 12) & (first != second)).alias("n_either"),
    )
    day, month = F.col("n_day_first") > 0, F.col("n_month_first") > 0
    return counted.withColumns({"day_first": day & ~month, "mixed": day & month, "unclear": ~day & ~month & (F.col("n_either") > 0)})


def day_first_groups(orders: DataFrame) -> list | None:
    """The groups that have the day first, or None if there are over ``FEW``."""
    found = orders.where("day_first").select("date_group").head(FEW + 1)
    return None if len(found) > FEW else [r["date_group"] for r in found]


def with_day_first(df: DataFrame, orders: DataFrame, by: Column | None = None) -> DataFrame:
    """``df`` with the choice for each row's group (``DAY_FIRST``), which
    ``parse_dates`` follows. ``orders`` has a row per group; freeze it first. A row-wise
    step if few groups have the day first, else a join."""
    group = F.lit(None).cast("string") if by is None else by
    few = day_first_groups(orders)
    if few is not None:
        named = [g for g in few if g is not None]
        chosen = F.coalesce(group.isin(named), F.lit(False)) if named else F.lit(False)
        return df.withColumn(DAY_FIRST, chosen | group.isNull() if None in few else chosen)
    choice = orders.select(F.col("date_group").alias("_group"), F.col("day_first").alias(DAY_FIRST))
    joined = df.withColumn("_by", group).join(choice, F.col("_by").eqNullSafe(F.col("_group")), "left")
    return joined.withColumn(DAY_FIRST, F.coalesce(DAY_FIRST, F.lit(False))).drop("_by", "_group")
