"""Ledger analysis and browsing: KPIs, category breakdown, highest
category, daily trend, budget status, search, category filter, lookup,
newest-first order and paging.

The ledger table has columns ``id long, amount double, category string,
description string, date date``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesledger.functions import (
    contains_ci,
    day_str,
    money_parts,
    money_sum,
    money_total,
    month_key,
    round_half_up,
    safe_ratio,
    total_of_parts,
)
from salesledger.operators.shares import with_share
from salesledger.session import written_once

# Budget defaults and status thresholds (percent spent).
DEFAULT_BUDGET = 40000.0
DANGER_PCT = 95.0
WARNING_PCT = 75.0
PAGE_SIZE = 10


def ledger_kpis(df: DataFrame) -> DataFrame:
    """total, count, distinct days present, daily_avg = total / days."""
    total, count = _measures(df)
    agg = df.agg(
        F.coalesce(total, F.lit(0.0)).alias("total"),
        F.coalesce(count, F.lit(0)).cast("bigint").alias("count"),
        F.count_distinct("date").alias("days"),
    )
    return agg.withColumn("daily_avg", safe_ratio("total", "days"))


def day_category_totals(df: DataFrame) -> DataFrame:
    """One row per (date, category) with the parts of its total (``_exact``,
    ``_rest``) and its row count (``_n``).  The analyses take this table in
    place of the ledger, so that several of them need one scan of the facts."""
    exact, rest = money_parts("amount")
    return df.groupBy("date", "category").agg(exact.alias("_exact"), rest.alias("_rest"), F.count("id").alias("_n"))


def _measures(df: DataFrame) -> tuple[Column, Column]:
    """Total and row count of a ledger or of its ``day_category_totals``."""
    if "_exact" in df.columns:
        return total_of_parts("_exact", "_rest"), F.sum("_n")
    return money_total("amount"), F.count("id")


def _category_totals(df: DataFrame, with_count: bool = True) -> DataFrame:
    total, count = _measures(df)
    aggs = [total.alias("_total_exact")]
    if with_count:
        aggs.append(count.alias("count"))
    g = df.groupBy("category").agg(*aggs)
    return g.withColumn("total_spent", F.col("_total_exact").cast("double"))


def category_breakdown(df: DataFrame, digits: int = 2) -> DataFrame:
    """category, total_spent, count, share_pct; largest first."""
    g = with_share(_category_totals(df), "total_spent", "share_pct", digits, total_col="_total_exact")
    g = g.filter(F.col("category").isNotNull())
    return g.select("category", "total_spent", "count", "share_pct").orderBy(
        F.desc("total_spent"), F.asc("category")
    )


def export_category_summary(df: DataFrame, digits: int = 2) -> DataFrame:
    """category, total_spent, share_pct (the export sheet has no count)."""
    g = with_share(
        _category_totals(df, with_count=False), "total_spent", "share_pct", digits, total_col="_total_exact"
    )
    g = g.filter(F.col("category").isNotNull())
    return g.select("category", "total_spent", "share_pct").orderBy(F.desc("total_spent"), F.asc("category"))


def highest_category(df: DataFrame) -> DataFrame:
    """One row: the category with the largest total (ties: first by name);
    ``'None'`` for an empty ledger.  ``min_by`` is a partial aggregate, so
    this is one small pass over the grouped table."""
    g = _category_totals(df, with_count=False).filter(F.col("category").isNotNull())
    pick = F.min_by("category", F.struct((-F.col("_total_exact")).alias("neg"), F.col("category").alias("c")))
    return g.agg(F.coalesce(pick, F.lit("None")).alias("highest_category"))


def daily_trend(df: DataFrame) -> DataFrame:
    """date_str, amount per calendar day, ascending."""
    return (
        df.groupBy("date")
        .agg(_measures(df)[0].alias("amount"))
        .filter(F.col("date").isNotNull())
        .orderBy("date")
        .select(day_str("date").alias("date_str"), "amount")
    )


def month_totals(df: DataFrame) -> DataFrame:
    """month (yyyy-MM), spent."""
    return df.groupBy(month_key("date").alias("month")).agg(money_sum("amount").alias("spent"))


def budget_status(
    df: DataFrame,
    budget: float | Column = DEFAULT_BUDGET,
    by_month: bool = False,
) -> DataFrame:
    """spent, remaining = max(0, budget − spent), percent = min(100, spent /
    budget × 100), percent_label (1 decimal), status danger / warning / ok.

    By default the budget is compared with the all-time total; ``by_month``
    gives one row per ``yyyy-MM``.  A budget may be a Column (a scalar
    subquery); one that is not positive then gives nulls.
    """
    if isinstance(budget, Column):
        b = F.when(budget > 0, budget.cast("double"))
    elif budget is None or budget <= 0:
        raise ValueError("budget must be positive")
    else:
        b = F.lit(float(budget))
    agg = month_totals(df) if by_month else df.agg(money_sum("amount").alias("spent"))
    pct = F.when(b.isNotNull(), F.least(F.lit(100.0), F.col("spent") / b * F.lit(100.0)))
    out = (
        agg.withColumn("budget", b)
        .withColumn("remaining", F.when(b.isNotNull(), F.greatest(F.lit(0.0), b - F.col("spent"))))
        .withColumn("percent", pct)
        .withColumn("percent_label", round_half_up("percent", 1))
        .withColumn(
            "status",
            F.when(F.col("percent") >= DANGER_PCT, "danger")
            .when(F.col("percent") >= WARNING_PCT, "warning")
            .when(F.col("percent").isNotNull(), "ok"),
        )
    )
    return out.orderBy("month") if by_month else out


def positive_amounts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("amount") > 0)


def search(df: DataFrame, text: str = "", category: str = "all") -> DataFrame:
    """Case-insensitive substring match on description OR category (a null
    description counts as ''), AND an exact category filter unless 'all'."""
    s = (text or "").strip().lower()
    cond = contains_ci(F.coalesce(F.col("description"), F.lit("")), s) | contains_ci("category", s)
    out = df.filter(cond) if s else df
    return out if category == "all" else out.filter(F.col("category") == F.lit(category))


def lookup(df: DataFrame, expense_id: int) -> DataFrame:
    """Row by id; the predicate reaches the Parquet scan (row-group stats)."""
    return df.filter(F.col("id") == F.lit(int(expense_id)))


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("date"), F.desc("id"))


def page(df: DataFrame, page_no: int = 1, size: int = PAGE_SIZE, ordered: bool = False) -> DataFrame:
    """One page of the newest-first listing, with the ``start``–``end`` of
    ``total`` labels as columns.

    ``offset`` sorts and discards the rows before the page (a top-k of
    ``page_no * size`` per task); fine for dashboard pages, costly for very
    deep ones.
    """
    if page_no < 1 or size < 1:
        raise ValueError("page_no and size must be ≥ 1")
    total = df.select(F.count(F.lit(1))).scalar()
    sorted_df = df if ordered else newest_first(df)
    start = (page_no - 1) * size
    rows = sorted_df.offset(start).limit(size)
    return rows.withColumns(
        {
            "page_total": total,
            "page_start": F.when(total > start, F.lit(start + 1)).otherwise(F.lit(0)),
            "page_end": F.least(F.lit(start + size).cast("bigint"), total),
        }
    )


@dataclass
class LedgerSummary:
    kpis: DataFrame
    breakdown: DataFrame
    highest: DataFrame
    trends: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"kpis": self.kpis, "breakdown": self.breakdown, "highest": self.highest, "trends": self.trends}


def ledger_summary(df: DataFrame) -> LedgerSummary:
    """KPIs, category breakdown, highest category and daily trend, all from
    one grouped scan of the facts, written once.  An empty ledger gives zeros,
    'None' and empty tables. ``df`` may be ``day_category_totals`` already."""
    cells = written_once(df if "_exact" in df.columns else day_category_totals(df))
    return LedgerSummary(
        kpis=ledger_kpis(cells),
        breakdown=category_breakdown(cells),
        highest=highest_category(cells),
        trends=daily_trend(cells),
    )
