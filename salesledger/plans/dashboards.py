"""Dashboard documents: rows of (section, key, json), one JSON object per row.

A section is a table of aggregates (KPIs, top products, months, regions,
categories, days); no task gathers one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from salesledger.operators import ledger as L
from salesledger.operators import sales as S
from salesledger.operators.quality import clean_with_metrics
from salesledger.sources.sinks import json_rows


def sales_dashboard_json(raw: DataFrame, order_cols: Sequence[str | Column] = ("row_seq",)) -> DataFrame:
    """Cleaning metrics, KPIs and the three sales tables of one raw input."""
    cleaned, metrics = clean_with_metrics(raw, order_cols=order_cols)
    analysis = S.run_analysis(cleaned, check_empty=False)
    return (
        json_rows(metrics.select("raw_rows", "cleaned_rows", "nulls_removed", "duplicates_removed"), "metrics")
        .unionByName(json_rows(analysis.kpis, "kpis"))
        .unionByName(json_rows(analysis.top_products, "top_products", "product"))
        .unionByName(json_rows(analysis.monthly_trends, "monthly_trends", "month"))
        .unionByName(json_rows(analysis.regional_sales, "regional_sales", "region"))
    )


def ledger_dashboard_json(ledger: DataFrame) -> DataFrame:
    """Totals with the highest category, the breakdown and the daily trend."""
    return summary_json(L.ledger_summary(ledger))


def summary_json(summary: L.LedgerSummary) -> DataFrame:
    """A ledger summary as a document."""
    highest = summary.highest.select("highest_category").scalar()
    head = summary.kpis.select("total", "count", "daily_avg", highest.alias("highest_category"))
    return (
        json_rows(head, "summary")
        .unionByName(json_rows(summary.breakdown, "breakdown", "category"))
        .unionByName(json_rows(summary.trends, "trends", "date_str"))
    )
