"""Sales report, batch: CSV files → clean → analyse → report tables.

    tables   = scan_csv(paths)                      (S1, text + row_seq, a table per header; rejects)
    cleaned, metrics = clean_with_metrics(raw)      (P1–P11, A11, A12, A15: one shuffle)
    analysis = run_analysis(cleaned)                (A1–A4)
    write_report({...}, root, report_id)            (S9)

Cleaning and the quality counts share one grouped pass over the raw rows
(one row per distinct id), cleaned and written once as Parquet in the shared
folder; the counts, the aggregations and the writes read that table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesledger.operators.date_order import date_orders
from salesledger.operators.headers import SALES_ALIASES, SALES_REQUIRED, header_mapping, normalize_headers, require_columns, sales_header_key
from salesledger.operators.quality import clean_with_metrics
from salesledger.operators.sales import SalesAnalysis, chart_series, run_analysis
from salesledger.operators.totals import with_total_row
from salesledger.session import written_once
from salesledger.sources.csv import SEQ_COL, all_rejects, scan_csv
from salesledger.sources.sinks import write_report


@dataclass
class SalesReport:
    report_id: str
    raw: DataFrame
    cleaned: DataFrame
    analysis: SalesAnalysis
    metrics: DataFrame
    rejects: DataFrame | None = None
    date_orders: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        """The report's sheets; with files as input also the records that are no
        rows, and their number by file and reason."""
        a = self.analysis
        sheets = {
            "raw_data": self.raw.drop(SEQ_COL),
            "cleaned_data": self.cleaned,
            "kpis": a.kpis,
            "metrics": self.metrics,
            "top_products": with_total_row(a.top_products, "product", ["revenue", "quantity_sold", "orders"]),
            "monthly_trends": with_total_row(a.monthly_trends, "month", ["revenue", "orders", "quantity_sold"]),
            "regional_sales": with_total_row(a.regional_sales, "region", ["revenue", "orders", "revenue_share_pct"]),
            "chart_top_products": chart_series(a.top_products, n=5),
        }
        if self.rejects is not None:
            sheets["rejects"] = self.rejects.drop(SEQ_COL)
            sheets["reject_counts"] = self.rejects.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("records"), F.sum("lines").alias("lines"))
        if self.date_orders is not None:
            sheets["date_orders"] = self.date_orders
        return sheets


def build_sales_report(
    spark: SparkSession, raw: DataFrame | Sequence[DataFrame], report_id: str | None = None, rejects: DataFrame | None = None
) -> SalesReport:
    """A report on one raw table, or on several whose headers differ. With the
    reader's ``row_seq``, whether dates have the day first is decided for each file."""
    tables = [raw] if isinstance(raw, DataFrame) else list(raw)
    file, orders = F.col(f"{SEQ_COL}.file"), None
    if all("file" in t.select(f"{SEQ_COL}.*").columns for t in tables):
        orders = [written_once(date_orders(t, date_header(t), file)) for t in tables]
    cleaned, metrics = clean_with_metrics(tables, orders=orders, orders_by=file)
    shown = tables[0]
    for more in tables[1:]:
        shown = shown.unionByName(more, allowMissingColumns=True)
    return SalesReport(
        report_id=report_id or uuid.uuid4().hex,
        raw=shown,
        cleaned=cleaned,
        analysis=run_analysis(cleaned),
        metrics=metrics,
        rejects=rejects,
        date_orders=None if orders is None else reduce(DataFrame.unionByName, orders),
    )


def date_header(raw: DataFrame) -> str:
    """The name of the column that holds a raw sales table's dates."""
    names = header_mapping(raw.columns, SALES_ALIASES, sales_header_key)
    require_columns(normalize_headers(raw), SALES_REQUIRED)
    return next(c for c, canonical in names.items() if canonical == "date")


def run_sales_report(
    spark: SparkSession,
    input_paths: str | Sequence[str],
    output_root: str,
    report_id: str | None = None,
    fmt: str = "parquet",
) -> dict[str, str]:
    """Read, clean, analyse and write every report table; returns the paths.
    The files may have different headers; records that are no rows are in the
    report's ``rejects`` and ``reject_counts``."""
    tables = scan_csv(spark, input_paths)
    report = build_sales_report(spark, [t.rows for t in tables], report_id, all_rejects(tables))
    return write_report(report.tables(), output_root, report.report_id, fmt)
