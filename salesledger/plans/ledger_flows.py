"""Ledger flows: summary document, export tables, CSV import.

* summary: table scan → KPIs, breakdown, highest category, daily trend.
* export: Expense Log (date text, category, amount, description, Total row),
  Category Breakdown (total, share, Total row), Daily Trend.  An empty
  ledger exports one placeholder row, as a spreadsheet needs some content.
* import: CSV → clean_expenses → ids after the high-water mark in file
  order → append.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesledger.operators import ledger as L
from salesledger.operators.cleaning import clean_expenses
from salesledger.operators.date_order import date_orders, day_first_groups
from salesledger.operators.headers import LEDGER_ALIASES, LEDGER_REQUIRED, header_mapping, ledger_header_key, normalize_headers, require_columns
from salesledger.operators.totals import with_total_row
from salesledger.session import written_once
from salesledger.sources.csv import SEQ_COL, all_rejects, scan_csv
from salesledger.sources.ledger_store import LEDGER_SCHEMA, LedgerTable
from salesledger.sources.sinks import render_rows, write_report

# The headers of the log sheet.
LOG_HEADERS = ("Date", "Category", "Amount", "Description")
# The placeholder row of an empty export.
EMPTY_EXPORT_ROW = (0, 0.0, "None", "No expenses recorded", dt.date(2026, 6, 14))


def expense_log(ledger: DataFrame) -> DataFrame:
    """The export's log sheet: oldest first, under the sheet's headers."""
    rows = render_rows(ledger.orderBy("date", "id").select("date", "category", "amount", "description"))
    return with_total_row(rows.toDF(*LOG_HEADERS), LOG_HEADERS[0], ["Amount"])


def export_tables(ledger: DataFrame) -> dict[str, DataFrame]:
    spark = ledger.sparkSession
    placeholder = spark.range(1).select(
        *[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(EMPTY_EXPORT_ROW, LEDGER_SCHEMA.fields)]
    )
    # the placeholder only survives when the ledger is empty
    has_rows = ledger.select(F.count(F.lit(1))).scalar() > 0
    src = ledger.unionByName(placeholder.filter(~has_rows))
    return {
        "expense_log": expense_log(src),
        "category_breakdown": with_total_row(L.export_category_summary(src), "category", ["total_spent", "share_pct"]),
        "daily_trend": L.daily_trend(src),
    }


def export_ledger(table: LedgerTable, output_root: str, report_id: str, fmt: str = "parquet") -> dict[str, str]:
    return write_report(export_tables(table.read()), output_root, report_id, fmt)


def _cleaned_by_file(raw: DataFrame) -> tuple[DataFrame, bool]:
    """Cleaned import rows, day first or month first decided for each file; and
    whether that took row-wise steps alone."""
    names = header_mapping(raw.columns, LEDGER_ALIASES, ledger_header_key)
    require_columns(normalize_headers(raw, LEDGER_ALIASES, ledger_header_key), LEDGER_REQUIRED)
    file = F.col(f"{SEQ_COL}.file")
    orders = written_once(date_orders(raw, next(c for c, canonical in names.items() if canonical == "date"), file))
    return clean_expenses(raw, passthrough=[SEQ_COL], orders=orders, orders_by=file), day_first_groups(orders) is not None


def import_csv(spark: SparkSession, table: LedgerTable, paths: str | Sequence[str], rejects_path: str | None = None) -> int:
    """Bulk import; returns the number of rows written.

    The files may have different headers. A record that is no row (more cells
    than the header, or a quote that is never closed) stops the import before
    anything is written, unless there is a ``rejects_path``: then such records are
    appended to the table there and the rows are imported."""
    tables = scan_csv(spark, paths)
    cleaned = [_cleaned_by_file(t.rows) for t in tables]
    rejects = all_rejects(tables)
    if rejects_path is not None:
        rejects.write.mode("append").parquet(rejects_path)
    elif first := rejects.head(1):
        raise ValueError(f"{first[0]['file']} holds {first[0]['reason']}: {first[0]['record'][:200]}")
    rows = cleaned[0][0]
    for more, _ in cleaned[1:]:
        rows = rows.unionByName(more)
    return table.import_rows(rows, [SEQ_COL], in_place=all(row_wise for _, row_wise in cleaned))
