"""End-to-end flows: sales report, ledger export and import."""

import csv
import datetime as dt
import os

import pytest

from salesledger.plans.ledger_flows import export_tables, import_csv
from salesledger.plans.sales_report import run_sales_report
from salesledger.sources import LedgerTable
from salesledger.sources.ledger_store import LEDGER_SCHEMA
from tests.test_sales import HEADERS, ROWS, _write


def test_sales_report_writes_all_tables(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    _write(os.path.join(src, "sales.csv"), HEADERS, ROWS)
    paths = run_sales_report(spark, src, os.path.join(tmp_dir, "out"), report_id="r1")
    assert set(paths) == {"raw_data", "cleaned_data", "kpis", "metrics", "top_products", "monthly_trends",
                          "regional_sales", "chart_top_products", "rejects", "reject_counts", "date_orders"}
    assert spark.read.parquet(paths["rejects"]).count() == 0
    assert spark.read.parquet(paths["raw_data"]).count() == len(ROWS)
    reg = spark.read.parquet(paths["regional_sales"])
    total = reg.filter("row_kind = 'total'").first()
    assert total.region == "Total"
    assert abs(total.revenue_share_pct - 100.0) < 0.05


def test_export_tables_and_empty_placeholder(spark):
    empty = spark.createDataFrame([], LEDGER_SCHEMA)
    t = export_tables(empty)
    log = t["expense_log"].collect()
    assert [r.Description for r in log if r.row_kind == "row"] == ["No expenses recorded"]
    led = spark.createDataFrame([(1, 5.0, "A", None, dt.date(2026, 1, 2)), (2, 7.0, "B", "x", dt.date(2026, 1, 1))],
                                LEDGER_SCHEMA)
    t = export_tables(led)
    rows = t["expense_log"].collect()
    assert [r.Date for r in rows] == ["2026-01-01", "2026-01-02", "Total"]  # oldest first
    assert len(rows) == 3 and [r.Amount for r in rows if r.row_kind == "total"] == [12.0]
    cb = {r.category: r for r in t["category_breakdown"].collect()}
    assert cb["Total"].share_pct == 100.0


def _upload(path, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["Date", "Category", "Amount", "Description"])
        w.writerows(rows)


def test_import_csv(spark, tmp_dir):
    table = LedgerTable(spark, os.path.join(tmp_dir, "ledger")).create_if_absent()
    up = os.path.join(tmp_dir, "upload")
    os.makedirs(up)
    _upload(os.path.join(up, "a.csv"), [["2026-06-01", "food", "10", "x"], ["2026-06-02", "rent", "20", ""]])
    assert import_csv(spark, table, os.path.join(up, "a.csv")) == 2
    _upload(os.path.join(up, "b.csv"), [["2026-06-03", "fun", "5", "y"]])
    assert import_csv(spark, table, os.path.join(up, "b.csv")) == 1  # ids continue
    rows = {r.id: r for r in table.read().collect()}
    assert sorted(rows) == [1, 2, 3] and rows[3].category == "Fun"


def test_sales_report_of_mixed_headers_and_rejects(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    for name, text in {
        "a.csv": "Order ID,Date,Revenue,Region\n1,2026-01-01,5,West\n2,2026-01-02,1,234.5,East\n3,2026-01-03,7,East\n",
        "b.csv": 'Territory,Sales,created_at,transaction id,Item\nWest,20,2026-01-04,4,"Big\nBox"\nWest,30,2026-01-04,3,Late\n',
        "c.csv": 'Order ID,Date,Revenue,Region\n9,2026-01-05,8,East\n10,2026-01-05,"9,East\n11,2026-01-05,9,East\n',
    }.items():
        with open(os.path.join(src, name), "w") as f:
            f.write(text)
    paths = run_sales_report(spark, src, os.path.join(tmp_dir, "out"), report_id="r")
    rows = {r.order_id: r for r in spark.read.parquet(paths["cleaned_data"]).collect()}
    assert {k: (r.revenue, r.unit_price, r.region, r.product) for k, r in rows.items()} == {
        "1": (5.0, 5.0, "West", "Unknown Product"),
        "3": (7.0, 7.0, "East", "Unknown Product"),  # the first in file order stays
        "4": (20.0, 20.0, "West", "Big\nBox"),
        "9": (8.0, 8.0, "East", "Unknown Product"),
    }
    counts = {(os.path.basename(r.file), r.reason): (r.records, r.lines) for r in spark.read.parquet(paths["reject_counts"]).collect()}
    assert counts == {("a.csv", "more cells than the header"): (1, 1), ("c.csv", "a quote that is never closed"): (1, 2)}


def test_import_stops_at_rejects_or_keeps_them(spark, tmp_dir):
    table = LedgerTable(spark, os.path.join(tmp_dir, "ledger")).create_if_absent()
    up = os.path.join(tmp_dir, "upload")
    os.makedirs(up)
    with open(os.path.join(up, "a.csv"), "w") as f:
        f.write("Date,Type,Cost\n2026-06-01,food,10\n2026-06-02,rent,20,000\n")
    with open(os.path.join(up, "b.csv"), "w") as f:
        f.write("Notes,when,Category,Amount\n\"two\nlines\",2026-06-03,fun,5\n")
    with pytest.raises(ValueError, match="more cells than the header: 2026-06-02,rent,20,000"):
        import_csv(spark, table, up)
    assert table.read().count() == 0
    rejects = os.path.join(tmp_dir, "rejects")
    assert import_csv(spark, table, up, rejects_path=rejects) == 2
    assert [(r.id, r.category, r.description) for r in table.read().orderBy("id").collect()] == [(1, "Food", ""), (2, "Fun", "two\nlines")]
    assert [r.record for r in spark.read.parquet(rejects).collect()] == ["2026-06-02,rent,20,000"]
