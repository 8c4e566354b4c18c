"""Ledger analysis, browsing and budget on a small fixture."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesledger.operators import ledger as L
from tests import model

D = dt.date
ROWS = [
    (1, 1200.0, "Housing", "Rent share", D(2026, 6, 1)),
    (2, 350.5, "Food & Dining", "Groceries", D(2026, 6, 1)),
    (3, 89.99, "Transport", None, D(2026, 6, 2)),
    (4, 15.0, "Food & Dining", "Coffee", D(2026, 6, 3)),
    (5, 499.0, "Entertainment", "Concert", D(2026, 6, 3)),
    (6, 60.0, "Utilities", "Phone bill", D(2026, 6, 5)),
    (7, 1200.0, "Housing", "Deposit", D(2026, 7, 1)),
    (8, 42.0, "Transport", "Taxi to airport", D(2026, 7, 2)),
]
SCHEMA = "id long, amount double, category string, description string, date date"


@pytest.fixture()
def ledger(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_kpis(ledger):
    k = L.ledger_kpis(ledger).first()
    total = model.exact_sum(r[1] for r in ROWS)
    days = len({r[4] for r in ROWS})
    assert (k.total, k["count"], k.days) == (total, len(ROWS), days)
    assert k.daily_avg == total / days


def test_breakdown_and_highest(ledger):
    rows = L.category_breakdown(ledger).collect()
    total = model.exact_sum(r[1] for r in ROWS)
    assert [r.category for r in rows][0] == "Housing"
    for r in rows:
        part = model.exact_sum(x[1] for x in ROWS if x[2] == r.category)
        assert r.total_spent == part
        assert r["count"] == sum(1 for x in ROWS if x[2] == r.category)
        assert r.share_pct == model.share(part, total)
    assert [r.total_spent for r in rows] == sorted((r.total_spent for r in rows), reverse=True)
    assert L.highest_category(ledger).first().highest_category == "Housing"


def test_empty_ledger_summary(spark):
    empty = spark.createDataFrame([], SCHEMA)
    s = L.ledger_summary(empty)
    k = s.kpis.first()
    assert (k.total, k["count"], k.days, k.daily_avg) == (0.0, 0, 0, 0.0)
    assert s.highest.first().highest_category == "None"
    assert s.breakdown.count() == 0 and s.trends.count() == 0


def test_daily_trend(ledger):
    rows = L.daily_trend(ledger).collect()
    assert [r.date_str for r in rows] == sorted({r[4].isoformat() for r in ROWS})
    assert rows[0].amount == 1200.0 + 350.5


@pytest.mark.parametrize(
    "budget,pct,status,remaining",
    [(40000.0, None, "ok", None), (4200.0, None, "warning", None), (3000.0, 100.0, "danger", 0.0)],
)
def test_budget_status(ledger, budget, pct, status, remaining):
    total = model.exact_sum(r[1] for r in ROWS)
    b = L.budget_status(ledger, budget).first()
    assert b.spent == total
    assert b.status == status
    assert b.percent == (pct if pct is not None else total / budget * 100.0)
    assert b.remaining == (remaining if remaining is not None else budget - total)
    assert b.percent_label == round(b.percent + 1e-12, 1)


def test_budget_by_month(ledger):
    rows = L.budget_status(ledger, 1500.0, by_month=True).collect()
    assert [r.month for r in rows] == ["2026-06", "2026-07"]
    assert rows[0].status == "danger" and rows[1].status == "warning"
    with pytest.raises(ValueError):
        L.budget_status(ledger, 0)


def test_search_and_category_filter(ledger):
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(L.search(ledger, "FOOD")) == [2, 4]
    assert ids(L.search(ledger, "a", "Transport")) == [3, 8]  # null description counts as ''
    assert ids(L.search(ledger, "", "Housing")) == [1, 7]
    assert ids(L.search(ledger, "%")) == []  # literal, not a LIKE pattern
    assert ids(L.search(ledger)) == list(range(1, 9))


def test_lookup_and_order(ledger):
    assert [r.id for r in L.lookup(ledger, 5).collect()] == [5]
    assert L.lookup(ledger, 99).count() == 0
    assert [r.id for r in L.newest_first(ledger).collect()] == [8, 7, 6, 5, 4, 3, 2, 1]


def test_pages_concatenate_to_full_order(ledger):
    full = [r.id for r in L.newest_first(ledger).collect()]
    pages = []
    for p in range(1, 4):
        rows = L.page(ledger, p, 3).collect()
        pages += [r.id for r in rows]
        if rows:
            assert rows[0].page_total == len(ROWS)
            assert rows[0].page_start == (p - 1) * 3 + 1
            assert rows[0].page_end == min(p * 3, len(ROWS))
    assert pages == full


def test_positive_amounts(spark):
    df = spark.createDataFrame([(1, 0.0, "A", "", D(2026, 1, 1)), (2, 3.0, "A", "", D(2026, 1, 1))], SCHEMA)
    assert [r.id for r in L.positive_amounts(df).collect()] == [2]


def test_budget_column_reaches_every_status(spark):
    rows = [(1, 98.0, "a", "", D(2026, 1, 1)), (2, 80.0, "a", "", D(2026, 2, 1)), (3, 10.0, "a", "", D(2026, 3, 1))]
    led = spark.createDataFrame(rows, SCHEMA)
    found = L.budget_status(led, F.lit(100.0), by_month=True).collect()
    assert [r.status for r in found] == ["danger", "warning", "ok"]
    assert [r.percent for r in L.budget_status(led, F.lit(0.0), by_month=True).collect()] == [None] * 3


def test_summary_equals_the_single_analyses(spark):
    rows = [(1, 1e30, "a", "", D(2026, 1, 1)), (2, 0.00004, "b", "", D(2026, 1, 1)), (3, 2.5, None, "", D(2026, 1, 2)), (4, None, "b", "", None)]
    led = spark.createDataFrame(rows, "id long, amount double, category string, description string, date date")
    s = L.ledger_summary(led)
    assert s.kpis.collect() == L.ledger_kpis(led).collect()
    assert s.breakdown.collect() == L.category_breakdown(led).collect()
    assert s.highest.collect() == L.highest_category(led).collect()
    assert s.trends.collect() == L.daily_trend(led).collect()
