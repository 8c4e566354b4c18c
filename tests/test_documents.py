"""The two documents hold exactly what the tabular queries return, as JSON."""

import json

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def qs():
    return queries()


def _sections(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.section, {})[r.key] = json.loads(r.json)
    return found


def _keyed(df, key):
    return {r[key]: {k: pytest.approx(v, abs=6e-5) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in df.collect()}


def test_ledger_document_matches_tables(spark, qs):
    doc = _sections(qs["ledger_summary_json"](spark, SF))
    k = qs["ledger_kpis"](spark, SF).first()
    head = doc["summary"][""]
    assert (head["total"], head["count"]) == (pytest.approx(k.total), k["count"])
    assert head["daily_avg"] == pytest.approx(k.daily_avg, abs=6e-5)
    assert head["highest_category"] == qs["ledger_highest_category"](spark, SF).first().highest_category
    assert doc["breakdown"] == _keyed(qs["ledger_category_breakdown"](spark, SF), "category")
    assert doc["trends"] == _keyed(qs["ledger_daily_trend"](spark, SF), "date_str")


def test_sales_document_matches_tables(spark, qs):
    doc = _sections(qs["sales_dashboard_json"](spark, SF))
    m = qs["sales_quality_metrics"](spark, SF).first().asDict()
    assert doc["metrics"][""] == {c: m[c] for c in ("raw_rows", "cleaned_rows", "nulls_removed", "duplicates_removed")}
    k = qs["sales_clean_kpis"](spark, SF).first().asDict()
    assert doc["kpis"][""] == {c: pytest.approx(v, abs=6e-5) for c, v in k.items()}
    assert doc["top_products"] == _keyed(qs["sales_clean_top_products"](spark, SF), "product")
    assert doc["monthly_trends"] == _keyed(qs["sales_clean_monthly_trend"](spark, SF), "month")
    assert doc["regional_sales"] == _keyed(qs["sales_clean_regional_share"](spark, SF), "region")
