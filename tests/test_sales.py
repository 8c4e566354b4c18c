"""Sales cleaning and analysis on a small messy fixture, against the pandas
model, read through the real CSV source."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from salesledger.operators import sales as S
from salesledger.operators.cleaning import clean_sales
from salesledger.operators.headers import header_mapping, normalize_headers, sales_header_key, SALES_ALIASES
from salesledger.operators.quality import clean_with_metrics, quality_metrics
from salesledger.sources import read_csv_text
from tests import model

HEADERS = ["Transaction ID", "order_date", "Item", "Product-Category", "QTY", "Price", "Total Revenue", "Territory"]
CANON = ["order_id", "date", "product", "category", "quantity", "unit_price", "revenue", "region"]

ROWS = [
    ["ORD-1", "2026-01-05", "laptop", "Electronics", "1", "1200.0", "1200.0", "East"],
    ["ORD-2", "2026-01-06", "SMARTPHONE", "Electronics", "2", "800.0", "1600.0", "  west "],
    ["ORD-1", "2026-01-07", "Laptop", "Electronics", "3", "1200.0", "3600.0", "North"],
    ["", "2026-01-08", "Desk Lamp", "Home", "1", "45.0", "45.0", "South"],
    ["ORD-3", "2026-01-09", "desk lamp", "home", "2", "45.0", "NA", "South"],
    ["ORD-4", "01/10/2026", "men's t-shirt", "apparel", "x", "20.0", "$40", "east"],
    ["ORD-5", "not a date", "Backpack", "Travel", "1", "55.0", "55.0", "West"],
    ["ORD-5", "2026-02-01", "Backpack", "Travel", "1", "55.0", "55.0", "West"],
    [" ORD-6 ", "2026-02-02 10:00:00", "usa 3d printer", "Electronics", "2.7", "300.0", "600.0", "N/A"],
    ["ORD-6", "2026-02-03", "Printer", "Electronics", "1", "300.0", "300.0", "North"],
    ["ORD-7", "2026-03-15", "Running Shoes", "", "4", "90.0", "360.0", "north"],
    ["ORD-8", "2026-03-16", "Smartwatch", "Electronics", "2", "", "440.5", "East"],
    ["ORD-9", "2026-03-31", "Smartwatch", "Electronics", "1", "220.25", "220.25", "EAST"],
    ["ORD-10", "2026-03-31", "Laptop", "Electronics", "1", "1150.0", "1150.0", "West"],
]


def _write(path, headers, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(headers)
        w.writerows(rows)


@pytest.fixture()
def raw(spark, tmp_dir):
    # two files: file order is (file name, position)
    _write(os.path.join(tmp_dir, "a.csv"), HEADERS, ROWS[:7])
    _write(os.path.join(tmp_dir, "b.csv"), HEADERS, ROWS[7:])
    _write(os.path.join(tmp_dir, "ignored.txt"), HEADERS, [["X"] * 8])
    return read_csv_text(spark, tmp_dir)


def _expected():
    return model.clean_sales([dict(zip(CANON, [v if v != "" else None for v in r])) for r in ROWS])


def test_headers_map_and_ambiguity():
    m = header_mapping(HEADERS, SALES_ALIASES, sales_header_key)
    assert [m[h] for h in HEADERS] == CANON
    with pytest.raises(ValueError, match="Ambiguous"):
        header_mapping(["Sales", "Revenue"], SALES_ALIASES, sales_header_key)


def test_missing_required(spark):
    df = spark.createDataFrame([("1", "x")], "id string, product string")
    with pytest.raises(ValueError, match="date, revenue"):
        clean_sales(df)


def test_clean_matches_model(raw):
    got = clean_sales(raw).toPandas().sort_values("order_id").reset_index(drop=True)
    want = _expected().sort_values("order_id").reset_index(drop=True)
    assert list(got.columns) == list(want.columns)
    assert got.astype(str).values.tolist() == want.astype(str).values.tolist()
    # semantics the fixture pins down
    row = got.set_index("order_id")
    assert "ORD-5" not in row.index  # bad-date first copy removes its duplicate
    assert row.loc["ORD-1", "revenue"] == 1200.0  # first copy kept
    assert row.loc["ORD-4", "revenue"] == 0.0 and row.loc["ORD-4", "quantity"] == 1
    assert row.loc["ORD-4", "product"] == "Men'S T-Shirt"
    assert row.loc["ORD-6", "product"] == "Usa 3D Printer" and row.loc["ORD-6", "region"] == "Unknown Region"
    assert row.loc["ORD-6", "quantity"] == 2
    assert row.loc["ORD-8", "unit_price"] == 0.0
    assert row.loc["ORD-7", "category"] == "General"


def test_clean_is_idempotent(raw, spark):
    once = clean_sales(raw, keep_order_cols=True)
    twice = clean_sales(once.withColumn("date", F.date_format("date", "yyyy-MM-dd")))
    a = sorted(map(tuple, once.drop("row_seq").collect()))
    b = sorted(map(tuple, twice.collect()))
    assert a == b


def test_missing_unit_price_defaults_to_revenue(spark):
    df = spark.createDataFrame([("1", "2026-01-01", "12.5", 0), ("2", "2026-01-02", "$3", 1)],
                               "id string, date string, sales string, seq int")
    got = {r.order_id: r for r in clean_sales(df, order_cols=["seq"]).collect()}
    assert got["1"].unit_price == 12.5 and got["1"].product == "Unknown Product" and got["1"].quantity == 1
    assert got["2"].unit_price == 0.0 and got["2"].revenue == 0.0


def test_analysis_matches_model(raw):
    cleaned = clean_sales(raw)
    want = _expected()
    a = S.run_analysis(cleaned)
    k = a.kpis.first()
    total = model.exact_sum(want.revenue)
    assert k.total_revenue == total
    assert k.total_orders == want.order_id.nunique()
    assert k.average_order_value == total / want.order_id.nunique()

    reg = {r.region: r for r in a.regional_sales.collect()}
    for region, g in want.groupby("region"):
        assert reg[region].revenue == model.exact_sum(g.revenue)
        assert reg[region].orders == len(g)
        assert reg[region].revenue_share_pct == model.share(model.exact_sum(g.revenue), total)
    assert abs(sum(r.revenue_share_pct for r in reg.values()) - 100.0) < 0.05

    top = a.top_products.collect()
    assert len(top) <= 10
    assert [r.revenue for r in top] == sorted((r.revenue for r in top), reverse=True)
    months = a.monthly_trends.collect()
    assert [r.month for r in months] == sorted(r.month for r in months)
    assert model.exact_sum(r.revenue for r in months) == total
    assert sum(r.orders for r in months) == len(want)


def test_empty_input_is_an_error(spark):
    empty = spark.createDataFrame([], "order_id string, date date, product string, category string, quantity long, "
                                      "unit_price double, revenue double, region string")
    with pytest.raises(ValueError, match="empty"):
        S.run_analysis(empty)
    k = S.sales_kpis(empty).first()
    assert (k.total_revenue, k.total_orders, k.average_order_value) == (0.0, 0, 0.0)


def test_quality_metrics(raw):
    m = quality_metrics(raw).first()
    want = _expected()
    assert m.raw_rows == len(ROWS)
    assert m.cleaned_rows == len(want)
    assert m.null_key_rows == 2
    assert m.duplicate_rows == 3
    assert m.bad_date_rows == 1
    assert m.null_key_rows + m.duplicate_rows + m.bad_date_rows == m.raw_rows - m.cleaned_rows
    # compatible form: no raw header reads orderid/id/revenue/sales, so nothing counted as null
    assert m.nulls_removed == 0 and m.duplicates_removed == m.raw_rows - m.cleaned_rows
    assert m.retention_pct == round(len(want) / len(ROWS) * 100, 1)


def test_clean_with_metrics_is_one_pass_of_both(raw):
    cleaned, metrics = clean_with_metrics(raw)
    assert sorted(cleaned.collect()) == sorted(clean_sales(raw).collect())
    assert metrics.first() == quality_metrics(raw).first()
    # the raw rows are grouped once; counts and cleaned rows read the frozen groups
    plan = metrics.unionByName(metrics)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" not in plan


def test_quality_compat_null_headers(spark):
    df = spark.createDataFrame(
        [("1", "2026-01-01", "5"), (None, "2026-01-01", "5"), ("2", "2026-01-01", None), ("1", "x", "5")],
        "Order_ID string, Date string, Sales string",
    ).withColumn("row_seq", F.monotonically_increasing_id())
    m = quality_metrics(df).first()
    assert (m.raw_rows, m.cleaned_rows, m.nulls_removed, m.duplicates_removed) == (4, 1, 2, 1)


def test_normalize_headers_passthrough(spark):
    df = spark.createDataFrame([("1", "x")], "`Order ID` string, notes string")
    assert normalize_headers(df).columns == ["order_id", "notes"]


def test_null_keys_form_no_group_but_count_in_total(spark):
    df = spark.createDataFrame(
        [("1", "2026-01-01", "A", "c", 1, 1.0, 30.0, "East"), ("2", "2026-01-01", "B", "c", 1, 1.0, 70.0, None)],
        "order_id string, date string, product string, category string, quantity long, unit_price double, "
        "revenue double, region string",
    ).withColumn("date", F.col("date").cast("date"))
    rows = S.regional_sales(df).collect()
    assert [(r.region, r.revenue_share_pct) for r in rows] == [("East", 30.0)]


def test_hot_id_holding_a_third_of_rows(spark):
    # 3000 rows over 8 partitions; id "HOT" holds 1000 of them, in no order
    n = 3000
    base = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("ID"), F.col("id").cast("string"))).alias(
            "Order ID"
        ),
        F.lit("2026-01-05").alias("Date"),
        F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("Product"),
        F.col("id").cast("string").alias("Revenue"),
        ((F.col("id") * 7919) % n).alias("row_seq"),
    )
    cleaned, metrics = clean_with_metrics(base)
    hot = cleaned.filter(F.col("order_id") == "HOT").collect()
    # the first HOT row in row_seq order: id ≡ 0 (mod 3) with the smallest (id * 7919) % n
    first = min((i * 7919 % n, i) for i in range(0, n, 3))[1]
    assert [r.revenue for r in hot] == [float(first)]
    m = metrics.first()
    assert (m.raw_rows, m.cleaned_rows, m.duplicate_rows, m.null_key_rows) == (n, 2001, 999, 0)
    assert cleaned.count() == 2001
