"""Inserts, id assignment, batch update/delete and the Parquet ledger store."""

import csv
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from salesledger.operators.changes import (
    apply_updates,
    delete_ids,
    existing_ids,
    insert_rows,
    missing_ids,
)
from salesledger.operators.cleaning import clean_expenses
from salesledger.operators.ids import assign_ids
from salesledger.sources import LedgerTable, read_csv_text

SCHEMA = "id long, amount double, category string, description string, date date"
D = dt.date


def _ledger(spark):
    return spark.createDataFrame(
        [(1, 10.0, "Food", "a", D(2026, 1, 1)), (2, 20.0, "Rent", "b", D(2026, 1, 2)), (3, 30.0, "Fun", None, D(2026, 1, 3))],
        SCHEMA,
    )


def test_assign_ids_follow_order_across_partitions(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).alias("k")).repartition(7)
    out = assign_ids(df, 100, ["k"], id_col="nid", num_partitions=5)
    got = sorted((r.k, r.nid) for r in out.collect())
    assert got == [(k, 101 + k) for k in range(5000)]


def test_update_delete_missing(spark):
    led = _ledger(spark)
    changes = spark.createDataFrame(
        [(2, 25.0, " Rent ", None, D(2026, 2, 2)), (9, 1.0, "Ghost", "x", D(2026, 1, 1))], SCHEMA
    )
    up = {r.id: r for r in apply_updates(led, changes).collect()}
    assert up[2].amount == 25.0 and up[2].category == "Rent" and up[2].description == "" and up[2].date == D(2026, 2, 2)
    assert up[1].amount == 10.0 and len(up) == 3 and 9 not in up
    assert [r.id for r in missing_ids(changes, led).collect()] == [9]
    assert [r.id for r in existing_ids(changes, led).collect()] == [2]
    ids = spark.createDataFrame([(1,), (1,), (7,)], "id long")
    assert sorted(r.id for r in delete_ids(led, ids).collect()) == [2, 3]


def test_last_change_per_id_counts_and_invalid_ones_do_not(spark):
    led = _ledger(spark)
    changes = spark.createDataFrame(
        [(1, 10.0, "A", "one", D(2026, 5, 5), 1), (1, 20.0, "B", "two", D(2026, 5, 4), 2), (2, -5.0, "C", "x", D(2026, 5, 5), 3), (2, 5.0, None, "x", D(2026, 5, 5), 4)],
        SCHEMA + ", seq int",
    )
    up = [tuple(r) for r in apply_updates(led, changes, "seq", only_valid=True).collect()]
    assert len(up) == led.count()
    assert [r for r in up if r[0] == 1] == [(1, 20.0, "B", "two", D(2026, 5, 4))]
    assert [r for r in up if r[0] == 2] == [tuple(r) for r in led.filter("id = 2").collect()]


def test_update_then_delete_same_ids_is_original_minus_ids(spark):
    led = _ledger(spark)
    changes = spark.createDataFrame([(1, 99.0, "X", "y", D(2026, 5, 5))], SCHEMA)
    out = delete_ids(apply_updates(led, changes), changes.select("id"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, led.filter("id != 1").collect()))


def test_clean_expenses_rules(spark):
    df = spark.createDataFrame(
        [("2026-06-01", " food & dining ", "15.5", "  coffee "), ("06/02/2026", None, "abc", None),
         ("bad", "Transport", "5", "x"), ("2026-06-03", "NA", "0", "")],
        "Date string, `Cat` string, `Spent` string, Notes string",
    )
    got = [tuple(r) for r in clean_expenses(df).orderBy("date").collect()]
    assert got == [
        (15.5, "Food & Dining", "coffee", D(2026, 6, 1)),
        (0.0, "Nan", "", D(2026, 6, 2)),
        (0.0, "Nan", "", D(2026, 6, 3)),
    ]


def test_ledger_store_import_update_delete(spark, tmp_dir):
    path = os.path.join(tmp_dir, "ledger")
    table = LedgerTable(spark, path).create_if_absent()
    assert table.read().count() == 0
    csv_path = os.path.join(tmp_dir, "upload.csv")
    with open(csv_path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["When", "Type", "Spent", "Notes"])
        w.writerows([["2026-06-01", "food", "10", "a"], ["2026-06-02", "rent", "20", "b"], ["2026-06-03", "fun", "30", ""]])
    raw = read_csv_text(spark, csv_path)
    n = table.import_rows(clean_expenses(raw, passthrough=["row_seq"]), ["row_seq"])
    assert n == 3
    rows = table.newest_first().collect()
    assert [(r.id, r.category) for r in rows] == [(3, "Fun"), (2, "Rent"), (1, "Food")]
    # delete the newest, then import again: ids are not reused
    table.delete(spark.createDataFrame([(3,)], "id long"))
    assert sorted(r.id for r in table.read().collect()) == [1, 2]
    table.import_rows(clean_expenses(read_csv_text(spark, csv_path), passthrough=["row_seq"]), ["row_seq"])
    assert sorted(r.id for r in table.read().collect()) == [1, 2, 4, 5, 6]
    table.update(spark.createDataFrame([(1, 11.0, "Food", "edited", D(2026, 6, 1))], SCHEMA))
    assert table.read().filter("id = 1").first().description == "edited"


def test_insert_rows_union(spark):
    led = _ledger(spark)
    new = spark.createDataFrame([(4, 1.0, "A", "", D(2026, 1, 4))], SCHEMA)
    assert insert_rows(led, new).count() == 4


def test_ids_not_reused_after_successive_deletes(spark, tmp_dir):
    path = os.path.join(tmp_dir, "ledger2")
    table = LedgerTable(spark, path).create_if_absent()
    rows = spark.createDataFrame(
        [(float(i), "Food", "x", D(2026, 1, i), i) for i in range(1, 6)],
        "amount double, category string, description string, date date, seq long",
    )
    assert table.import_rows(rows, ["seq"]) == 5
    table.delete(spark.createDataFrame([(5,)], "id long"))
    table.delete(spark.createDataFrame([(4,)], "id long"))
    table.update(spark.createDataFrame([(1, 9.0, "Rent", "y", D(2026, 2, 1))], SCHEMA))
    table.import_rows(rows.limit(1), ["seq"])
    assert sorted(r.id for r in table.read().collect()) == [1, 2, 3, 6]


def test_failed_rewrite_leaves_the_table_and_no_id_comes_twice(spark, tmp_dir):
    table = LedgerTable(spark, os.path.join(tmp_dir, "ledger3")).create_if_absent()
    schema = "amount double, category string, description string, date date, seq long"
    rows = spark.createDataFrame([(1.0, "Food", "x", D(2026, 1, 1), 1), (2.0, "Rent", "y", D(2026, 1, 2), 2)], schema)
    assert table.import_rows(rows, ["seq"]) == 2
    broken = table.read().withColumn("amount", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        table.replace(broken)
    assert sorted(r.id for r in table.read().collect()) == [1, 2]
    assert table.import_rows(rows, ["seq"], start_after=10) == 2
    assert sorted(r.id for r in table.read().collect()) == [1, 2, 11, 12]
    assert table.import_rows(rows.limit(0), ["seq"]) == 0 and table.high_water_mark() == 12
    assert LedgerTable(spark, table.path).create_if_absent().read().count() == 4  # an existing table stays
    table.delete(table.read().select("id"))
    assert table.read().count() == 0 and table.high_water_mark() == 12


def test_existence_checks(spark):
    led = _ledger(spark)
    changes = spark.createDataFrame([(2, 1.0, "x", None, D(2026, 1, 1)), (9, 1.0, "x", None, D(2026, 1, 1)), (9, 2.0, "x", None, D(2026, 1, 1))], SCHEMA)
    assert [r.id for r in existing_ids(changes, led).collect()] == [2]
    assert [r.id for r in missing_ids(changes, led).collect()] == [9]
