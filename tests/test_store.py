"""The ledger's versions: files touched, writers at once, rules, parts, pages;
and reports that are published at once."""

import datetime as dt
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from salesledger.operators import ledger as L
from salesledger.operators.ids import assign_ids_in_place
from salesledger.plans.ledger_flows import import_csv
from salesledger.sources import LEDGER_SCHEMA, LedgerTable, report_paths, write_report
from salesledger.sources.commit_log import CommitLog

D = dt.date


def rows_of(spark, ids, files=1):
    data = [(i, float(i) / 4, "ABC"[i % 3], f"row {i}", D(2026, 1, 1) + dt.timedelta(days=i % 40)) for i in ids]
    return spark.createDataFrame(data, LEDGER_SCHEMA).repartitionByRange(files, "id")


@pytest.fixture()
def table(spark, tmp_dir):
    return LedgerTable(spark, os.path.join(tmp_dir, "ledger")).create_if_absent()


def test_a_change_rewrites_only_files_that_hold_it(spark, table):
    assert table.append(rows_of(spark, range(1, 401), files=20)) == 400
    before = set(table.files())
    assert len(before) == 20
    change = spark.createDataFrame([("77", "12.5", " new ", None, "2026-02-03"), ("78", "junk", "x", None, "2026-02-03")], "id string, amount string, category string, description string, date string")
    assert table.update(change) == 1
    after = set(table.files())
    assert len(before - after) == 1 and len(after - before) == 1
    row = table.read().where("id = 77").first()
    assert (row.amount, row.category, row.description, row.date) == (12.5, "new", "", D(2026, 2, 3))
    assert table.read().where("id = 78").first().category == "A" and table.read().count() == 400
    assert table.delete(spark.createDataFrame([(1,), (400,), (999,)], "id long")) == 2
    assert table.delete(spark.createDataFrame([(1,)], "id long")) == 0
    assert sorted(r.id for r in table.read().select("id").collect()) == list(range(2, 400))


def test_rules_are_observed_and_nothing_is_committed(spark, table):
    table.append(rows_of(spark, range(1, 11)))
    loose = "id long, amount double, category string, description string, date date"
    for bad, what in [((11, 1.0, None, "", D(2026, 1, 1)), "category is null in 1 rows"), ((11, None, "a", "", None), "amount is null.*date is null"), ((5, 1.0, "a", "", D(2026, 1, 1)), "the table holds, such as .5")]:
        with pytest.raises(ValueError, match=what):
            table.append(spark.createDataFrame([bad], loose))
    with pytest.raises(ValueError, match="occur twice"):
        table.append(rows_of(spark, [20, 20]))
    with pytest.raises(ValueError, match="date is null"):
        table.replace(spark.createDataFrame([(1, 1.0, "a", "", None)], loose))
    assert table.version() == 1 and table.read().count() == 10 and table.high_water_mark() == 10


def test_writers_at_once_get_different_ids(spark, table, tmp_dir):
    schema = "amount double, category string, description string, date date, seq long"
    errors = []

    def run(k):
        try:
            own = LedgerTable(spark, table.path)
            rows = spark.createDataFrame([(float(k), f"w{k}", "", D(2026, 1, 1), s) for s in range(10)], schema)
            assert own.import_rows(rows, ["seq"]) == 10
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    ids = [r.id for r in table.read().collect()]
    assert sorted(ids) == list(range(1, 41)) and table.high_water_mark() == 40
    log = CommitLog(spark, os.path.join(tmp_dir, "log"))
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(log.create(7, {"k": k}))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 7 + [True] and log.last() == 7 and os.listdir(log.path) == ["000000000007.json"]


def test_many_versions_and_an_update_beside_an_import(spark, table, monkeypatch):
    from salesledger.sources import ledger_store

    monkeypatch.setattr(ledger_store, "SNAPSHOT_EVERY", 3)
    for k in range(5):
        table.append(rows_of(spark, range(10 * k + 1, 10 * k + 11)))
    assert table.version() == 5 and table.read().count() == 50
    real, other = table._write, LedgerTable(spark, table.path)

    def write_while_another_deletes(rows):
        table._write = real
        other.delete(spark.createDataFrame([(2,)], "id long"))
        return real(rows)

    table._write = write_while_another_deletes
    assert table.delete(spark.createDataFrame([(1,)], "id long")) == 1  # done again on the other's file
    assert sorted(r.id for r in table.read().collect()) == list(range(3, 51))


def test_summary_from_parts_equals_a_scan(spark, table):
    table.append(rows_of(spark, range(1, 101), files=3))
    table.update(spark.createDataFrame([(5, 1e30, "A", "", D(2026, 3, 1)), (6, 0.00004, "B", "", D(2026, 3, 1))], LEDGER_SCHEMA))
    table.delete(spark.createDataFrame([(9,)], "id long"))
    table.append(rows_of(spark, range(200, 230)))
    scan, parts = L.ledger_summary(table.read()), table.summary()
    for name, df in scan.tables().items():
        assert parts.tables()[name].collect() == df.collect(), name
    read = [f for f in table.cells().inputFiles() if "/ledger/" in f]
    assert read == []


def test_pages_by_day_counts(spark, table):
    table.append(rows_of(spark, range(1, 301), files=4))
    table.delete(spark.createDataFrame([(i,) for i in range(50, 60)], "id long"))
    want = [r.id for r in table.newest_first().collect()]
    for no, size in [(1, 7), (3, 7), (41, 7), (42, 7), (43, 7), (1, 1000), (290, 1)]:
        assert [r.id for r in table.page(no, size).collect()] == want[(no - 1) * size : no * size]
    plan = table.page(20, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "date" in plan and table.page(20, 5).count() == 5


def test_ids_in_place_follow_files_without_an_exchange(spark, tmp_dir):
    rng = random.Random(2)
    for name in "cab":
        with open(os.path.join(tmp_dir, f"{name}.csv"), "w") as f:
            f.write("When,Type,Spent,Notes\n" + "".join(f"{'bad' if rng.random() < 0.2 else '2026-01-02'},t,{k},{name}{k}\n" for k in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        table = LedgerTable(spark, os.path.join(tmp_dir, "ledger")).create_if_absent()
        n = import_csv(spark, table, os.path.join(tmp_dir, "[abc].csv"))
        got = [r.description for r in table.read().orderBy("id").collect()]
        assert len(got) == n == table.high_water_mark()
        assert got == sorted(got, key=lambda d: (d[0], int(d[1:]))) and [d[0] for d in got[:1]] == ["a"]
        scan = spark.read.option("header", True).csv(os.path.join(tmp_dir, "[abc].csv")).withColumn("row_seq", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))
        numbered = assign_ids_in_place(scan, 100)
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert "RangePartitioning" not in plan and "SortMergeJoin" not in plan and "hashpartitioning(_pid" not in plan.split("BroadcastExchange")[0]
        assert sorted(r.id for r in numbered.select("id").collect()) == list(range(101, 9101))
        with_other_splits = assign_ids_in_place(scan, 0)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        with pytest.raises(Exception, match="splits of the input changed"):
            with_other_splits.select("id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_a_report_is_published_as_a_whole(spark, tmp_dir):
    one, two = spark.range(3), spark.range(5)
    write_report({"a": one, "b": one}, tmp_dir, "r")
    broken = two.select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        write_report({"a": two, "b": broken}, tmp_dir, "r")
    count = lambda: {k: spark.read.parquet(p).count() for k, p in report_paths(spark, tmp_dir, "r").items()}
    assert count() == {"a": 3, "b": 3}
    assert write_report({"a": two, "b": two}, tmp_dir, "r") == report_paths(spark, tmp_dir, "r")
    assert count() == {"a": 5, "b": 5} and report_paths(spark, tmp_dir, "none") == {}
