"""CSV in splits: records over several lines, rejects, headers of many files."""

import csv
import io
import os
import random

import pandas as pd
import pytest

from salesledger.operators.cleaning import clean_expenses
from salesledger.plans.ledger_flows import import_csv
from salesledger.sources import LedgerTable, ledger_store, read_csv_text, scan_csv
from salesledger.sources import csv as csv_source
from salesledger.sources.csv import TOO_LONG, UNCLOSED


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def messy(seed: int, eol: str, n: int = 150) -> str:
    rng = random.Random(seed)

    def cell() -> str:
        kinds = ['x "q" y', "line\nbreak" + "z" * rng.randint(0, 900), "a,b", '"', "\r\nx", "", '""', "é\n\n"]
        text = rng.choice(kinds) if rng.random() < 0.5 else f"plain{rng.randint(0, 9)}"
        return '"' + text.replace('"', '""') + '"' if rng.random() < 0.1 or any(c in text for c in ',"\n\r') else text

    blank = lambda: eol if rng.random() < 0.05 else ""
    return f'id,"b ""x""",c{eol}' + "".join(blank() + ",".join([str(k), cell(), cell()]) + eol for k in range(n))


@pytest.mark.parametrize(("seed", "eol"), [(1, "\n"), (2, "\r\n")])
def test_quoted_newlines_in_small_splits_equal_pandas(spark, tmp_dir, small_splits, seed, eol):
    text = messy(seed, eol)
    want = pd.read_csv(io.StringIO(text, newline=""), dtype=str, keep_default_na=False)
    [table] = scan_csv(spark, put(tmp_dir, "a.csv", text))
    assert table.names == list(want.columns) == ["id", 'b "x"', "c"]
    got = [tuple(v or "" for v in r[:3]) for r in table.rows.orderBy("row_seq").collect()]
    assert got == [tuple(r) for r in want.itertuples(index=False, name=None)]
    assert table.rejects.count() == 0
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(os.path.join(tmp_dir, "a.csv"))
    assert whole.rdd.getNumPartitions() == 1 and sorted(r["id"] for r in whole.collect()) == sorted(r[0] for r in got)


def test_partitions_grow_with_the_file(spark, tmp_dir, small_splits):
    sizes = []
    for n in (2000, 20000):
        text = "id,b\n" + "".join(f"{k},value {k}\n" for k in range(n))
        sizes.append(read_csv_text(spark, put(tmp_dir, f"{n}.csv", text)).rdd.getNumPartitions())
    assert sizes[1] > 5 * sizes[0] > 50


def test_rejects_are_kept_whichever_columns_are_used(spark, tmp_dir):
    path = put(tmp_dir, "a.csv", 'Notes,Order ID,Date,Revenue\nn1,1,2026-01-01,5\nn2,2,2026-01-02,1,234.5\nn3,3\nn4,4,x,7,\n"n5\n",5,2026-01-03,9\n')
    for multiline in (True, False):
        [table] = scan_csv(spark, path, multiline=multiline)
        assert sorted(r["Revenue"] for r in table.rows.select("Revenue").collect() if r["Revenue"])[:1] == ["5"]
        rejects = {r.record: (os.path.basename(r.file), r.reason, r.lines) for r in table.rejects.collect()}
        assert {"n2,2,2026-01-02,1,234.5", "n4,4,x,7,"} <= set(rejects) and set(rejects.values()) == {("a.csv", TOO_LONG, 1)}
        with pytest.raises(Exception, match="more than the header's 4 cells"):
            read_csv_text(spark, path, multiline=multiline).select("Revenue").collect()
        with pytest.raises(Exception, match="more than the header's 4 cells"):
            read_csv_text(spark, path, multiline=multiline).count()
    [table] = scan_csv(spark, path)
    assert [(r["Notes"], r["Revenue"]) for r in table.rows.orderBy("row_seq").collect()] == [("n1", "5"), ("n3", None), ("n5\n", "9")]
    assert table.rows.count() + table.rejects.count() == 5


def test_splits_that_change_between_the_passes_are_cut_anew(spark, tmp_dir, small_splits):
    text = "a,b\n" + "".join(f'{k},"two\nlines"\n' for k in range(150))
    lines = csv_source._lines(spark, [put(tmp_dir, "a.csv", text)], True)
    splits = csv_source._splits(lines, True)
    assert splits.count() > 2 and splits.agg({"n_lines": "sum"}).first()[0] == 301
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1400")  # every second split stays as a start
    rows, rejects = csv_source._spread(lines, splits, ["a", "b"], True)
    assert [tuple(r)[:2] for r in rows.orderBy("row_seq").collect()] == [(str(k), "two\nlines") for k in range(150)]
    assert rejects.count() == 0


def test_a_quote_never_closed_is_one_reject(spark, tmp_dir, small_splits):
    rest = "".join(f"{k},b{k},7\n" for k in range(10, 200))
    path = put(tmp_dir, "a.csv", f'Order ID,Product,Revenue\n1,a,5\n2,"Wid,5\n{rest}')
    [table] = scan_csv(spark, path)
    assert [r["Order ID"] for r in table.rows.collect()] == ["1"]
    [reject] = table.rejects.collect()
    assert (reject.reason, reject.record, reject.lines) == (UNCLOSED, '2,"Wid,5', 191)
    with pytest.raises(Exception, match=UNCLOSED):
        read_csv_text(spark, path).count()
    bare = put(tmp_dir, "b.csv", 'a,b\n5" pipe,1\n"6"" pipe",2\n')  # a quote inside a bare cell is text
    assert [tuple(r)[:2] for r in read_csv_text(spark, bare).orderBy("row_seq").collect()] == [('5" pipe', "1"), ('6" pipe', "2")]


def test_headers_of_many_files(spark, tmp_dir):
    for k in range(12):
        put(tmp_dir, f"a{k:02}.csv", f"x,y\n{k},1\nx,y\n")
    put(tmp_dir, "b [1].csv", "\n\ny,x\n2,77\n")
    put(tmp_dir, "c.csv", 'x,"y\nz"\n5,"q\n"\n')
    put(tmp_dir, "d.txt", "no csv")
    tables = scan_csv(spark, tmp_dir)
    assert [(t.names, len(t.files)) for t in tables] == [(["x", "y"], 12), (["y", "x"], 1), (["x", "y\nz"], 1)]
    assert sorted(r["x"] for r in tables[0].rows.collect()) == sorted([*map(str, range(12)), *["x"] * 12])  # a repeated header is a row
    assert [tuple(r)[:2] for r in tables[1].rows.collect()] == [("2", "77")]
    assert [tuple(r)[:2] for r in tables[2].rows.collect()] == [("5", "q\n")]
    with pytest.raises(ValueError, match="3 different headers"):
        read_csv_text(spark, tmp_dir)


def test_unreadable_input_is_a_value_error(spark, tmp_dir):
    with pytest.raises(ValueError, match="cannot read"):
        scan_csv(spark, os.path.join(tmp_dir, "absent.csv"))
    put(tmp_dir, "only.txt", "a,b\n1,2\n")
    with pytest.raises(ValueError, match="no CSV file"):
        scan_csv(spark, tmp_dir)
    put(tmp_dir, "full.csv", "a,b\n1,2\n")
    put(tmp_dir, "empty.csv", "")
    with pytest.raises(ValueError, match="no header in .*empty.csv"):
        scan_csv(spark, tmp_dir)


def test_records_over_lines_are_parsed_once_and_numbered_in_place(spark, tmp_dir, monkeypatch):
    def moved(*_):
        raise AssertionError("rows were sorted to number them")

    monkeypatch.setattr(ledger_store, "number_rows", moved)
    rng, want = random.Random(5), []
    for name in "ba":
        rows = []
        for k in range(160):
            note = f"{name}{k}" + ("\n" + "z" * rng.randint(0, 9000) + '\n"",' if rng.random() < 0.1 else "")
            bad = rng.random() < 0.2
            rows.append(["no date" if bad else "2026-01-02", "t", str(k), note])
            want += [] if bad else [note]
        with open(os.path.join(tmp_dir, f"{name}.csv"), "w", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows([["When", "Type", "Spent", "No\ntes"], *rows])
    want = want[len(want) - sum(n[0] == "a" for n in want) :] + want[: sum(n[0] == "b" for n in want)]
    # splits end inside of records, and a split's records come back in several pieces
    conf = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxRecordsPerFile": "7"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        [table] = scan_csv(spark, tmp_dir)
        plan = table.rows._jdf.queryExecution().executedPlan().toString()
        assert "from_csv" not in plan and "Exchange" not in plan
        noted = table.rows.withColumnRenamed("No\ntes", "Notes")
        ledger = LedgerTable(spark, os.path.join(tmp_dir, "ledger")).create_if_absent()
        assert ledger.import_rows(clean_expenses(noted, passthrough=["row_seq"]), ["row_seq"], in_place=True) == len(want)
        assert [r.description for r in ledger.read().orderBy("id").collect()] == want
        other = LedgerTable(spark, os.path.join(tmp_dir, "other")).create_if_absent()
        assert import_csv(spark, other, tmp_dir) == len(want)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
