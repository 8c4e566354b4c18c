"""CSV source: text columns, file order across files and splits, sinks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from salesledger.operators.dedup import keep_first
from salesledger.sources import read_csv_text, write_csv, write_report
from salesledger.sources.sinks import json_rows


def _write_lines(path, n, start=0):
    with open(path, "w") as f:
        f.write("line,key,val\n")
        for i in range(start, start + n):
            f.write(f"{i},k{i % 37},v{i}\n")


def test_row_seq_follows_file_order_across_splits(spark, tmp_dir):
    for name, start in (("b.csv", 3000), ("a.csv", 0), ("c.csv", 6000)):
        _write_lines(os.path.join(tmp_dir, name), 3000, start)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        raw = read_csv_text(spark, tmp_dir, multiline=False)  # splits of a file in parallel
        assert raw.rdd.getNumPartitions() > 3
        assert dict(raw.dtypes)["line"] == "string"
        # file order: a.csv lines 0..2999, b.csv 3000..5999, c.csv 6000..8999
        ordered = [int(r.line) for r in raw.orderBy("row_seq").select("line").collect()]
        assert ordered == list(range(9000))
        first = {r.key: int(r.line) for r in keep_first(raw, "key", ["row_seq"]).collect()}
        assert first == {f"k{j}": j for j in range(37)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bad_bytes_dropped_and_csv_filter(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "x.csv"), "wb") as f:
        f.write(b"Region,Revenue\nEa\xffst,5\n")
    with open(os.path.join(tmp_dir, "y.json"), "w") as f:
        f.write("{}")
    rows = read_csv_text(spark, tmp_dir).collect()
    assert [(r.Region, r.Revenue) for r in rows] == [("East", "5")]


def test_sinks_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "name string, v double")
    write_csv(df, os.path.join(tmp_dir, "out_csv"))
    back = read_csv_text(spark, os.path.join(tmp_dir, "out_csv"), with_seq=False)
    assert sorted((r.name, r.v) for r in back.collect()) == [("a", "1.5"), ("b", "2.0")]
    paths = write_report({"t1": df, "t2": df.filter("v > 1.9")}, tmp_dir, "r1")
    assert spark.read.parquet(paths["t2"]).count() == 1


def test_json_rows_render_every_kind_of_value(spark):
    rows = [('q"uo\nte', 1.5, 2), (None, None, None), ("é", 1e40, -1), ("z", 0.00004, 0)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    out = json_rows(df, "s", "k").collect()
    assert [r.section for r in out] == ["s"] * 4 and [r.key for r in out] == ['q"uo\nte', "", "é", "z"]
    found = [json.loads(r.json) for r in out]
    assert found[:3] == [{"k": k, "v": v, "n": n} for k, v, n in rows[:3]]
    assert found[3] == {"k": "z", "v": 0.0, "n": 0}  # fractions have four places
    assert json_rows(df.limit(0), "s").collect() == []


def test_read_table_is_a_plain_scan(spark, tmp_dir):
    from salesledger.sources import tables

    path = os.path.join(tmp_dir, "t.parquet")
    spark.range(1000).coalesce(1).write.parquet(path)
    plan = tables.read_table(spark, path, schema="id BIGINT").filter(F.col("id") == 7)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,7)]" in plan and "Exchange" not in plan


def test_csv_rows_are_never_lost_silently(spark, tmp_dir):
    from salesledger.sources.csv import read_csv_groups, read_csv_text

    def put(name, text):
        path = os.path.join(tmp_dir, name)
        with open(path, "w") as f:
            f.write(text)
        return path

    a = put("a.csv", 'Order ID,Date,Revenue,Region\n1,2026-01-01,5,"We\nst"\n2,2026-01-02,6\n')
    b = put("b.csv", "Region,Revenue,Date,Order ID\nEast,7,2026-01-03,3\n")
    rows = {r["Order ID"]: r for r in read_csv_text(spark, a).collect()}
    assert rows["1"]["Region"] == "We\nst" and rows["2"]["Region"] is None and rows["2"]["Revenue"] == "6"
    with pytest.raises(Exception, match="header|Header|HEADER"):
        read_csv_text(spark, [a, b]).collect()
    parts = [p.drop("row_seq") for p in read_csv_groups(spark, [a, b])]
    both = parts[0].unionByName(parts[1]).collect()
    assert {(r["Order ID"], r["Revenue"]) for r in both} == {("1", "5"), ("2", "6"), ("3", "7")}
    long = put("c.csv", 'Order ID,Date,Revenue\n1,2026-01-01,1,234.5\n')
    with pytest.raises(Exception, match="more than the header's 3 cells"):
        read_csv_text(spark, long).select("Revenue", "Order ID").collect()
    quoted = put("d.csv", 'Order ID,Date,Revenue\n1,"a, ""b"", c"\n')
    assert read_csv_text(spark, quoted).first()["Date"] == 'a, "b", c'



def test_render_rows_by_column_type(spark):
    import datetime as dt

    from salesledger.sources import render_rows

    df = spark.createDataFrame(
        [(1, None, "a", dt.date(2026, 1, 2), dt.datetime(2026, 1, 3, 4, 5)), (2, 2.5, None, None, None)],
        "id long, amount double, note string, d date, ts timestamp",
    )
    rows = [tuple(r) for r in render_rows(df).orderBy("id").collect()]
    assert rows == [(1, None, "a", "2026-01-02", "2026-01-03"), (2, 2.5, "", "", "")]


def test_checkpoints_use_the_session_folder(spark, tmp_dir):
    from salesledger.operators.shares import with_share
    from salesledger.session import ensure_checkpoint_dir

    assert ensure_checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    g = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double")
    assert sorted(r.share_pct for r in with_share(g, "v").collect()) == [25.0, 75.0]
    # the frozen grouped table was written under the session's folder
    after = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    assert before <= after and os.listdir(spark.conf.get("spark.checkpoint.dir"))
