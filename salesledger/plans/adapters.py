"""Views of the driver's test tables in the shapes our operators take.

* ``sales_orders``: one sale per order (orders ⋈ customer ⋈ nation ⋈ region).
* ``sales_lines``: one sale per line item (+ part), keyed by order id, so an
  order id repeats; "first" is defined by every line column.
* ``messy_sales_text``: ``sales_lines`` rendered as CSV-like text with
  free-form headers and injected mess (null and null-token cells, padded
  and re-cased text, several date layouts, unparseable numbers and dates),
  decided per row by CASE rules on the row's own values.  No row is removed
  by the adapter.
* ``ledger``: the ``events`` table as ledger rows.
* ``ledger_import_text``: ``events`` rendered as an import CSV.
* ``ledger_changes``: an update set derived from ``events``.

Joins are left to the planner: dimension tables are broadcast when their
file statistics are under the broadcast threshold, otherwise joined by
shuffle (AQE re-plans with measured sizes and splits skewed partitions).
Every view has a SQL twin in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesledger.sources.tables import read_table

# The driver tables' schemas, declared so that reads skip
# schema inference.
TABLE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

LINE_ORDER_COLS = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", schema=TABLE_SCHEMAS.get(name))


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")


def _customer_region(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """customer ⋈ (nation ⋈ region): one row per customer with its region
    name.  The 25-row geography side is broadcast at any scale."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", *extra)
    geo = _geo(spark, sf_dir)
    return c.join(geo, c.c_nationkey == geo.n_nationkey).select("c_custkey", "r_name", *extra)


def _order_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ (customer ⋈ nation ⋈ region)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    cr = _customer_region(spark, sf_dir, "c_mktsegment")
    return o.join(cr, o.o_custkey == cr.c_custkey)


def sales_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _order_region(spark, sf_dir)
    return df.select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderpriority").alias("product"),
        F.col("c_mktsegment").alias("category"),
        F.lit(1).cast("bigint").alias("quantity"),
        F.col("o_totalprice").alias("unit_price"),
        F.col("o_totalprice").alias("revenue"),
        F.col("r_name").alias("region"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ (orders ⋈ customer ⋈ nation ⋈ region): the line columns
    plus ``o_orderdate`` and ``r_name``.

    Each order gets its region first, on the orders side.  When orders,
    customer and part are too large to broadcast, the line-sized rows are
    shuffled by order key here and by part key in ``with_part``; joining
    customer onto the line rows instead would shuffle them a third time.
    """
    return with_orders(spark, sf_dir, table(spark, sf_dir, "lineitem").select(*LINE_ORDER_COLS))


def with_orders(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """``lines`` ⋈ (orders ⋈ customer ⋈ nation ⋈ region) on the order key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cr = _customer_region(spark, sf_dir)
    orders_geo = o.join(cr, o.o_custkey == cr.c_custkey).select("o_orderkey", "o_orderdate", "r_name")
    return lines.join(orders_geo, lines.l_orderkey == orders_geo.o_orderkey)


def with_part(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """``lines`` ⋈ part on the part key (adds ``p_name``, ``p_type``)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return lines.join(p, lines.l_partkey == p.p_partkey)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ (orders ⋈ customer ⋈ nation ⋈ region) ⋈ part."""
    return with_part(spark, sf_dir, order_lines(spark, sf_dir))


def sales_line_columns(df: DataFrame, with_seq: bool = False) -> DataFrame:
    """The sales shape of joined line rows."""
    cols = [
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("p_name").alias("product"),
        F.col("p_type").alias("category"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("revenue"),
        F.col("r_name").alias("region"),
    ]
    if with_seq:
        cols.append(F.struct(*LINE_ORDER_COLS).alias("row_seq"))
    return df.select(*cols)


def sales_lines(spark: SparkSession, sf_dir: str, with_seq: bool = False) -> DataFrame:
    return sales_line_columns(_lines(spark, sf_dir), with_seq)


def messy_sales_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lines(spark, sf_dir)
    disc, tax = F.col("l_discount"), F.col("l_tax")
    flag, status, line = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    no_tax = tax == F.lit(0.0)
    oid = F.col("l_orderkey").cast("string")
    day = F.col("o_orderdate")
    revenue = (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).cast("string")
    s = F.lit(None).cast("string")
    return df.select(
        F.when(no_tax & (disc == 0.0), s)
        .when((tax == 0.08) & (disc == 0.1), F.lit("N/A"))
        .when(line == 1, F.concat(F.lit(" "), oid, F.lit(" ")))
        .otherwise(oid)
        .alias("Transaction_ID"),
        F.when(no_tax & (disc == 0.03), F.lit("not a date"))
        .when(line == 2, F.date_format(day, "MM/dd/yyyy"))
        .when(line == 3, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:30:00")))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
        .alias("order-date"),
        F.when(no_tax & (disc == 0.05), s)
        .when((status == "F") & (flag == "A"), F.upper("p_name"))
        .when((status == "O") & (flag == "N"), F.concat(F.lit("  "), F.col("p_name")))
        .otherwise(F.col("p_name"))
        .alias("Item Name"),
        F.when(no_tax & (disc == 0.06), s)
        .when(flag == "R", F.lower("p_type"))
        .otherwise(F.col("p_type"))
        .alias("Product Category"),
        F.when(no_tax & (disc == 0.07), F.lit("many"))
        .when(line == 4, F.concat(F.lit(" "), F.col("l_quantity").cast("bigint").cast("string"), F.lit(" ")))
        .when(line == 5, F.col("l_quantity").cast("string"))
        .otherwise(F.col("l_quantity").cast("bigint").cast("string"))
        .alias("QTY"),
        F.when(no_tax & (disc == 0.08), s)
        .otherwise((F.col("l_extendedprice") / F.col("l_quantity")).cast("string"))
        .alias("price"),
        F.when(no_tax & (disc == 0.01), s)
        .when(no_tax & (disc == 0.02), F.concat(F.lit("$"), revenue))
        .when(no_tax & (disc == 0.09), F.lit("NA"))
        .otherwise(revenue)
        .alias("Total Sales"),
        F.when(flag == "R", F.concat(F.lit("  "), F.lower("r_name"), F.lit(" ")))
        .when(no_tax & (disc == 0.04), F.lit("N/A"))
        .otherwise(F.col("r_name"))
        .alias("Territory"),
        F.struct(*LINE_ORDER_COLS).alias("row_seq"),
    )


def sparse_sales_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The required columns of ``messy_sales_text`` alone, under headers that
    the dashboard's null count looks at."""
    return messy_sales_text(spark, sf_dir).select(
        F.col("Transaction_ID").alias("Order_ID"), F.col("`order-date`").alias("Date"), F.col("`Total Sales`").alias("Revenue"), "row_seq"
    )


# Priorities whose orders are rendered with the day first, as files of their own.
DAY_FIRST_FILES = ("1-URGENT", "2-HIGH")


def dated_orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their date as text in one of 14 layouts, the priority as the
    ``file`` they come from; some files have the day first."""
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    day_first = F.col("o_orderpriority").isin(*DAY_FIRST_FILES)

    def either(day_pattern: str, month_pattern: str):
        return F.when(day_first, F.date_format(day, day_pattern)).otherwise(F.date_format(day, month_pattern))

    layouts = [
        F.date_format(day, "yyyy-MM-dd"),
        F.date_format(day, "yyyy-MM-dd HH:mm:ss"),
        F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123456789Z")),
        F.date_format(day, "MMM d yyyy"),
        F.date_format(day, "d MMMM, yyyy"),
        F.date_format(day, "yyyy/MM/dd HH:mm"),
        F.concat(F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")),
        F.date_format(day, "yyyy-MM-dd hh:mm a"),
        F.date_format(day, "yyyyMMdd'T'HHmmss"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:30 UTC")),
        either("dd/MM/yyyy", "MM/dd/yyyy"),
        either("dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm"),
        either("d.M.yyyy", "M.d.yyyy"),
        either("d/M/yy", "M/d/yy"),
    ]
    text = layouts[0]
    for k, layout in enumerate(layouts[1:], 1):
        text = F.when(F.col("o_orderkey") % len(layouts) == k, layout).otherwise(text)
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("file"), text.alias("date"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("category"),
        F.col("props").alias("description"),
        F.col("ts").cast("date").alias("date"),
    )


def ledger_import_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    v, t = F.col("value"), F.col("event_type")
    s = F.lit(None).cast("string")
    return ev.select(
        F.when(v >= 400.0, F.lit("not a date"))
        .when(t == "view", F.date_format("ts", "MM/dd/yyyy"))
        .when((t == "click") & (v < 5.0), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
        .alias("When"),
        F.when((v >= 100.0) & (v < 101.0), s)
        .when((t == "purchase") & (v < 10.0), F.concat(F.lit("  "), F.upper(t), F.lit(" ")))
        .otherwise(t)
        .alias("Type"),
        F.when(v < 1.0, F.lit("free"))
        .when((v >= 200.0) & (v < 201.0), F.lit("1,000"))
        .otherwise(v.cast("string"))
        .alias("Spent"),
        F.when((t == "signup") & (v < 20.0), s)
        .when(t == "error", F.concat(F.lit(" "), F.col("props"), F.lit(" ")))
        .otherwise(F.col("props"))
        .alias("Notes"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("event_id").alias("pos")).alias("row_seq"),
    )


# Ids far above any event id: change rows that name no ledger row.
MISSING_ID_OFFSET = 1_000_000_000


def ledger_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of every 'error' row, plus edits of ids that do not exist."""
    ev = table(spark, sf_dir, "events")
    fixes = ev.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"),
        (F.col("value") * F.lit(2.0)).alias("amount"),
        F.lit(" Error Refund ").alias("category"),
        F.col("props").alias("description"),
        F.col("ts").cast("date").alias("date"),
    )
    ghosts = ev.filter((F.col("event_type") == "signup") & (F.col("value") >= 150.0)).select(
        (F.col("event_id") + F.lit(MISSING_ID_OFFSET)).alias("id"),
        F.col("value").alias("amount"),
        F.lit("Ghost").alias("category"),
        F.lit(None).cast("string").alias("description"),
        F.col("ts").cast("date").alias("date"),
    )
    return fixes.unionByName(ghosts)


def ledger_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ledger_changes`` as a log (``seq``): every 'error' row is edited a second
    time, by an edit that a form refuses where the value is at most 20."""
    first = ledger_changes(spark, sf_dir).withColumn("seq", F.lit(1))
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    second = ev.select(
        F.col("event_id").alias("id"),
        (F.col("value") - F.lit(20.0)).alias("amount"),
        F.lit("Second Fix").alias("category"),
        F.lit(None).cast("string").alias("description"),
        F.col("ts").cast("date").alias("date"),
        F.lit(2).alias("seq"),
    )
    return first.unionByName(second)


def ledger_in_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with a ``currency`` per row: known codes, one that is not
    known, and null."""
    t = F.col("category")
    code = F.when(t == "view", "USD").when(t == "click", "JPY").when(t == "purchase", "INR").when(t == "error", "XYZ")
    return ledger(spark, sf_dir).withColumn("currency", code)


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ledger rows: many months."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("category"),
        F.lit(None).cast("string").alias("description"),
        F.col("o_orderdate").cast("date").alias("date"),
    )
