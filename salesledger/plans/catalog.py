"""Registered queries: name → (Spark callable, SQL twin or None).

Every query reads the driver's test tables (through ``adapters``) in full.
The SQL twins (DuckDB dialect) restate the same semantics independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesledger.operators import ledger as L
from salesledger.operators import sales as S
from salesledger.operators.changes import apply_updates, delete_ids, existing_ids, insert_rows, missing_ids
from salesledger.operators.cleaning import clean_expenses, clean_sales, parse_dates
from salesledger.operators.date_order import date_orders, with_day_first
from salesledger.operators.dedup import keep_first
from salesledger.operators.ids import assign_ids_in_place
from salesledger.operators.quality import quality_metrics
from salesledger.operators.rates import base_rates, convert
from salesledger.operators.totals import with_total_row
from salesledger.plans import adapters as A
from salesledger.plans import oracle as O
from salesledger.plans.dashboards import ledger_dashboard_json, sales_dashboard_json, summary_json
from salesledger.plans.ledger_flows import expense_log, import_csv
from salesledger.session import shared_path, written_once
from salesledger.sources import LedgerTable, write_csv

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered browsing queries.
SEARCH_TEXT = "5}"
SEARCH_CATEGORY = "view"
PAGE_NO = 3
LOOKUP_ID = 42
BUDGET = L.DEFAULT_BUDGET
B = f"cast({BUDGET} as double)"
BUDGET_OF_BEST_MONTH = 1.02
DEEP_PAGE_NO = 90
# A cell's end with a line break, quotes and a comma.
CSV_NOTE = '\n"noted", twice'


# ---------------------------------------------------------------- sales ---
def q_sales_regional_share(spark, d):
    return S.regional_sales(A.sales_orders(spark, d))


def q_sales_kpis(spark, d):
    return S.sales_kpis(A.sales_orders(spark, d))


def q_sales_monthly_trend(spark, d):
    return S.monthly_trend(A.sales_orders(spark, d))


def q_sales_top_products(spark, d):
    return S.top_products(A.sales_lines(spark, d))


def q_sales_first_line_per_order(spark, d):
    # Keep-first by the numeric order key ahead of all joins: tasks keep one
    # row per order before the only shuffle of line rows, so a hot order is
    # one row per task, and the orders join reuses that partitioning.  An
    # order's lines share its row of every joined table but part, and each
    # line has a part.  The text id is the key's decimal form, so the groups
    # are the same as by order_id.
    lines = A.table(spark, d, "lineitem").select(*A.LINE_ORDER_COLS)
    payload = ("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    first = keep_first(lines.select(*payload, F.struct(*A.LINE_ORDER_COLS).alias("row_seq")), "l_orderkey", ["row_seq"])
    return A.sales_line_columns(A.with_part(spark, d, A.with_orders(spark, d, first)))


def q_sales_chart_series(spark, d):
    return S.chart_series(S.top_products(A.sales_lines(spark, d)), n=5)


def q_sales_top_products_with_total(spark, d):
    return with_total_row(S.top_products(A.sales_lines(spark, d)), "product", ["revenue", "quantity_sold", "orders"])


def q_sales_monthly_with_total(spark, d):
    return with_total_row(S.monthly_trend(A.sales_orders(spark, d)), "month", ["revenue", "orders", "quantity_sold"])


def q_sales_regional_with_total(spark, d):
    return with_total_row(
        S.regional_sales(A.sales_orders(spark, d)), "region", ["revenue", "orders", "revenue_share_pct"]
    )


def _clean(spark, d):
    return clean_sales(A.messy_sales_text(spark, d), order_cols=["row_seq"])


def q_sales_clean(spark, d):
    return _clean(spark, d)


def q_sales_clean_regional_share(spark, d):
    return S.regional_sales(_clean(spark, d))


def q_sales_clean_kpis(spark, d):
    return S.sales_kpis(_clean(spark, d))


def q_sales_clean_top_products(spark, d):
    return S.top_products(_clean(spark, d))


def q_sales_clean_monthly_trend(spark, d):
    return S.monthly_trend(_clean(spark, d))


def q_sales_quality_metrics(spark, d):
    return quality_metrics(A.messy_sales_text(spark, d), order_cols=["row_seq"])


def q_sales_sparse_clean(spark, d):
    return clean_sales(A.sparse_sales_text(spark, d), order_cols=["row_seq"])


def q_sales_sparse_quality(spark, d):
    return quality_metrics(A.sparse_sales_text(spark, d), order_cols=["row_seq"])


def q_sales_dashboard_json(spark, d):
    return sales_dashboard_json(A.messy_sales_text(spark, d), order_cols=["row_seq"])


def q_sales_date_orders(spark, d):
    return date_orders(A.dated_orders_text(spark, d), "date", F.col("file"))


def q_sales_date_layouts(spark, d):
    raw = A.dated_orders_text(spark, d)
    orders = written_once(date_orders(raw, "date", F.col("file")))
    return parse_dates(with_day_first(raw, orders, F.col("file"))).select("order_id", "file", "date")


# --------------------------------------------------------------- ledger ---
def q_ledger_newest_first(spark, d):
    return L.newest_first(A.ledger(spark, d))


def q_ledger_kpis(spark, d):
    return L.ledger_kpis(A.ledger(spark, d))


def q_ledger_category_breakdown(spark, d):
    return L.category_breakdown(A.ledger(spark, d))


def q_ledger_highest_category(spark, d):
    return L.highest_category(A.ledger(spark, d))


def q_ledger_daily_trend(spark, d):
    return L.daily_trend(A.ledger(spark, d))


def q_ledger_export_summary(spark, d):
    return with_total_row(L.export_category_summary(A.ledger(spark, d)), "category", ["total_spent", "share_pct"])


def q_ledger_export_log(spark, d):
    return expense_log(A.ledger(spark, d))


def q_ledger_search(spark, d):
    return L.search(A.ledger(spark, d), SEARCH_TEXT, SEARCH_CATEGORY)


def q_ledger_search_all(spark, d):
    return L.search(A.ledger(spark, d), SEARCH_TEXT, "all")


def q_ledger_page(spark, d):
    return L.page(A.ledger(spark, d), PAGE_NO, L.PAGE_SIZE)


def q_ledger_lookup(spark, d):
    return L.lookup(A.ledger(spark, d), LOOKUP_ID)


def q_ledger_budget_status(spark, d):
    return L.budget_status(A.ledger(spark, d), BUDGET)


def q_ledger_budget_by_month(spark, d):
    return L.budget_status(A.ledger(spark, d), BUDGET, by_month=True)


def q_ledger_budget_months(spark, d):
    orders = A.order_ledger(spark, d)
    best = L.month_totals(orders).agg(F.max("spent") * F.lit(BUDGET_OF_BEST_MONTH)).scalar()
    return L.budget_status(orders, best, by_month=True)


def q_ledger_convert_each(spark, d):
    return convert(A.ledger_in_currencies(spark, d), base_rates(spark), "amount", "currency", "EUR", "amount_eur")


def q_ledger_convert_usd(spark, d):
    return convert(A.ledger(spark, d), base_rates(spark), "amount", "INR", "USD", "amount_usd")


def _imported(spark, d):
    return clean_expenses(A.ledger_import_text(spark, d), passthrough=["row_seq"])


def _numbered(spark, d):
    hwm = A.ledger(spark, d).select(F.coalesce(F.max("id"), F.lit(0).cast("bigint"))).scalar()
    return assign_ids_in_place(_imported(spark, d), hwm).select("id", *L_FIELDS[1:])


L_FIELDS = ("id", "amount", "category", "description", "date")


def q_ledger_import(spark, d):
    return _numbered(spark, d)


def q_ledger_import_positive(spark, d):
    return L.positive_amounts(_numbered(spark, d))


def q_ledger_after_import(spark, d):
    return insert_rows(A.ledger(spark, d), _numbered(spark, d))


def q_ledger_batch_update(spark, d):
    return apply_updates(A.ledger(spark, d), A.ledger_changes(spark, d))


def q_ledger_change_log(spark, d):
    return apply_updates(A.ledger(spark, d), A.ledger_change_log(spark, d), "seq", only_valid=True)


def q_ledger_missing_ids(spark, d):
    return missing_ids(A.ledger_changes(spark, d), A.ledger(spark, d))


def q_ledger_existing_ids(spark, d):
    return existing_ids(A.ledger_changes(spark, d), A.ledger(spark, d))


def q_ledger_batch_delete(spark, d):
    led = A.ledger(spark, d)
    return delete_ids(led, led.filter(F.col("category") == "view").select("id"))


def q_ledger_summary_json(spark, d):
    return ledger_dashboard_json(A.ledger(spark, d))


def _stored(spark, d):
    """The ledger as a table in the shared folder."""
    table = LedgerTable(spark, shared_path(spark, "ledger")).create_if_absent()
    table.append(A.ledger(spark, d))
    return table


def q_ledger_store_changes(spark, d):
    table = _stored(spark, d)
    table.update(A.ledger_change_log(spark, d), "seq")
    table.delete(A.ledger(spark, d).filter(F.col("category") == "view").select("id"))
    table.import_rows(_imported(spark, d), ["row_seq"], in_place=True)
    return table.read()


def q_ledger_store_page(spark, d):
    return _stored(spark, d).page(DEEP_PAGE_NO, L.PAGE_SIZE)


def q_ledger_store_summary(spark, d):
    return summary_json(_stored(spark, d).summary())


def q_ledger_csv_import(spark, d):
    text = A.ledger_import_text(spark, d)
    noted = text.withColumn("Notes", F.when(F.col("Type") == "click", F.concat("Notes", F.lit(CSV_NOTE))).otherwise(F.col("Notes")))
    uploads = shared_path(spark, "uploads")
    write_csv(noted.drop("row_seq"), uploads)
    table = LedgerTable(spark, shared_path(spark, "ledger")).create_if_absent()
    import_csv(spark, table, uploads)
    return table.read().select("amount", "category", "description", "date")


QUERIES: dict[str, Query] = {
    "sales_regional_share": q_sales_regional_share,
    "sales_kpis": q_sales_kpis,
    "sales_monthly_trend": q_sales_monthly_trend,
    "sales_top_products": q_sales_top_products,
    "sales_first_line_per_order": q_sales_first_line_per_order,
    "sales_chart_series": q_sales_chart_series,
    "sales_top_products_with_total": q_sales_top_products_with_total,
    "sales_monthly_with_total": q_sales_monthly_with_total,
    "sales_regional_with_total": q_sales_regional_with_total,
    "sales_clean": q_sales_clean,
    "sales_clean_regional_share": q_sales_clean_regional_share,
    "sales_clean_kpis": q_sales_clean_kpis,
    "sales_clean_top_products": q_sales_clean_top_products,
    "sales_clean_monthly_trend": q_sales_clean_monthly_trend,
    "sales_quality_metrics": q_sales_quality_metrics,
    "sales_date_orders": q_sales_date_orders,
    "sales_date_layouts": q_sales_date_layouts,
    "sales_sparse_clean": q_sales_sparse_clean,
    "sales_sparse_quality": q_sales_sparse_quality,
    "sales_dashboard_json": q_sales_dashboard_json,
    "ledger_newest_first": q_ledger_newest_first,
    "ledger_kpis": q_ledger_kpis,
    "ledger_category_breakdown": q_ledger_category_breakdown,
    "ledger_highest_category": q_ledger_highest_category,
    "ledger_daily_trend": q_ledger_daily_trend,
    "ledger_export_summary": q_ledger_export_summary,
    "ledger_export_log": q_ledger_export_log,
    "ledger_search": q_ledger_search,
    "ledger_search_all": q_ledger_search_all,
    "ledger_page": q_ledger_page,
    "ledger_lookup": q_ledger_lookup,
    "ledger_budget_status": q_ledger_budget_status,
    "ledger_budget_by_month": q_ledger_budget_by_month,
    "ledger_budget_months": q_ledger_budget_months,
    "ledger_convert_usd": q_ledger_convert_usd,
    "ledger_convert_each": q_ledger_convert_each,
    "ledger_import": q_ledger_import,
    "ledger_import_positive": q_ledger_import_positive,
    "ledger_after_import": q_ledger_after_import,
    "ledger_batch_update": q_ledger_batch_update,
    "ledger_change_log": q_ledger_change_log,
    "ledger_missing_ids": q_ledger_missing_ids,
    "ledger_existing_ids": q_ledger_existing_ids,
    "ledger_batch_delete": q_ledger_batch_delete,
    "ledger_summary_json": q_ledger_summary_json,
    "ledger_store_changes": q_ledger_store_changes,
    "ledger_store_page": q_ledger_store_page,
    "ledger_store_summary": q_ledger_store_summary,
    "ledger_csv_import": q_ledger_csv_import,
}


# ------------------------------------------------------------ SQL twins ---
def _regional_body() -> str:
    return (
        """with g as (select region, """
        + O.money_sum("revenue")
        + """ as rev_exact, count(order_id) as orders from sales group by region)
select region, cast(rev_exact as double) as revenue, orders, """
        + O.share("cast(rev_exact as double)", "(select sum(rev_exact) from g)")
        + """ as revenue_share_pct
from g order by revenue desc, region"""
    )


def _regional(src_ctes: str) -> str:
    return O.with_(src_ctes) + "select * from (" + _regional_body() + ")"


def _kpis_body() -> str:
    return (
        """select coalesce(cast("""
        + O.money_sum("revenue")
        + """ as double), 0.0) as total_revenue,
       count(distinct order_id) as total_orders,
       case when count(distinct order_id) > 0
            then coalesce(cast("""
        + O.money_sum("revenue")
        + """ as double), 0.0) / cast(count(distinct order_id) as double) else 0.0 end as average_order_value
from sales"""
    )


def _kpis(src_ctes: str) -> str:
    return O.with_(src_ctes) + _kpis_body()


def _monthly_body() -> str:
    return (
        """select strftime(date, '%Y-%m') as month, cast("""
        + O.money_sum("revenue")
        + """ as double) as revenue,
       count(order_id) as orders, cast(sum(quantity) as decimal(38,0)) as quantity_sold
from sales group by 1 order by 1"""
    )


def _monthly(src_ctes: str) -> str:
    return O.with_(src_ctes) + _monthly_body()


def _top_products_body(limit: int) -> str:
    return (
        """select product, cast("""
        + O.money_sum("revenue")
        + """ as double) as revenue, cast(sum(quantity) as decimal(38,0)) as quantity_sold,
       count(order_id) as orders
from sales group by product order by revenue desc, product limit """
        + str(limit)
    )


def _top_products(src_ctes: str, limit: int = 10) -> str:
    return O.with_(src_ctes) + _top_products_body(limit)


def _section(name: str, key: str, source: str, **fields: str) -> str:
    return f"select '{name}' as section, {key} as key, {O.json_fields(**fields)} as json from ({source})"


def _quality(cleaned: str, compat_nulls: str) -> str:
    """The quality counts over the CTEs of ``O.MESSY``."""
    return (
        """select raw_rows, cleaned_rows, compat as nulls_removed,
       greatest(0, raw_rows - compat - cleaned_rows) as duplicates_removed,
       null_key_rows, after_nulls - distinct_ids as duplicate_rows, bad_date_rows,
       case when raw_rows > 0 then round(cleaned_rows / raw_rows * 100.0, 1) else 100.0 end as retention_pct
from (select (select count(*) from tok) as raw_rows, (select count(*) from """
        + cleaned
        + ") as cleaned_rows, "
        + compat_nulls
        + """ as compat,
             (select count(*) from tok where order_id is null or revenue is null) as null_key_rows,
             (select count(*) from kept) as after_nulls,
             (select count(distinct order_id) from kept) as distinct_ids,
             (select count(*) from firsts where """
        + O.parse_date("date")
        + " is null) as bad_date_rows)"
    )


def _ledger_kpis_body() -> str:
    return (
        """select coalesce(cast("""
        + O.money_sum("amount")
        + """ as double), 0.0) as total, count(id) as count, count(distinct date) as days,
       case when count(distinct date) > 0 then coalesce(cast("""
        + O.money_sum("amount")
        + """ as double), 0.0) / cast(count(distinct date) as double) else 0.0 end as daily_avg
from ledger"""
    )


def _breakdown_body() -> str:
    return (
        "select category, cast(total_exact as double) as total_spent, cnt as count, "
        + O.share("cast(total_exact as double)", "(select sum(total_exact) from cats)")
        + " as share_pct from cats"
    )


def _trend_body() -> str:
    return "select strftime(date, '%Y-%m-%d') as date_str, cast(" + O.money_sum("amount") + " as double) as amount from ledger group by date"


def _budget_columns(budget: str) -> str:
    pct = f"least(100.0, spent / {budget} * 100.0)"
    return f"""spent, {budget} as budget, greatest(0.0, {budget} - spent) as remaining, {pct} as percent,
       round({pct}, 1) as percent_label,
       case when {pct} >= 95.0 then 'danger' when {pct} >= 75.0 then 'warning' else 'ok' end as status"""


HIGHEST = "coalesce((select category from cats order by total_exact desc, category limit 1), 'None')"
NULL_KEYS = "(select count(*) from tok where order_id is null or revenue is null)"

CLEANED_AS_SALES = O.MESSY + """,
sales as (select * from cleaned)"""

LEDGER_CATS = O.LEDGER + """,
cats as (select category, """ + O.money_sum("amount") + """ as total_exact, count(id) as cnt from ledger group by category)"""

SALES_COLS = "order_id, date, product, category, quantity, unit_price, revenue, region"

ORACLE: dict[str, str] = {
    "sales_regional_share": _regional(O.SALES_ORDERS),
    "sales_kpis": _kpis(O.SALES_ORDERS),
    "sales_monthly_trend": _monthly(O.SALES_ORDERS),
    "sales_top_products": _top_products(O.SALES_LINES),
    "sales_first_line_per_order": O.with_(O.SALES_LINES)
    + "select "
    + SALES_COLS
    + " from sales qualify row_number() over (partition by order_id order by "
    + O.LINE_ORDER
    + ") = 1",
    "sales_chart_series": O.with_(O.SALES_LINES, "\ntop as (" + _top_products_body(5) + ")")
    + "select product, revenue, quantity_sold, orders, revenue / 1000.0 as revenue_k, "
    + O.share("revenue", "(select sum(cast(revenue as decimal(28,4))) from top)", 1)
    + " as share_pct from top",
    "sales_top_products_with_total": O.with_(O.SALES_LINES, "\ntop as (" + _top_products_body(10) + ")")
    + """select product, revenue, quantity_sold, orders, 'row' as row_kind from top
union all
select 'Total', coalesce(cast(sum(cast(revenue as decimal(28,4))) as double), 0.0),
       cast(coalesce(sum(quantity_sold), 0) as decimal(38,0)), cast(coalesce(sum(orders), 0) as bigint), 'total' from top""",
    "sales_monthly_with_total": O.with_(O.SALES_ORDERS, "\nm as (" + _monthly_body() + ")")
    + """select month, revenue, orders, quantity_sold, 'row' as row_kind from m
union all
select 'Total', coalesce(cast(sum(cast(revenue as decimal(28,4))) as double), 0.0),
       cast(coalesce(sum(orders), 0) as bigint), cast(coalesce(sum(quantity_sold), 0) as decimal(38,0)), 'total' from m""",
    "sales_regional_with_total": O.with_(O.SALES_ORDERS, "\nr as (" + _regional_body() + ")")
    + """select region, revenue, orders, revenue_share_pct, 'row' as row_kind from r
union all
select 'Total', coalesce(cast(sum(cast(revenue as decimal(28,4))) as double), 0.0),
       cast(coalesce(sum(orders), 0) as bigint),
       coalesce(cast(sum(cast(revenue_share_pct as decimal(28,4))) as double), 0.0), 'total' from r""",
    "sales_clean": O.with_(O.MESSY) + "select " + SALES_COLS + " from cleaned",
    "sales_clean_regional_share": _regional(CLEANED_AS_SALES),
    "sales_clean_kpis": _kpis(CLEANED_AS_SALES),
    "sales_clean_top_products": _top_products(CLEANED_AS_SALES),
    "sales_clean_monthly_trend": _monthly(CLEANED_AS_SALES),
    "sales_quality_metrics": O.with_(O.MESSY) + _quality("cleaned", "0"),
    "sales_date_orders": f"""
select file as date_group, count(*) filter (dated and is_day and d > 12) as n_day_first, count(*) filter (dated and not is_day and d > 12) as n_month_first,
       count(*) filter (dated and d <= 12 and d <> m) as n_either, is_day as day_first, false as mixed, false as unclear
from (select o_orderpriority as file, o_orderpriority in {A.DAY_FIRST_FILES} as is_day, o_orderkey % 14 >= 10 as dated,
             day(o_orderdate) as d, month(o_orderdate) as m from orders) group by file, is_day""",
    "sales_date_layouts": "select o_orderkey as order_id, o_orderpriority as file, cast(o_orderdate as date) as date from orders",
    "sales_sparse_clean": O.with_(O.SPARSE) + "select " + SALES_COLS + " from sparse",
    "sales_sparse_quality": O.with_(O.SPARSE) + _quality("sparse", NULL_KEYS),
    "sales_dashboard_json": O.with_(CLEANED_AS_SALES)
    + "\nunion all ".join(
        [
            _section("metrics", "''", _quality("cleaned", "0"), raw_rows="int", cleaned_rows="int", nulls_removed="int", duplicates_removed="int"),
            _section("kpis", "''", _kpis_body(), total_revenue="number", total_orders="int", average_order_value="number"),
            _section("top_products", "product", _top_products_body(10), product="text", revenue="number", quantity_sold="int", orders="int"),
            _section("monthly_trends", "month", _monthly_body(), month="text", revenue="number", orders="int", quantity_sold="int"),
            _section("regional_sales", "region", _regional_body(), region="text", revenue="number", orders="int", revenue_share_pct="number"),
        ]
    ),
    "ledger_newest_first": O.with_(O.LEDGER) + "select * from ledger order by date desc, id desc",
    "ledger_kpis": O.with_(O.LEDGER) + _ledger_kpis_body(),
    "ledger_category_breakdown": O.with_(LEDGER_CATS) + _breakdown_body() + " order by total_spent desc, category",
    "ledger_highest_category": O.with_(LEDGER_CATS) + f"select {HIGHEST} as highest_category",
    "ledger_daily_trend": O.with_(O.LEDGER) + _trend_body() + " order by date",
    "ledger_summary_json": O.with_(LEDGER_CATS)
    + "\nunion all ".join(
        [
            _section("summary", "''", f"select *, {HIGHEST} as highest_category from ({_ledger_kpis_body()})", total="number", count="int", daily_avg="number", highest_category="text"),
            _section("breakdown", "category", _breakdown_body(), category="text", total_spent="number", count="int", share_pct="number"),
            _section("trends", "date_str", _trend_body(), date_str="text", amount="number"),
        ]
    ),
    "ledger_export_summary": O.with_(
        LEDGER_CATS,
        """
summ as (select category, cast(total_exact as double) as total_spent, """
        + O.share("cast(total_exact as double)", "(select sum(total_exact) from cats)")
        + """ as share_pct from cats)""",
    )
    + """select category, total_spent, share_pct, 'row' as row_kind from summ
union all
select 'Total', coalesce(cast(sum(cast(total_spent as decimal(28,4))) as double), 0.0),
       coalesce(cast(sum(cast(share_pct as decimal(28,4))) as double), 0.0), 'total' from summ""",
    "ledger_export_log": O.with_(O.LEDGER)
    + """select strftime(date, '%Y-%m-%d') as "Date", category as "Category", amount as "Amount", coalesce(description, '') as "Description",
       'row' as row_kind from ledger
union all
select 'Total', null, coalesce(cast("""
    + O.money_sum("amount")
    + """ as double), 0.0), null, 'total' from ledger""",
    "ledger_search": O.with_(O.LEDGER)
    + "select * from ledger where (contains(lower(coalesce(description, '')), '"
    + SEARCH_TEXT
    + "') or contains(lower(category), '"
    + SEARCH_TEXT
    + "')) and category = '"
    + SEARCH_CATEGORY
    + "'",
    "ledger_search_all": O.with_(O.LEDGER)
    + "select * from ledger where contains(lower(coalesce(description, '')), '"
    + SEARCH_TEXT
    + "') or contains(lower(category), '"
    + SEARCH_TEXT
    + "')",
    "ledger_page": O.with_(O.LEDGER)
    + f"""select *, (select count(*) from ledger) as page_total,
       case when (select count(*) from ledger) > {(PAGE_NO - 1) * L.PAGE_SIZE} then {(PAGE_NO - 1) * L.PAGE_SIZE + 1} else 0 end as page_start,
       least({PAGE_NO * L.PAGE_SIZE}, (select count(*) from ledger)) as page_end
from ledger order by date desc, id desc limit {L.PAGE_SIZE} offset {(PAGE_NO - 1) * L.PAGE_SIZE}""",
    "ledger_lookup": O.with_(O.LEDGER) + f"select * from ledger where id = {LOOKUP_ID}",
    "ledger_budget_status": O.with_(O.LEDGER)
    + f"select {_budget_columns(B)} from (select coalesce(cast({O.money_sum('amount')} as double), 0.0) as spent from ledger)",
    "ledger_budget_by_month": O.with_(O.LEDGER)
    + f"select month, {_budget_columns(B)} from ("
    + f"select strftime(date, '%Y-%m') as month, coalesce(cast({O.money_sum('amount')} as double), 0.0) as spent from ledger group by 1) order by month",
    "ledger_budget_months": O.with_(
        f"""
months as (select strftime(o_orderdate, '%Y-%m') as month, cast({O.money_sum("o_totalprice")} as double) as spent from orders group by 1),
best as (select max(spent * cast({BUDGET_OF_BEST_MONTH} as double)) as b from months)"""
    )
    + f"select month, {_budget_columns('(select b from best)')} from months order by month",
    "ledger_convert_each": O.with_(
        O.LEDGER,
        """
coded as (select *, case category when 'view' then 'USD' when 'click' then 'JPY' when 'purchase' then 'INR'
                             when 'error' then 'XYZ' end as currency from ledger)""",
        O.RATES,
    )
    + "select l.*, case when l.amount > 0 then l.amount / r.rate * 0.011e0 end as amount_eur from coded l left join rates r on l.currency = r.code",
    "ledger_change_log": O.with_(O.LEDGER, O.CHANGE_LOG)
    + """select l.id,
       case when c.id is not null then cast(c.amount as double) else l.amount end as amount,
       case when c.id is not null then """
    + O.strip("c.category")
    + """ else l.category end as category,
       case when c.id is not null then coalesce("""
    + O.strip("c.description")
    + """, '') else l.description end as description,
       case when c.id is not null then c.date else l.date end as date
from ledger l left join last_valid c on l.id = c.id""",
    "ledger_convert_usd": O.with_(O.LEDGER)
    + "select *, case when amount > 0 then amount / 1.0 * 0.012 end as amount_usd from ledger",
    "ledger_import": O.with_(O.LEDGER_IMPORT) + "select * from numbered",
    "ledger_import_positive": O.with_(O.LEDGER_IMPORT) + "select * from numbered where amount > 0",
    "ledger_after_import": O.with_(O.LEDGER_IMPORT) + "select * from ledger union all select * from numbered",
    "ledger_batch_update": O.with_(O.LEDGER, O.CHANGES)
    + """select l.id,
       case when c.id is not null then cast(c.amount as double) else l.amount end as amount,
       case when c.id is not null then """
    + O.strip("c.category")
    + """ else l.category end as category,
       case when c.id is not null then coalesce("""
    + O.strip("c.description")
    + """, '') else l.description end as description,
       case when c.id is not null then c.date else l.date end as date
from ledger l left join changes c on l.id = c.id""",
    "ledger_missing_ids": O.with_(O.LEDGER, O.CHANGES)
    + "select distinct id from changes where id not in (select id from ledger)",
    "ledger_existing_ids": O.with_(O.LEDGER, O.CHANGES)
    + "select distinct id from changes where id in (select id from ledger)",
    "ledger_store_changes": O.with_(O.LEDGER_IMPORT, O.CHANGE_LOG)
    + """select l.id, case when c.id is not null then cast(c.amount as double) else l.amount end as amount,
       case when c.id is not null then """
    + O.strip("c.category")
    + """ else l.category end as category,
       case when c.id is not null then coalesce("""
    + O.strip("c.description")
    + """, '') else l.description end as description,
       case when c.id is not null then c.date else l.date end as date
from ledger l left join last_valid c on l.id = c.id where l.category <> 'view'
union all select * from numbered""",
    "ledger_store_page": O.with_(O.LEDGER) + f"select * from ledger order by date desc, id desc limit {L.PAGE_SIZE} offset {(DEEP_PAGE_NO - 1) * L.PAGE_SIZE}",
    "ledger_csv_import": O.with_(O.LEDGER_IMPORT)
    + f"""select amount, category, case when category = 'Click' then description || '{CSV_NOTE}' else description end as description, date
from imported""",
    "ledger_batch_delete": O.with_(O.LEDGER)
    + "select * from ledger where id not in (select id from ledger where category = 'view')",
}

ORACLE["ledger_store_summary"] = ORACLE["ledger_summary_json"]
