"""Sales analysis over the cleaned sales table: KPIs, top products,
monthly trend, regional breakdown.

Every function returns a lazy DataFrame.  Group-bys get map-side partial
aggregation, so a hot product/month/region is pre-aggregated in every task
before the shuffle.  Money is summed exactly (see ``money_sum``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger.functions import count_total, money_sum, money_total, month_key, safe_ratio
from salesledger.operators.shares import with_share

TOP_PRODUCTS_N = 10


def _money_total(col: str, name: str):
    """The group's total, kept apart from the output for the shares."""
    return money_total(col).alias(name)


def sales_kpis(df: DataFrame) -> DataFrame:
    """One row: total_revenue, total_orders (distinct ids), average_order_value."""
    agg = df.agg(
        money_sum("revenue").alias("total_revenue"),
        F.count_distinct("order_id").alias("total_orders"),
    )
    return agg.withColumn("average_order_value", safe_ratio("total_revenue", "total_orders"))


def product_totals(df: DataFrame) -> DataFrame:
    """Per product; a null product forms no group (as in a pandas groupby)."""
    return (
        df.groupBy("product")
        .agg(
            money_total("revenue").alias("revenue"),
            count_total("quantity").alias("quantity_sold"),
            F.count("order_id").alias("orders"),
        )
        .filter(F.col("product").isNotNull())
    )


def top_products(df: DataFrame, n: int = TOP_PRODUCTS_N) -> DataFrame:
    """Top ``n`` products by revenue (ties by name).  Planned as
    TakeOrderedAndProject: each task keeps its own top ``n``."""
    return product_totals(df).orderBy(F.desc("revenue"), F.asc("product")).limit(n)


def monthly_trend(df: DataFrame) -> DataFrame:
    """month (yyyy-MM), revenue, orders, quantity_sold; ascending by month."""
    return (
        df.groupBy(month_key("date").alias("month"))
        .agg(
            money_total("revenue").alias("revenue"),
            F.count("order_id").alias("orders"),
            count_total("quantity").alias("quantity_sold"),
        )
        .filter(F.col("month").isNotNull())
        .select("month", "revenue", "orders", "quantity_sold")
        .orderBy("month")
    )


def regional_sales(df: DataFrame, digits: int = 2) -> DataFrame:
    """region, revenue, orders, revenue_share_pct; by revenue descending.

    The share's total is all revenue, rows without a region included, while
    such rows form no group (pandas groupby semantics): the null group is
    kept through the total and dropped from the output.
    """
    grouped = df.groupBy("region").agg(
        _money_total("revenue", "_revenue_exact"),
        F.count("order_id").alias("orders"),
    )
    grouped = grouped.withColumn("revenue", F.col("_revenue_exact").cast("double"))
    shared = with_share(grouped, "revenue", "revenue_share_pct", digits, total_col="_revenue_exact")
    return shared.filter(F.col("region").isNotNull()).select("region", "revenue", "orders", "revenue_share_pct").orderBy(
        F.desc("revenue"), F.asc("region")
    )


def chart_series(top: DataFrame, n: int = 5, scale: float = 1000.0, digits: int = 1) -> DataFrame:
    """First ``n`` of a ranked product table, revenue in thousands and share
    of the shown rows to ``digits`` decimals (chart labels)."""
    head = top.orderBy(F.desc("revenue"), F.asc("product")).limit(n)
    head = head.withColumn("revenue_k", F.col("revenue") / F.lit(scale)).withColumn(
        "_rev_exact", F.col("revenue")
    )
    return with_share(head, "revenue", "share_pct", digits, total_col="_rev_exact").drop("_rev_exact")


@dataclass
class SalesAnalysis:
    kpis: DataFrame
    top_products: DataFrame
    monthly_trends: DataFrame
    regional_sales: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "kpis": self.kpis,
            "top_products": self.top_products,
            "monthly_trends": self.monthly_trends,
            "regional_sales": self.regional_sales,
        }


def require_rows(df: DataFrame) -> DataFrame:
    """Fail on an empty input; a ``limit(1)`` probe, not a count."""
    if not df.limit(1).take(1):
        raise ValueError("Cannot analyze an empty table.")
    return df


def run_analysis(df: DataFrame, check_empty: bool = True) -> SalesAnalysis:
    """KPIs, top products, monthly trend and regional breakdown of one
    cleaned table.  The caller should persist ``df`` when it is reused."""
    if check_empty:
        require_rows(df)
    return SalesAnalysis(
        kpis=sales_kpis(df),
        top_products=top_products(df),
        monthly_trends=monthly_trend(df),
        regional_sales=regional_sales(df),
    )
