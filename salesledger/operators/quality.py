"""Data-quality counts for a sales cleaning run, and the one grouped pass
that both the counts and the cleaned table come from.

Two families of counts:

* the dashboard-compatible metrics (``raw_rows``, ``cleaned_rows``,
  ``nulls_removed``, ``duplicates_removed``): ``nulls_removed`` only looks
  at raw headers that read ``orderid``, ``id``, ``revenue`` or ``sales``
  once lower-cased with '_' and spaces removed, and ``duplicates_removed``
  also absorbs bad-date rows; both are clamped at 0;
* exact per-rule counts (``null_key_rows``, ``duplicate_rows``,
  ``bad_date_rows``), which add up to ``raw_rows - cleaned_rows``.

``sales_groups`` groups every raw row by (stripped id, null-key flag) and
keeps each group's row count and first row.  Partial aggregation collapses
hot ids (and all null-key rows) in the map tasks, so no group travels whole
to one task.  The counts are one small aggregation over the groups; the
cleaned table is the complete-key groups with the remaining row rules
applied.  A report that needs both reads, shuffles and cleans the raw rows
once and reads the written result (``clean_with_metrics``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from salesledger.functions import DEFAULT_NULL_TOKENS, coerce_date, round_half_up, strip_ws
from salesledger.functions.dates import DateFormat
from salesledger.operators.cleaning import (
    SALES_COLUMNS,
    add_missing_sales_columns,
    fill_sales_text,
    finish_sales,
    null_tokens_pass,
)
from salesledger.operators.date_order import DAY_FIRST, with_day_first
from salesledger.operators.headers import SALES_ALIASES, SALES_REQUIRED, normalize_headers, require_columns, sales_header_key
from salesledger.session import written_once

# Raw header keys the dashboard null count looks at.
COMPAT_NULL_HEADER_KEYS = ("orderid", "id", "revenue", "sales")

SALES_PAYLOAD = tuple(c for c in SALES_COLUMNS if c != "order_id")


def _compat_key(name: str) -> str:
    return str(name).lower().replace("_", "").replace(" ", "")


def _keyed(raw: DataFrame, order_cols: Sequence[str | Column], null_tokens: Iterable[str] | None, payload: Sequence[str]) -> DataFrame:
    """One raw table's rows: order_id, ``_key_null``, ``_compat_null``, the order and
    the ``payload`` columns."""
    compat_cols = [c for c in raw.columns if _compat_key(c) in COMPAT_NULL_HEADER_KEYS]
    tokened = null_tokens_pass(raw, null_tokens)
    compat_null = F.lit(False)
    for c in compat_cols:
        compat_null = compat_null | F.col(f"`{c}`").isNull()

    df = normalize_headers(tokened.withColumn("_compat_null", compat_null), SALES_ALIASES, sales_header_key)
    require_columns(df, SALES_REQUIRED)
    df = fill_sales_text(add_missing_sales_columns(df))
    key_null = F.col("order_id").isNull() | F.col("revenue").isNull()
    order = [(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order_cols)]
    return df.select(strip_ws(F.col("order_id").cast("string")).alias("order_id"), key_null.alias("_key_null"), "_compat_null", *order, *[F.col(f"`{c}`") for c in payload])


def sales_groups(
    raw: DataFrame | Sequence[DataFrame],
    order_cols: Sequence[str | Column] = ("row_seq",),
    null_tokens: Iterable[str] | None = DEFAULT_NULL_TOKENS,
    payload: Sequence[str] = SALES_PAYLOAD,
    orders: Sequence[DataFrame] | None = None,
    orders_by: Column | None = None,
) -> DataFrame:
    """One row per (stripped ``order_id``, ``_key_null``) of raw sales rows:
    ``_n`` rows, ``_compat`` rows the dashboard counts as null, and the
    ``payload`` columns of the group's first row by ``order_cols`` (ties
    broken by the payload, so the choice is deterministic).

    ``raw`` may be several tables with headers of their own; each gets the
    defaults of the columns that it lacks. ``orders`` has the date orders of each
    (see ``date_order``)."""
    tables = [raw] if isinstance(raw, DataFrame) else list(raw)
    if orders is not None:
        tables = [with_day_first(t, o, orders_by) for t, o in zip(tables, orders, strict=True)]
        payload = (*payload, DAY_FIRST)
    df = _keyed(tables[0], order_cols, null_tokens, payload)
    for more in tables[1:]:
        df = df.unionByName(_keyed(more, order_cols, null_tokens, payload))
    order_fields = [F.col(f"_o{i}") for i in range(len(order_cols))]
    first = F.min(F.struct(*order_fields, F.struct(*[F.col(f"`{c}`") for c in payload]).alias("_row")))
    grouped = df.groupBy("order_id", "_key_null").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("_compat_null")).alias("_compat"),
        first.alias("_first"),
    )
    return grouped.select(
        "order_id", "_key_null", "_n", "_compat", *[F.col("_first._row").getField(c).alias(c) for c in payload]
    )


def cleaned_from_groups(finished: DataFrame) -> DataFrame:
    """The cleaned sales table: first rows of complete-key groups whose date
    parsed, from groups that ``finish_sales`` went over."""
    return finished.filter(~F.col("_key_null") & F.col("date").isNotNull()).select(*SALES_COLUMNS)


def metrics_from_groups(groups: DataFrame, date_formats: Sequence[DateFormat] | None = None) -> DataFrame:
    """One row of cleaning counts from ``sales_groups`` output."""
    kept = ~F.col("_key_null")
    typed = isinstance(groups.schema["date"].dataType, (DateType, TimestampType, TimestampNTZType))
    first_date = coerce_date(F.col("date"), date_formats, typed_input=typed)
    stats = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum(F.when(~kept, F.col("_n"))), F.lit(0)).alias("null_key_rows"),
        F.coalesce(F.sum("_compat"), F.lit(0)).alias("_compat_null_rows"),
        F.coalesce(F.sum(F.when(kept, F.col("_n"))), F.lit(0)).alias("_after_nulls"),
        F.count_if(kept).alias("_distinct_ids"),
        F.count_if(kept & first_date.isNull()).alias("bad_date_rows"),
    )
    cleaned = F.col("_distinct_ids") - F.col("bad_date_rows")
    out = stats.select(
        "raw_rows",
        cleaned.alias("cleaned_rows"),
        F.greatest(F.lit(0), F.col("_compat_null_rows")).alias("nulls_removed"),
        F.greatest(F.lit(0), F.col("raw_rows") - F.col("_compat_null_rows") - cleaned).alias("duplicates_removed"),
        "null_key_rows",
        (F.col("_after_nulls") - F.col("_distinct_ids")).alias("duplicate_rows"),
        "bad_date_rows",
    )
    return out.withColumn(
        "retention_pct",
        F.when(F.col("raw_rows") > 0, round_half_up(F.col("cleaned_rows") / F.col("raw_rows") * F.lit(100.0), 1)).otherwise(
            F.lit(100.0)
        ),
    )


def quality_metrics(
    raw: DataFrame | Sequence[DataFrame],
    order_cols: Sequence[str | Column] = ("row_seq",),
    null_tokens: Iterable[str] | None = DEFAULT_NULL_TOKENS,
    date_formats: Sequence[DateFormat] | None = None,
) -> DataFrame:
    """One row of cleaning counts for ``raw`` (the reader's output).  Only
    the first row's date is carried through the grouping."""
    groups = sales_groups(raw, order_cols, null_tokens, payload=("date",))
    return metrics_from_groups(groups, date_formats)


def clean_with_metrics(
    raw: DataFrame | Sequence[DataFrame],
    order_cols: Sequence[str | Column] = ("row_seq",),
    null_tokens: Iterable[str] | None = DEFAULT_NULL_TOKENS,
    date_formats: Sequence[DateFormat] | None = None,
    freeze: bool = True,
    orders: Sequence[DataFrame] | None = None,
    orders_by: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(cleaned table, quality counts) from one grouped pass over ``raw``.

    The groups (one row per distinct id) are cleaned row by row, bad dates
    kept as null.  With ``freeze`` that table is written once as Parquet in the
    shared folder: counts and analyses read the columns they need of it, and
    no date or text is cleaned twice.
    """
    finished = finish_sales(sales_groups(raw, order_cols, null_tokens, orders=orders, orders_by=orders_by), date_formats, drop_bad=False)
    if freeze:
        finished = written_once(finished)
    return cleaned_from_groups(finished), metrics_from_groups(finished, date_formats)
