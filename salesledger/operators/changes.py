"""Batch changes to the ledger: insert, update by id, delete by id, and the
ids of a change set that do not exist.

Single-row edits are the one-row case of these.  Joins are on the unique
``id`` key; Spark and AQE choose each join from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from salesledger.functions import coerce_date, coerce_number, strip_ws

LEDGER_FIELDS = ("id", "amount", "category", "description", "date")


def normalize_changes(changes: DataFrame, order_col: str | None = None) -> DataFrame:
    """Write-side rules: text stripped, amount as double, missing
    description as ''.  An id, amount or date given as text that is none
    becomes null.  ``order_col`` is kept as ``_order``."""
    kept = [F.col(order_col).alias("_order")] if order_col else []
    text = {f.name for f in changes.schema if isinstance(f.dataType, StringType)}
    return changes.select(
        *kept,
        (strip_ws("id").try_cast("bigint") if "id" in text else F.col("id").cast("bigint")).alias("id"),
        coerce_number("amount", numeric_input="amount" not in text).alias("amount"),
        strip_ws(F.col("category").cast("string")).alias("category"),
        F.coalesce(strip_ws(F.col("description").cast("string")), F.lit("")).alias("description"),
        coerce_date("date", typed_input="date" not in text).alias("date"),
    )


def valid_changes(changes: DataFrame) -> DataFrame:
    """Rows an edit form would accept: positive amount, category and date set."""
    return changes.filter((F.col("amount") > 0) & F.col("category").isNotNull() & F.col("date").isNotNull())


def latest_changes(changes: DataFrame, order_col: str | None = None, only_valid: bool = False) -> DataFrame:
    """One change per id: the last by ``order_col``, as if applied in turn;
    ``only_valid`` leaves out what an edit form would not accept.

    Without an order a repeated id has no last change; the greatest of its
    rows by (date, amount, category, description) stands then, so that the
    result does not depend on partitioning.
    """
    rows = normalize_changes(changes, order_col)
    rows = valid_changes(rows) if only_valid else rows
    order = [F.col("_order")] if order_col else []
    last = F.max(F.struct(*order, "date", "amount", "category", "description")).alias("_last")
    return rows.groupBy("id").agg(last).select("id", *[F.col(f"_last.{c}").alias(c) for c in LEDGER_FIELDS if c != "id"])


def apply_updates(ledger: DataFrame, changes: DataFrame, order_col: str | None = None, only_valid: bool = False) -> DataFrame:
    """Rows of ``ledger`` whose id is in ``changes`` take the new values;
    unknown ids are ignored (see ``missing_ids``).  Of several changes for an
    id the last counts (see ``latest_changes``).  ``only_valid`` leaves out
    what an edit form would not accept.  Spark picks the join from sizes."""
    ch = latest_changes(changes, order_col, only_valid)
    ch = ch.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in LEDGER_FIELDS if c != "id"])
    joined = ledger.join(ch, "id", "left")
    hit = F.col("_hit").isNotNull()
    return joined.select(
        "id",
        *[F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in LEDGER_FIELDS if c != "id"],
    )


def delete_ids(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """``ledger`` without the rows whose id is in ``ids``."""
    return ledger.join(ids.select("id").distinct(), "id", "left_anti")


def _change_ids(changes: DataFrame) -> DataFrame:
    return changes.select(F.col("id").cast("bigint").alias("id")).distinct()


def existing_ids(changes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ids named by a change set that the ledger holds."""
    return _change_ids(changes).join(ledger.select("id"), "id", "left_semi")


def missing_ids(changes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ids named by a change set that the ledger does not hold: one anti join."""
    return _change_ids(changes).join(ledger.select("id"), "id", "left_anti")


def insert_rows(ledger: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Append already-numbered rows (see ``assign_ids``)."""
    return ledger.select(*LEDGER_FIELDS).unionByName(new_rows.select(*LEDGER_FIELDS))
