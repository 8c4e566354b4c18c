"""Header normalisation: map free-form CSV headers onto canonical names.

Pure metadata work on ``df.columns``; the plan gets one ``select`` with
aliases and no data is touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted spellings of each sales column, after the sales key
# function (strip, lower case, '_' and '-' to space).
SALES_ALIASES: dict[str, tuple[str, ...]] = {
    "order_id": ("order id", "orderid", "id", "transaction id"),
    "date": ("date", "order date", "transaction date", "created at"),
    "revenue": ("revenue", "sales", "total sales", "total revenue", "amount"),
    "product": ("product", "item", "product name", "item name"),
    "region": ("region", "territory", "location"),
    "category": ("category", "product category"),
    "quantity": ("quantity", "qty", "units"),
    "unit_price": ("unit price", "price", "rate"),
}

# Accepted spellings of each ledger import column, after the
# ledger key function (strip, lower case, '_' and spaces removed).
LEDGER_ALIASES: dict[str, tuple[str, ...]] = {
    "amount": ("amount", "spent", "cost", "price"),
    "category": ("category", "type", "cat"),
    "description": ("description", "desc", "notes", "title"),
    "date": ("date", "when", "createdat", "time"),
}

SALES_REQUIRED = ("order_id", "date", "revenue")
LEDGER_REQUIRED = ("amount", "category", "date")


def sales_header_key(name: str) -> str:
    return str(name).strip().lower().replace("_", " ").replace("-", " ")


def ledger_header_key(name: str) -> str:
    return str(name).strip().lower().replace("_", "").replace(" ", "")


def header_mapping(
    columns: Iterable[str],
    aliases: Mapping[str, Iterable[str]],
    key: Callable[[str], str],
) -> dict[str, str]:
    """source column → canonical name, for the columns that match an alias.

    Two source columns landing on one canonical name is an error: there is
    no right answer for which one to keep.
    """
    lookup: dict[str, str] = {}
    for canonical, spellings in aliases.items():
        for s in spellings:
            lookup.setdefault(s, canonical)
    mapping: dict[str, str] = {}
    seen: dict[str, str] = {}
    for col in columns:
        canonical = lookup.get(key(col))
        if canonical is None:
            continue
        if canonical in seen:
            raise ValueError(
                f"Ambiguous headers: {seen[canonical]!r} and {col!r} both map to {canonical!r}"
            )
        seen[canonical] = col
        mapping[col] = canonical
    return mapping


def normalize_headers(
    df: DataFrame,
    aliases: Mapping[str, Iterable[str]] = SALES_ALIASES,
    key: Callable[[str], str] = sales_header_key,
) -> DataFrame:
    """Rename matching columns to canonical names; others pass through.

    A pass-through column that already carries a canonical name which some
    other column also maps to is dropped in favour of the mapped one.
    """
    mapping = header_mapping(df.columns, aliases, key)
    targets = set(mapping.values())
    cols = []
    for c in df.columns:
        if c in mapping:
            cols.append(F.col(f"`{c}`").alias(mapping[c]))
        elif c not in targets:
            cols.append(F.col(f"`{c}`"))
    return df.select(*cols)


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """``df`` if it has every ``required`` column, else an error that names
    what the header row lacks and what it holds."""
    absent = sorted(set(required).difference(df.columns))
    if absent:
        raise ValueError(f"no column maps to {', '.join(absent)}; the header row gives {', '.join(df.columns)}")
    return df
