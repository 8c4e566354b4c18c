"""Text expressions with Python string semantics, as Column expressions.

All of these compile to JVM expressions (codegen); no Python UDF is involved.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesledger.functions._col import as_col

# The characters Python's ``str.strip()`` treats as whitespace
# (``str.isspace``), as code points.
PY_WHITESPACE_CODEPOINTS = (
    list(range(0x09, 0x0E))
    + list(range(0x1C, 0x21))
    + [0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
PY_WHITESPACE = "".join(chr(c) for c in PY_WHITESPACE_CODEPOINTS)

# Cell texts that a CSV reader in the pandas default dialect
# turns into a missing value (matched against the whole cell, unstripped).
DEFAULT_NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# A run of cased characters (upper, lower or title case, as Unicode's Cased
# property) or a run of anything else; title case capitalises the first
# character of every cased run.  Uncased letters (CJK, for one) end a word.
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{IsTitlecase}"
_WORD_OR_GAP = rf"([{_CASED}]+|[^{_CASED}]+)"


def strip_ws(c: Column | str) -> Column:
    """``str.strip()``: drop leading/trailing whitespace of every kind.

    ``trim`` only removes spaces; ``btrim`` with the explicit character set
    keeps this a simple JVM string op (no regex).
    """
    return F.btrim(as_col(c), F.lit(PY_WHITESPACE))


def title_case(c: Column | str) -> Column:
    """``str.title()``: upper-case the first letter after any uncased character,
    lower-case the rest (``Men'S T-Shirt``, ``Usa 3D``).

    ``initcap`` only breaks words at spaces, so split into cased / uncased
    runs and ``initcap`` each run.
    """
    runs = F.regexp_extract_all(as_col(c), F.lit(_WORD_OR_GAP), 1)
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def null_tokens_to_null(c: Column | str, tokens: Iterable[str | Column] = DEFAULT_NULL_TOKENS) -> Column:
    """Whole-cell null tokens (``NA``, ``N/A``, ``None``, ``null`` …) → null.
    ``tokens`` may be literal columns, to share them across many columns."""
    col = as_col(c)
    return F.when(col.isin(list(tokens)), F.lit(None).cast("string")).otherwise(col)


def strip_replacement_chars(c: Column | str) -> Column:
    """Undecodable input bytes become U+FFFD in Spark's reader; decoding with
    ``errors='ignore'`` semantics drops them instead."""
    # a character map, not a regex: this runs on every text cell of an upload
    return F.translate(as_col(c), "\ufffd", "")


def contains_ci(haystack: Column | str, needle: str) -> Column:
    """Case-insensitive literal substring test (no LIKE escapes)."""
    return F.contains(F.lower(as_col(haystack)), F.lit(needle.lower()))
