"""Column expressions with the exact semantics the operators rely on."""

from salesledger.functions.dates import (
    coerce_date,
    coerce_timestamp,
    day_str,
    month_key,
)
from salesledger.functions.numeric import (
    MONEY_DECIMAL,
    coerce_int,
    coerce_number,
    count_total,
    money_parts,
    money_total,
    total_of_parts,
    money_sum,
    round_half_even,
    round_half_up,
    safe_ratio,
    share_pct,
)
from salesledger.functions.text import (
    DEFAULT_NULL_TOKENS,
    contains_ci,
    null_tokens_to_null,
    strip_replacement_chars,
    strip_ws,
    title_case,
)

__all__ = [
    "DEFAULT_NULL_TOKENS",
    "MONEY_DECIMAL",
    "coerce_date",
    "coerce_int",
    "coerce_number",
    "coerce_timestamp",
    "contains_ci",
    "count_total",
    "day_str",
    "money_parts",
    "money_total",
    "total_of_parts",
    "money_sum",
    "month_key",
    "null_tokens_to_null",
    "round_half_even",
    "round_half_up",
    "safe_ratio",
    "share_pct",
    "strip_replacement_chars",
    "strip_ws",
    "title_case",
]
