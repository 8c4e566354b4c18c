"""Share of total.

The grand total is a scalar subquery over the grouped table, not a join:
no cross product is planned and nothing is broadcast, whatever the number
of groups.  The grouped table (one row per group) is first frozen with a
reliable checkpoint, so the subquery and the main plan both read that copy
instead of each scanning and aggregating the facts again; the checkpoint
also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger.functions import money_total, share_pct
from salesledger.session import ensure_checkpoint_dir


def with_share(
    grouped: DataFrame,
    part_col: str,
    out_col: str = "share_pct",
    digits: int = 2,
    total_col: str | None = None,
    freeze: bool = True,
) -> DataFrame:
    """Add ``out_col`` = part / grand total × 100, half-even rounded.

    ``total_col`` names the column to total; by default the part column
    itself.  Totals ≤ 0 give 0.0.
    """
    src = total_col or part_col
    if freeze:
        ensure_checkpoint_dir(grouped.sparkSession)
        grouped = grouped.checkpoint(eager=True)
    total = grouped.select(money_total(src)).scalar()
    return grouped.withColumn(out_col, share_pct(F.col(part_col), total, digits))
