"""A "Total" row under a small table: sums of the shown rows for additive
columns (shares included), the label in the first column, other columns
null.  ``row_kind`` tells data rows from the total row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from salesledger.functions import money_total


def with_total_row(df: DataFrame, label_col: str, sum_cols: Sequence[str], label: str = "Total") -> DataFrame:
    """``df`` plus one total row.  Floating columns are summed exactly as
    money decimals so the total does not depend on row order."""
    types = {f.name: f.dataType for f in df.schema}
    aggs = []
    for c in sum_cols:
        whole = isinstance(types[c], DecimalType) and types[c].scale == 0
        if isinstance(types[c], (DoubleType, FloatType, DecimalType)) and not whole:
            aggs.append(F.coalesce(money_total(c).cast(types[c]), F.lit(0).cast(types[c])).alias(c))
        else:
            aggs.append(F.coalesce(F.sum(c), F.lit(0)).cast(types[c]).alias(c))
    total = df.agg(*aggs)
    others = [c for c in df.columns if c not in sum_cols]
    total = total.select(
        *[
            (F.lit(label).cast(types[c]) if c == label_col else F.lit(None).cast(types[c])).alias(c)
            for c in others
        ],
        *sum_cols,
    ).select(*df.columns)
    return df.withColumn("row_kind", F.lit("row")).unionByName(total.withColumn("row_kind", F.lit("total")))
