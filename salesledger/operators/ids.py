"""Id assignment for inserted rows, without a single-partition window.

Ids continue from a high-water mark and follow an order of the rows.

``assign_ids`` takes any order: the rows are range-partitioned and sorted (a
balanced, spill-safe shuffle), tagged with (partition, position in partition)
and checkpointed to the shared checkpoint folder. The checkpoint matters: range
bounds come from a random sample, so two evaluations may cut partitions
differently; counting and numbering must see one frozen copy.

``assign_ids_in_place`` takes rows in the order of the files they are read from,
or of files that were written from those in their order.
No row moves: a first pass counts the rows of each split, running sums over
that table (one row a split) give each split its first id, and a second pass adds
a row's place in its split. Both passes must see the same splits; a row whose
split was not counted raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesledger.session import ensure_checkpoint_dir, written_once

# A piece of a split: one task's rows of it from one place of the files that it reads
# (a split that was written anew may come back in several).
_PIECE = ["_pid", "_path", "_from", "_file", "_block"]
_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | row in partition
#: Splits up to which their first ids (some 30 bytes each) are broadcast.
MOST_SPLITS = 1_000_000


def assign_ids(
    df: DataFrame,
    start_after: int | Column,
    order_cols: Sequence[str | Column],
    id_col: str = "id",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``id_col`` = start_after + 1, + 2, … in ``order_cols`` order.

    ``order_cols`` should be unique per row (e.g. the reader's ``row_seq``);
    ties get ids in an arbitrary but stable order.
    """
    tagged, offsets = _ordered(df, order_cols, num_partitions)
    out = tagged.join(F.broadcast(offsets), "_pid").withColumn(id_col, _after(start_after) + F.col("_base") + F.col("_local") + F.lit(1))
    return out.drop("_pid", "_local", "_base", "_n")


def number_rows(df: DataFrame, order_cols: Sequence[str | Column]) -> tuple[DataFrame, int]:
    """``assign_ids`` after 0, and the number of rows."""
    tagged, offsets = _ordered(df, order_cols, None)
    n = offsets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    out = tagged.join(F.broadcast(offsets), "_pid").withColumn("id", F.col("_base") + F.col("_local") + F.lit(1))
    return out.drop("_pid", "_local", "_base", "_n"), n


def _ordered(df: DataFrame, order_cols: Sequence[str | Column], num_partitions: int | None) -> tuple[DataFrame, DataFrame]:
    """(rows with _pid and _local, (_pid, _n, _base) with a row per partition)."""
    if not order_cols:
        raise ValueError("assign_ids needs an explicit row order")
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    mid = F.monotonically_increasing_id()
    ensure_checkpoint_dir(spark)
    tagged = (
        ordered.withColumn("_pid", F.spark_partition_id())
        .withColumn("_local", mid.bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .checkpoint(eager=True)
    )
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a global window here is over ≤ n rows
    return tagged, counts.withColumn("_base", _sum_before("_pid"))


def _sum_before(*order: str) -> Column:
    return F.coalesce(F.sum("_n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")


def _after(start_after: int | Column) -> Column:
    return (start_after if isinstance(start_after, Column) else F.lit(int(start_after))).cast("long")


def assign_ids_in_place(df: DataFrame, start_after: int | Column, id_col: str = "id", seq: str = "row_seq") -> DataFrame:
    """Add ``id_col`` = start_after + 1, + 2, … in file order.

    ``df`` must come straight from scans, by row-wise steps alone, with a ``seq`` =
    struct(file, block, pos) that follows each scan's order; without ``pos`` a split must
    be read in one piece. Beyond ``MOST_SPLITS`` splits the
    rows are ordered by ``assign_ids``."""
    placed, offsets = _placed(df, seq)
    if offsets is None:
        return assign_ids(df, start_after, [seq], id_col)
    return _in_place(placed, offsets, start_after, id_col)


def number_in_place(df: DataFrame, seq: str = "row_seq") -> tuple[DataFrame, int]:
    """``assign_ids_in_place`` after 0, and the number of rows."""
    placed, offsets = _placed(df, seq)
    if offsets is None:
        return number_rows(df, [seq])
    n = offsets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return _in_place(placed, offsets, 0, "id"), n


def _placed(df: DataFrame, seq: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows with their piece and place, a row per piece: _n, _first, _base)."""
    at = {"_file": F.col(f"{seq}.file"), "_block": F.col(f"{seq}.block"), "_pid": F.spark_partition_id(), "_path": F.input_file_name(), "_from": F.input_file_block_start()}
    placed = df.withColumns(at | {"_mid": F.monotonically_increasing_id()})
    least = F.min(f"{seq}.pos") if "pos" in df.schema[seq].dataType.fieldNames() else F.lit(0)
    counts = written_once(placed.groupBy(*_PIECE).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"), least.alias("_at")))
    if counts.count() > MOST_SPLITS:
        return placed, None
    return placed, counts.withColumn("_base", _sum_before("_file", "_block", "_at"))


def _in_place(placed: DataFrame, offsets: DataFrame, start_after: int | Column, id_col: str) -> DataFrame:
    joined = placed.join(F.broadcast(offsets.select(*_PIECE, "_first", "_base")), _PIECE, "left")
    changed = F.raise_error(F.concat(F.lit("the splits of the input changed while its rows were numbered: "), F.col("_file")))
    place = F.when(F.col("_base").isNull(), changed.cast("long")).otherwise(F.col("_base") + F.col("_mid") - F.col("_first"))
    return joined.withColumn(id_col, _after(start_after) + place + F.lit(1)).drop(*_PIECE, "_mid", "_first", "_base")
