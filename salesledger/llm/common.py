"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Buckets by which ``rank_within`` and ``running_total`` deal out one group.
ORDER_BUCKETS = 4096
#: A word is a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_SPACE = " \t\n\x0b\f\r"
#: Rows that travel to a Python worker in one batch (long texts: few rows).
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of a column of texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    A scratch folder takes its place only in a local session that names none;
    on a cluster a missing setting is an error.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="llm-shared-")
    spark.conf.set(CHECKPOINT_CONF, named)
    return named


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, keeps column pruning
    and gives the planner real sizes. The folder is the cluster's to clean.
    """
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WORD_SPACE, " " * len(WORD_SPACE))
    return F.array_remove(F.split(spaced, " "), "")


def n_words(text: Column) -> Column:
    """Number of words, as a long; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def order_bucket(order_hash: Column) -> Column:
    """Top bits of a 64-bit hash, so that buckets follow the hash's order
    (negative hashes come first, as in a sort)."""
    return F.shiftright(order_hash, 64 - ORDER_BUCKETS.bit_length() + 1)


def _offsets(df: DataFrame, group: list[str], bucket: str, amount: Column) -> DataFrame:
    per_bucket = df.groupBy(*group, bucket).agg(amount.alias("_n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select(*group, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_before"))


def running_total(df: DataFrame, group: list[str], order: list[str], bucket: str, amount: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over the rows of the same group
    that come earlier by ``order``.

    ``bucket`` must not decrease along ``order``; it deals one group out over
    many tasks: a total per (group, bucket), offsets over those few rows, and
    a running sum inside each bucket. ``df`` is read twice, so freeze it first.
    Group columns must not be null.
    """
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn(name, F.coalesce(F.sum(amount).over(inner), F.lit(0)).cast("long"))
    joined = within.join(_offsets(df, group, bucket, F.sum(amount)), [*group, bucket])
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def rank_within(df: DataFrame, group: list[str], order: list[str], bucket: str, name: str) -> DataFrame:
    """Add ``name``: the row's place (from 0) in its group by ``order``; see
    :func:`running_total` for how a hot group is dealt out."""
    return running_total(df.withColumn("_one", F.lit(1)), group, order, bucket, "_one", name).drop("_one")


def whole_groups(batches, keys: list[str], rows: int = 8192):
    """Arrow tables made of whole groups, from batches sorted by ``keys``.

    Holds about ``rows`` rows, or one group where that is larger, so callers
    bound their groups.
    """
    import numpy as np
    import pyarrow as pa

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        last = np.ones(size, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            last &= column == column[-1]
        whole = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if whole:
            yield table.slice(0, whole)
        held, size = table.slice(whole).to_batches(), size - whole
    if held:
        yield pa.Table.from_batches(held)


def group_slices(table, keys: list[str]):
    """(start, stop) of each group in a table sorted by ``keys``."""
    import numpy as np

    change = np.zeros(max(0, table.num_rows - 1), bool)
    for k in keys:
        column = table.column(k).to_numpy()
        change |= column[1:] != column[:-1]
    edges = np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
