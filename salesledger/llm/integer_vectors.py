"""Integer inner products of vectors, and blocks of query vectors: what the
exact searches of this subpackage share."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesledger.llm.common import freeze, shared_dir

#: Query vectors, and bytes of their components, that are broadcast at once.
BLOCK, BLOCK_BYTES = 2048, 32 << 20
#: Integers below this are exact as doubles.
EXACT = 2.0**53
#: Scores beyond this count as this.
MOST = 2**61


def usable(vectors: DataFrame) -> DataFrame:
    """The rows that take part, with vec_id long and embedding array<double>:
    vec_id and vector not null, components not null and finite."""
    numbers = vectors.withColumns({"vec_id": F.col("vec_id").cast("long"), "embedding": F.col("embedding").cast("array<double>")})
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return numbers.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)


def in_blocks(queries: DataFrame) -> Iterator[list]:
    """The rows of ``queries``, one per vec_id (the least, by its other columns),
    in blocks of a bounded size, each ordered by vec_id."""
    others = [c for c in queries.columns if c != "vec_id"]
    once = freeze(queries.groupBy("vec_id").agg(F.min(F.struct(*others)).alias("_row")).select("vec_id", "_row.*"))
    n, components = once.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0))).first()
    blocks = max(math.ceil(n / BLOCK), math.ceil(8 * components / BLOCK_BYTES))
    for k in range(blocks):
        rows = once.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).collect()
        if rows:
            yield sorted(rows, key=lambda r: r["vec_id"])


class Table:
    """A table in the shared folder that grows by one block after the other."""

    def __init__(self, spark, schema: str):
        self.spark, self.schema = spark, schema
        self.path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def read(self, any_added: bool) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if any_added else self.spark.createDataFrame([], self.schema)


def by_length(vectors: list) -> dict[int, np.ndarray]:
    """Places of the vectors of each length."""
    sizes = np.array([len(v) for v in vectors], np.int64)
    return {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes)}


def pieces(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, matrix) of a batch's vectors of equal lengths, ``rows`` at a time."""
    lengths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        of_dim = batch if (lengths == dim).all() else batch.take(pa.array(np.flatnonzero(lengths == dim)))
        for at in range(0, of_dim.num_rows, rows):
            some = of_dim.slice(at, rows)
            values = some.column("embedding").flatten().to_numpy(zero_copy_only=False)
            yield int(dim), some, values.reshape(some.num_rows, int(dim))


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles; infinite where that leaves their range."""
    with np.errstate(over="ignore"):
        return np.floor(scale * x.astype(np.float64))


def _safe(scaled: np.ndarray) -> np.ndarray:
    """Rows whose products with each other have exact double sums."""
    return np.abs(scaled).max(axis=1, initial=0.0) < math.sqrt(EXACT / max(1, scaled.shape[1]))


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers."""
    exact = [[int(v) * scale if abs(v) >= EXACT else math.floor(scale * v) for v in row] for row in x.tolist()]
    return np.array(exact, object).reshape(x.shape)


def scores(left: np.ndarray, right: np.ndarray, scale: int) -> np.ndarray:
    """Inner product of floor(scale * row) for each row of left and right, as
    int64. Whole numbers that a double cannot hold exactly are multiplied as
    Python integers; products beyond 2**61 count as 2**61."""
    a, b = floors(left, scale), floors(right, scale)
    safe_a, safe_b = _safe(a), _safe(b)
    if safe_a.all() and safe_b.all():
        return (a @ b.T).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    out[np.ix_(safe_a, safe_b)] = (a[safe_a] @ b[safe_b].T).astype(np.int64)
    for rows, columns in ((~safe_a, np.ones(len(b), bool)), (safe_a, ~safe_b)):
        if rows.any() and columns.any():
            exact = np.dot(_whole(left[rows], scale), _whole(right[columns], scale).T)
            out[np.ix_(rows, columns)] = np.clip(exact, -MOST, MOST).astype(np.int64) if left.shape[1] else 0
    return out


def best(owner: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each owner: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    first = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0)) if len(own) else np.zeros(0, np.int64)
    return order[np.arange(len(own)) - start < k]


def norm(scale: int) -> Column:
    """A bound of the length of floor(scale * embedding), as a double."""
    return F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, v: total + F.pow(F.abs(F.lit(float(scale)) * v) + 1.0, 2.0)))
