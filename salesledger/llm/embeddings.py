"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction, the concatenation of one codeword per block of a
randomly rotated space (a structured random product code). A vector passes
every filter whose direction it comes near enough to; the code's structure
lets a vector list all of them without trying each. Vectors are joined on
filters, and what meets is verified by its cosine in double precision.

The filter threshold rises with the number of vectors, so that a filter holds
about ``PER_FILTER`` unrelated vectors at every size, and the codebooks grow so
that each vector still passes about ``FILTERS`` of them. The share of a cap is
that of the sphere of the vectors' own dimension. The filters come from several
codes, each with its own rotation, and codes are added until trial links at the
least cosine meet. In each code a vector that passes few filters, or none, gets
its best ones.

Links are never written out as pairs. A task turns what it found in a filter
into one spanning link per vector; components follow from those. The number of
links is then counted inside each component, in blocks of bounded size, and
there every pair is compared, also one that shared no filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from salesledger.llm.common import freeze, group_slices, whole_groups
from salesledger.llm.components import connected_components, local_roots

COSINE = 0.95
#: Filters that a vector passes on average in the first ``LEAST_CODES`` codes,
#: and the unrelated vectors that a filter holds.
FILTERS = 64
PER_FILTER = 128
#: Codes are added until this share of ``TRIAL`` links at ``COSINE`` meets.
RECALL = 0.995
TRIAL = 2000
LEAST_CODES, MOST_CODES = 4, 64
#: Filters that a vector is given in each code at least.
LEAST = 8
SEED = 7
#: Cosine that a filter asks for at most: both ends of a link (18 degrees at
#: most) fit its cap.
WIDEST = 0.9
#: Steps in which the share of a cap is integrated over its angle.
ANGLES = 200_000
#: Rows of one filter or component that are compared as a block.
BLOCK = 1024
KEYS = ["key", "i", "j"]


def _cap(dim: int, share: float) -> tuple[float, float]:
    """(threshold, share) of the cap that holds ``share`` of the unit sphere.

    In few dimensions such a cap can be narrower than a link is long; it is then
    widened to ``WIDEST``, and holds a larger share. On a line it is a half."""
    if dim == 1:
        return 0.5, 0.5
    angle = (np.arange(ANGLES) + 0.5) * (math.pi / ANGLES)
    inside = np.cumsum(np.sin(angle) ** (dim - 2))
    inside /= inside[-1]
    at = max(int(np.searchsorted(inside, share)), int(np.searchsorted(angle, math.acos(WIDEST))))
    return math.cos(angle[at]), float(inside[at])


class ProductCode:
    """Several independent codes. Their number follows from the share of trial
    links, at the least cosine that counts, whose ends meet in a filter."""

    def __init__(self, dim: int, n_vectors: int):
        self.dim = dim
        rng = np.random.default_rng(SEED)
        a = _unit(rng.standard_normal((TRIAL, dim)))
        b = a
        if dim > 1:
            side = rng.standard_normal((TRIAL, dim))
            b = COSINE * a + math.sqrt(1 - COSINE**2) * _unit(side - (side * a).sum(axis=1, keepdims=True) * a)
        self.codes: list[_Code] = []
        met = np.zeros(TRIAL, bool)
        while len(self.codes) < MOST_CODES and (len(self.codes) < LEAST_CODES or met.mean() < RECALL):
            code = _Code(rng, dim, n_vectors)
            self.codes.append(code)
            for at in range(0, TRIAL, 256):
                rows = slice(at, at + 256)
                ends = [row * code.size + found for row, found in (code.passed(x[rows]) for x in (a, b))]
                met[at + np.intersect1d(*ends, assume_unique=True) // code.size] = True
        self.recall = float(met.mean())

    def passed(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for every filter that a row of ``unit`` passes."""
        rows, keys, before = [], [], 0
        for code in self.codes:
            row, found = code.passed(unit)
            rows.append(row)
            keys.append(before + found)
            before += code.size
        return np.concatenate(rows), np.concatenate(keys)


class _Code:
    """Directions made of ``blocks`` codewords each, in ``dim`` dimensions."""

    def __init__(self, rng: np.random.Generator, dim: int, n_vectors: int):
        self.threshold, share = _cap(dim, min(0.05, PER_FILTER / max(1, n_vectors)))
        wanted = FILTERS / LEAST_CODES
        filters = wanted / share
        self.blocks = 1
        while filters ** (1 / self.blocks) > 512 and (self.blocks + 1) * 8 <= dim:
            self.blocks += 1
        self.words = math.ceil(filters ** (1 / self.blocks))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        edges = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        trial = _unit(rng.standard_normal((256, dim)))
        while True:  # codewords are drawn, so their caps may hold fewer than their share
            self.books = [_book(rng, self.words, part.stop - part.start, dim) for part in self.parts]
            passed = len(self._above(self._scores(trial))[0]) / len(trial)
            if passed >= wanted or self.words > 4096:
                break
            self.words = max(self.words + 1, math.ceil(self.words * (wanted / max(1.0, passed)) ** (1 / self.blocks)))
        self.size = self.words**self.blocks

    def passed(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for every filter that a row of ``unit`` passes; a row
        that passes under ``LEAST`` gets its best ones instead."""
        scores = self._scores(unit)
        row, found = self._above(scores)
        few = np.flatnonzero(np.bincount(row, minlength=len(unit)) < LEAST)
        if not len(few):
            return row, found
        enough = ~np.isin(row, few)
        best = self._best([s[few] for s in scores])
        return np.concatenate([row[enough], np.repeat(few, best.shape[1])]), np.concatenate([found[enough], best.ravel()])

    def _scores(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.rotation
        return [turned[:, part] @ book.T for part, book in zip(self.parts, self.books, strict=True)]

    def _above(self, scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = len(scores[0])
        best = np.stack([s.max(axis=1) for s in scores], axis=1)
        rest = np.concatenate([np.cumsum(best[:, ::-1], axis=1)[:, ::-1][:, 1:], np.zeros((n, 1))], axis=1)
        row, total, code = np.arange(n), np.zeros(n), np.zeros(n, np.int64)
        for k, s in enumerate(scores):
            sums = total[:, None] + s[row]
            at, word = np.nonzero(sums >= self.threshold - rest[row, k][:, None])
            row, total, code = row[at], sums[at, word], code[at] * self.words + word
        return row, code

    def _best(self, scores: list[np.ndarray]) -> np.ndarray:
        """The ``LEAST`` best filters of each row: the best sums of k + 1 blocks
        begin with best sums of k."""
        total, code = np.zeros((len(scores[0]), 1)), np.zeros((len(scores[0]), 1), np.int64)
        for s in scores:
            sums = (total[:, :, None] + s[:, None, :]).reshape(len(s), -1)
            codes = (code[:, :, None] * self.words + np.arange(self.words)).reshape(len(s), -1)
            top = np.argpartition(-sums, min(LEAST, sums.shape[1]) - 1, axis=1)[:, :LEAST]
            total, code = np.take_along_axis(sums, top, axis=1), np.take_along_axis(codes, top, axis=1)
        return code


def _book(rng: np.random.Generator, words: int, part: int, dim: int) -> np.ndarray:
    book = rng.standard_normal((words, part))
    return book / np.linalg.norm(book, axis=1, keepdims=True) * math.sqrt(part / dim)


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of huge or tiny components stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _filters(code: ProductCode):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                row, found = code.passed(_unit(_matrix(some.column("embedding"), code.dim)))
                yield pa.RecordBatch.from_arrays([some.column("cls").take(pa.array(row)), pa.array(found)], ["cls", "key"])

    return run


def _blocks(members: DataFrame, vectors: DataFrame, keep: list[str]) -> DataFrame:
    """Members (key, cls) of groups with two or more, dealt out as pairs of
    blocks (i, j), with ``keep`` of ``vectors``, sorted for whole_groups."""
    sizes = freeze(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    dealt = (
        members.join(sizes, "key")
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls")
    )
    return dealt.join(vectors.select("cls", *keep), "cls").repartition(*KEYS).sortWithinPartitions(*KEYS)


def _sides(table: pa.Table, start: int, stop: int, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the two blocks of a group, and which pairs are linked."""
    block = table.column("block").slice(start, stop - start).to_numpy()
    i, j = table.column("i")[start].as_py(), table.column("j")[start].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    linked = unit[start + left] @ unit[start + right].T >= COSINE
    if i == j:
        np.fill_diagonal(linked, False)
    return left, right, linked


def _spanning(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, KEYS):
            cls, unit = table.column("cls").to_numpy(), _unit(_matrix(table.column("embedding"), dim))
            src, dst = [], []
            for start, stop in group_slices(table, KEYS):
                left, right, linked = _sides(table, start, stop, unit)
                rows, cols = np.nonzero(linked)
                src.append(start + left[rows])
                dst.append(start + right[cols])
            own, at = np.unique(cls, return_inverse=True)
            root = local_roots(len(own), at[np.concatenate(src)], at[np.concatenate(dst)])
            moved = np.flatnonzero(root != np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[root[moved]])], ["src", "dst"])

    return run


def _degrees(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, KEYS):
            unit, weight = _unit(_matrix(table.column("embedding"), dim)), table.column("w").to_numpy()
            count = np.zeros(table.num_rows, np.int64)
            for start, stop in group_slices(table, KEYS):
                left, right, linked = _sides(table, start, stop, unit)
                count[start + left] += linked.astype(np.float64).dot(weight[start + right]).astype(np.int64)
                if table.column("i")[start].as_py() != table.column("j")[start].as_py():
                    count[start + right] += linked.T.astype(np.float64).dot(weight[start + left]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([table.column("cls").combine_chunks(), pa.array(count)], ["cls", "n"])

    return run


def _of_length(equal: DataFrame, dim: int, n: int) -> DataFrame:
    """(cls, n_links, component_id) for distinct vectors of one length, where
    they link with another distinct vector."""
    passed = freeze(equal.select("cls", "embedding").mapInArrow(_filters(ProductCode(dim, n)), "cls long, key long"))
    links = _blocks(passed, equal, ["embedding"]).mapInArrow(_spanning(dim), "src long, dst long")
    labels = connected_components(links)
    component = freeze(labels.groupBy("label").agg(F.min("id").alias("key")))
    members = freeze(labels.join(component, "label").select("key", F.col("id").alias("cls")))
    counts = _blocks(members, equal, ["embedding", "w"]).mapInArrow(_degrees(dim), "cls long, n long").groupBy("cls").agg(F.sum("n").alias("others"))
    return members.join(counts, "cls").select("cls", "others", F.col("key").alias("component_id"))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links
    (other vectors at cosine 0.95 or more), component_id (least vec_id
    reachable over links), kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing. Vectors of different lengths are never compared. Equal
    vectors are compared once and counted as often as they occur; rows that
    repeat a vec_id count as different vectors. A null vec_id links with
    nothing, its component and kept are null. Other columns are ignored; an
    empty table gives an empty result.
    """
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    numbers = F.col("embedding").cast("array<float>" if single else "array<double>")  # double ones keep their range and digits
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = freeze(x.select("vec_id", F.when(usable, F.col("embedding")).alias("embedding")))
    equal = freeze(rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("w")).withColumn("dim", F.size("embedding")))
    rows_of_cls = equal.select("embedding", "cls", "w")
    per_class = None
    for dim, n in sorted((r["dim"], r["n"]) for r in equal.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()):
        part = _of_length(equal.where(F.col("dim") == dim), dim, n)
        per_class = part if per_class is None else per_class.unionByName(part)
    if per_class is None:
        per_class = equal.select("cls", F.lit(0).cast("long").alias("others"), F.col("cls").alias("component_id"))
    found = freeze(
        rows_of_cls.join(per_class, "cls", "left").select("embedding", (F.coalesce("others", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component_id", "cls").alias("component_id"))
    )
    linked = rows.where("embedding is not null").join(found, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
