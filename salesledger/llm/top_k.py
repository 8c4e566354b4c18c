"""Exact top-k search by distributed histogram selection.

A block of queries is broadcast. Every task scores all its rows against the
block and counts scores in bins per query; the counts are summed over all tasks,
which gives the bin that holds the k-th best score. Where that bin and those
above hold many rows, the bin is cut into bins again and all rows are counted
anew, down to a single score if need be. Then one more pass lets through the
scores from the bin on, and ties are broken by the smaller id.

Blocks have a bounded size, so the broadcast does not grow with the data. A
task's counts below its own k-th best are never needed (the k-th best of all
rows is no less), and of the rows that it lets through only its own k best can
be in the result; so what it sends is bounded by k rows a query in each pass,
also where a third of all rows ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesledger.llm.common import freeze
from salesledger.llm.integer_vectors import MOST, Table, best, by_length, floors, in_blocks, norm, pieces, scores, usable

BINS = 1024
#: Rows from the k-th best score's bin on that end the refinement, for each of k.
ENOUGH = 8
#: Rows that a task scores at once against the block.
ROWS = 512
#: Rows that a task gathers before it drops those beyond its own k best.
HELD = 200_000
RESULT = "query_id long, rank int, vec_id long, score long"


def _scored(batches: Iterator[pa.RecordBatch], block: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of the queries, ids, scores) of rows against the queries of
    their length."""
    for batch in batches:
        for dim, some, matrix in pieces(batch, ROWS):
            if dim in block["vectors"]:
                places, vectors = block["vectors"][dim]
                yield places, some.column("vec_id").to_numpy(), scores(matrix, vectors, block["scale"])


def _count(shared, lo: np.ndarray, hi: np.ndarray, width: np.ndarray, wanted: np.ndarray):
    """(query, wanted, bin, n) over the scores of [lo, hi] in bins of a width; bin
    0 is the highest. wanted: how many scores of that range are looked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        counts = np.zeros((len(lo), BINS), np.int64)
        for places, ids, score in _scored(batches, block):
            looked = wanted[places] > 0
            places, score = places[looked], score[:, looked]
            at = (score - lo[places]) // width[places]
            inside = (score >= lo[places]) & (score <= hi[places]) & (ids[:, None] != block["ids"][places][None, :])
            row, column = np.nonzero(inside)
            own = np.bincount(column * BINS + BINS - 1 - at[row, column], minlength=len(places) * BINS)
            counts[places] += own.reshape(len(places), BINS)
        before = np.cumsum(counts, axis=1) - counts
        query, bin_ = np.nonzero((counts > 0) & (before < wanted[:, None]))
        columns = [query.astype(np.int32), wanted[query], bin_.astype(np.int32), counts[query, bin_]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "wanted", "bin", "n"])

    return run


def _let_through(shared, least: np.ndarray, k: int):
    """(query_id, vec_id, score) of scores from ``least`` on, a task's k best
    of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for places, ids, score in _scored(batches, block):
            row, column = np.nonzero((score >= least[places]) & (ids[:, None] != block["ids"][places][None, :]))
            held.append((places[column], ids[row], score[row, column]))
            n += len(row)
            if n > HELD:
                held = [_cut(held, k)]
                n = 0
        if held:
            query, ids, score = _cut(held, k)
            yield pa.RecordBatch.from_arrays([pa.array(block["ids"][query]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def _cut(held: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    query, ids, score = (np.concatenate(c) for c in zip(*held, strict=True))
    top = best(query, ids, score, k)
    return query[top], ids[top], score[top]


def _kth_scores(rows: DataFrame, shared, block: dict, longest: float, k: int) -> np.ndarray:
    """For each query a score that its k-th best is no less than, with few rows
    from there on."""
    n = len(block["ids"])
    most = np.zeros(n)
    for places, vectors in block["vectors"].values():
        with np.errstate(over="ignore"):
            most[places] = np.sqrt((floors(vectors, block["scale"]) ** 2).sum(axis=1)) * longest * (1 + 1e-9) + 2
    hi = np.array([min(MOST, math.ceil(min(m, float(MOST)))) for m in most], np.int64)  # |score| <= product of the lengths
    lo, width = -hi, -(-(2 * hi + 1) // BINS)
    above, wanted = np.zeros(n, np.int64), np.full(n, k, np.int64)
    up_to_bin = Window.partitionBy("query", "wanted").orderBy("bin")
    while (wanted > 0).any():
        counted = rows.mapInArrow(_count(shared, lo, hi, width, wanted), "query int, wanted long, bin int, n long")
        upto = counted.groupBy("query", "wanted", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(up_to_bin))
        kth = upto.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
        found = {r["query"]: r for r in kth.collect()}  # one row a query
        for q in np.flatnonzero(wanted > 0):
            if q not in found:  # fewer than k rows in all: every row is in the result
                wanted[q] = 0
                continue
            top = lo[q] + (BINS - found[q]["bin"]) * width[q] - 1
            lo[q], hi[q] = top - width[q] + 1, min(hi[q], top)
            above[q] += found[q]["upto"] - found[q]["n"]
            done = width[q] == 1 or above[q] + found[q]["n"] <= ENOUGH * k
            wanted[q], width[q] = 0 if done else k - above[q], -(-width[q] // BINS)
    return lo


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """The ``k`` best rows of ``vectors`` (vec_id, embedding) for each row that
    ``is_query`` holds for: query_id, rank (from 1), vec_id, score.

    The score is the inner product of the vectors' floor(scale * component);
    ties go to the smaller vec_id. Candidates are all rows with another vec_id
    and a vector of the same length; fewer than ``k`` are returned if there are
    fewer. Rows with a null vec_id, a null vector, or null or non-finite
    components take no part. A vec_id that is repeated among the queries asks
    once, with its least vector; among the candidates each row counts. Scores
    beyond 2**61 count as 2**61. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = freeze(usable(vectors.withColumn("_query", F.coalesce(is_query, F.lit(False)))).select("vec_id", "embedding", "_query"))
    longest = rows.agg(F.max(norm(scale))).first()[0] or 0.0
    candidates, out, any_added = rows.select("vec_id", "embedding"), Table(spark, RESULT), False
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for queries in in_blocks(rows.where("_query").select("vec_id", "embedding")):
        of = {d: (places, np.array([queries[p]["embedding"] for p in places], np.float64).reshape(len(places), d)) for d, places in by_length([q["embedding"] for q in queries]).items()}
        block = {"ids": np.array([q["vec_id"] for q in queries], np.int64), "vectors": of, "scale": scale}
        shared = spark.sparkContext.broadcast(block)
        least = _kth_scores(candidates, shared, block, longest, k)
        through = candidates.mapInArrow(_let_through(shared, least, k), "query_id long, vec_id long, score long")
        out.add(through.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        shared.unpersist()
        any_added = True
    return out.read(any_added)
