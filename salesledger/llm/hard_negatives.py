"""Hard negatives for anchors, by bounds along a spanning tree of the anchors.

A block of anchors is broadcast with a minimum spanning tree over them. If x
scores s with an anchor, its score with a neighbour in the tree differs from s
by at most the edge's length times the length of x. So a task scores its rows
against the root of the tree, carries each row's bounds from parent to child, and
scores a row against a child only where the bounds overlap a window in which
the child still looks for rows. Scored rows bring exact bounds to the child's own
children.

The first pass finds each anchor's positives: the tree spans the anchors of one
label, rows are those of that label, the window is all scores from the k-th best
so far. The second pass finds negatives, for which every positive has a
window of scores; its lower end rises to the k-th best so far in the window. Both
begin with what the block's anchors are to each other. A task sends its k best for
each anchor, or anchor and positive; these are ranked over all tasks.

Blocks have a bounded size, so the broadcast does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesledger.llm.common import freeze
from salesledger.llm.integer_vectors import EXACT, MOST, Table, best, by_length, floors, in_blocks, pieces, scores, usable

#: Rows that a task holds against the tree at once.
ROWS = 4096
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def spanning_tree(points: np.ndarray) -> list[tuple[int, int, float]]:
    """(node, parent, distance) of a minimum spanning tree, each parent before
    its children and a node's branch whole before the next; the root's parent is -1."""
    n = len(points)
    near, by = np.full(n, np.inf), np.full(n, -1)
    left = np.ones(n, bool)
    children: list[list[int]] = [[] for _ in range(n)]
    length = np.zeros(n)
    node = 0
    for _ in range(n):
        left[node] = False
        length[node] = 0.0 if by[node] < 0 else near[node]
        if by[node] >= 0:
            children[by[node]].append(node)
        away = np.sqrt(((points - points[node]) ** 2).sum(axis=1))
        closer = left & (away < near)
        near[closer], by[closer] = away[closer], node
        if left.any():
            node = int(np.where(left, near, np.inf).argmin()) if np.isfinite(near[left]).any() else int(np.flatnonzero(left)[0])
    order, stack = [], [0] if n else []
    while stack:
        node = stack.pop()
        order.append((node, int(by[node]), float(length[node])))
        stack += children[node]
    return order


def _tree(places: np.ndarray, vectors: np.ndarray, scale: int) -> dict:
    """What a task needs of anchors of one length. ``exact``: their scores are sums
    that a double holds, so bounds can be trusted."""
    points = floors(vectors, scale)
    exact = bool((np.abs(points) < 2.0**31).all())
    return {"places": places, "vectors": vectors, "points": points, "exact": exact, "steps": spanning_tree(points) if exact else []}


class _Best:
    """The k best rows so far of each slot, and the least score that can still
    enter; a slot is an anchor, or an anchor and one of its windows."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, slot: int, ids: np.ndarray, score: np.ndarray) -> None:
        if slot in self.rows:
            ids, score = np.concatenate([self.rows[slot][0], ids]), np.concatenate([self.rows[slot][1], score])
        top = best(np.zeros(len(ids), np.int8), ids, score, self.k)
        self.rows[slot] = ids[top], score[top]
        if len(top) == self.k:
            self.least[slot] = max(self.least[slot], score[top[-1]])

    def batch(self, names: list[str]) -> pa.RecordBatch:
        slots = np.concatenate([np.full(len(ids), s, np.int32) for s, (ids, _) in self.rows.items()] or [np.zeros(0, np.int32)])
        ids = np.concatenate([ids for ids, _ in self.rows.values()] or [np.zeros(0, np.int64)])
        score = np.concatenate([score for _, score in self.rows.values()] or [np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(ids), pa.array(score)], names)


def scan(tree: dict, scale: int, matrix: np.ndarray, offer, windows) -> int:
    """Score rows of ``matrix`` against the anchors of ``tree`` where their
    bounds overlap a window; the number of scores.

    windows(anchor) gives pairs (low, high) of the scores looked for, and
    offer(anchor, rows, scores) takes what was scored."""
    x = floors(matrix, scale)
    rows_exact = (np.abs(x).max(axis=1, initial=0.0) * np.abs(tree["points"]).max(initial=0.0) * max(1, x.shape[1]) < EXACT) & tree["exact"]
    odd = np.flatnonzero(~rows_exact)
    scored = len(odd) * len(tree["places"])
    if len(odd):  # too large for bounds in doubles: every score is computed
        for at, column in zip(tree["places"], scores(matrix[odd], tree["vectors"], scale).T, strict=True):
            offer(int(at), odd, column)
    even = np.flatnonzero(rows_exact)
    if not len(even):
        return scored
    x = x[even]
    length = np.sqrt((x**2).sum(axis=1))
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    pending = np.bincount(np.array([p for _, p, _ in tree["steps"] if p >= 0], np.int64), minlength=len(tree["places"]))
    for node, parent, distance in tree["steps"]:
        anchor = int(tree["places"][node])
        if parent < 0:
            low = high = (x @ tree["points"][node]).astype(np.float64)
            hit = np.arange(len(x))
        else:
            slack = distance * length * (1 + 1e-9) + 1.0
            low, high = bounds[parent][0] - slack, bounds[parent][1] + slack
            over = np.zeros(len(x), bool)
            for least, most in windows(anchor):
                over |= (high >= least) & (low <= most)
            hit = np.flatnonzero(over)
            pending[parent] -= 1
            if not pending[parent]:
                del bounds[parent]
        if len(hit):
            exact = x[hit] @ tree["points"][node] if parent >= 0 else low
            offer(anchor, even[hit], exact.astype(np.int64))
            if parent >= 0:
                low[hit] = high[hit] = exact
            scored += len(hit)
        if pending[node]:
            bounds[node] = low, high
    return scored


def _positives(shared, least: np.ndarray, k: int):
    """(slot, id, score): a task's k best rows of each anchor's own label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        found = _Best(k, least)
        for batch in batches:
            for dim, some, matrix in pieces(batch, ROWS):
                ids, labels = some.column("vec_id").to_numpy(), some.column("label").to_numpy()
                for (of_dim, label), tree in block["by_label"].items():
                    mine = np.flatnonzero(labels == label) if of_dim == dim else []
                    if len(mine):
                        scan(tree, block["scale"], matrix[mine], _offer_positives(block, found, ids[mine]), lambda a: [(found.least[a], np.inf)])
        yield found.batch(["slot", "id", "score"])

    return run


def _offer_positives(block: dict, found: _Best, ids: np.ndarray):
    def offer(anchor: int, rows: np.ndarray, score: np.ndarray) -> None:
        good = (score >= found.least[anchor]) & (ids[rows] != block["ids"][anchor])
        if good.any():
            found.add(anchor, ids[rows[good]], score[good])

    return offer


def _negatives(shared, windows: dict, least: np.ndarray, k: int):
    """(slot, id, score): a task's k best rows of other labels in each window.
    windows: anchor -> (slot, low, high) of its positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        found = _Best(k, least)

        def looked_for(anchor: int):
            return [(max(low, found.least[slot]), high) for slot, low, high in windows.get(anchor, ())]

        for batch in batches:
            for dim, some, matrix in pieces(batch, ROWS):
                if dim in block["by_dim"]:
                    ids, labels = some.column("vec_id").to_numpy(), some.column("label").to_numpy()
                    scan(block["by_dim"][dim], block["scale"], matrix, _offer_negatives(block, found, windows, ids, labels), looked_for)
        yield found.batch(["slot", "id", "score"])

    return run


def _offer_negatives(block: dict, found: _Best, windows: dict, ids: np.ndarray, labels: np.ndarray):
    def offer(anchor: int, rows: np.ndarray, score: np.ndarray) -> None:
        other = labels[rows] != block["labels"][anchor]
        for slot, low, high in windows.get(anchor, ()):
            good = other & (score >= max(low, found.least[slot])) & (score <= high)
            if good.any():
                found.add(slot, ids[rows[good]], score[good])

    return offer


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each slot over all tasks, with their rank."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """For each anchor and each of its positives, the best rows of other labels
    whose score lies between ``low`` and ``high`` percent of the positive's:
    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label (a whole number). A row's score is
    the inner product of its floor(scale * component) with the anchor's; higher
    scores come first, ties by the smaller vec_id. An anchor's positives are the
    first ``positives`` rows of its label with another vec_id, its negatives the
    first ``negatives`` in the window; all, if there are fewer. A negative
    positive score leaves no window. Rows with a null vec_id, label or vector, or
    null or non-finite components take no part; vectors of different lengths are
    never compared. A vec_id that is repeated among the anchors asks once, with its
    least (vector, label); as a positive or negative each row counts. Scores
    beyond 2**61 count as 2**61. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = usable(vectors.withColumn("_anchor", F.coalesce(is_anchor, F.lit(False)))).where("label is not null")
    rows = freeze(kept.select("vec_id", "embedding", F.col("label").cast("long").alias("label"), "_anchor"))
    candidates, out, any_added = rows.drop("_anchor"), Table(spark, RESULT), False
    for anchors in in_blocks(rows.where("_anchor").select("vec_id", "embedding", "label")):
        block = _block(anchors, scale)
        n = len(anchors)
        shared = spark.sparkContext.broadcast(block)
        first = _Best(positives, np.full(n, -MOST - 1, np.int64))
        for (_, _), tree in block["by_label"].items():  # the block's anchors are rows, too
            for at, column in zip(tree["places"], scores(tree["vectors"], tree["vectors"], scale).T, strict=True):
                _offer_positives(block, first, block["ids"][tree["places"]])(int(at), np.arange(len(column)), column)
        found = candidates.mapInArrow(_positives(shared, first.least, positives), "slot int, id long, score long")
        pairs = sorted((r["slot"], r["rank"], r["id"], r["score"]) for r in _first(found, positives).collect())  # ``positives`` rows an anchor

        windows: dict[int, list[tuple[int, int, int]]] = {}
        for slot, (anchor, _, _, score) in enumerate(pairs):
            if score >= 0:
                windows.setdefault(anchor, []).append((slot, -(-low * score // 100), high * score // 100))
        inside = _Best(negatives, np.full(len(pairs), -MOST - 1, np.int64))
        for tree in block["by_dim"].values():
            offer = _offer_negatives(block, inside, windows, block["ids"][tree["places"]], block["labels"][tree["places"]])
            for at, column in zip(tree["places"], scores(tree["vectors"], tree["vectors"], scale).T, strict=True):
                offer(int(at), np.arange(len(column)), column)
        if windows:
            mined = _first(candidates.mapInArrow(_negatives(shared, windows, inside.least, negatives), "slot int, id long, score long"), negatives)
            table = [(slot, int(block["ids"][a]), p, s) for slot, (a, _, p, s) in enumerate(pairs)]
            named = spark.createDataFrame(table, "slot int, anchor_id long, positive_id long, positive_score long")
            result = mined.join(F.broadcast(named), "slot")  # BLOCK * positives rows at most
            out.add(result.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
            any_added = True
        shared.unpersist()
    return out.read(any_added)


def _block(anchors: list, scale: int) -> dict:
    """Anchors and their trees, of plain values and arrays."""
    labels = np.array([a["label"] for a in anchors], np.int64)
    block = {"ids": np.array([a["vec_id"] for a in anchors], np.int64), "labels": labels, "scale": scale, "by_dim": {}, "by_label": {}}
    for dim, places in by_length([a["embedding"] for a in anchors]).items():
        vectors = np.array([anchors[p]["embedding"] for p in places], np.float64).reshape(len(places), dim)
        block["by_dim"][dim] = _tree(places, vectors, scale)
        for label in np.unique(labels[places]):
            own = labels[places] == label
            block["by_label"][dim, int(label)] = _tree(places[own], vectors[own], scale)
    return block
