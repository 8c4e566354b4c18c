"""Connected components of a link table, by repeated contraction in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger.llm.common import freeze


def connected_components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in ``links`` (src, dst); ids are linked iff
    their labels agree. A label is some id of the component, not the least.

    Each round every id moves to the first of itself and its neighbours, by id
    in odd rounds (stars collapse at once) and by a hash of id and round in
    even ones (long chains shrink by a constant share), and links between what
    remains are carried on. Both sides of every join are tables, so the planner
    may split a hub's rows; the minimum per id is pre-aggregated in each task.
    Nulls link nothing. An empty table gives an empty result.
    """
    pairs = freeze(links.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    moves: list[DataFrame] = []
    while not pairs.isEmpty():
        turn = len(moves)
        first = F.col("dst") if turn % 2 == 0 else F.xxhash64(F.col("dst"), F.lit(turn))
        both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        own = F.col("src") if turn % 2 == 0 else F.xxhash64(F.col("src"), F.lit(turn))
        move = freeze(
            both.groupBy("src")
            .agg(F.min(F.struct(first.alias("h"), F.col("dst").alias("to"))).alias("m"))
            .select(F.col("src").alias("at"), F.least(F.struct(own.alias("h"), F.col("src").alias("to")), F.col("m"))["to"].alias("to"))
        )
        moves.append(move)
        moved = pairs.join(move.select(F.col("at").alias("src"), F.col("to").alias("a")), "src").join(move.select(F.col("at").alias("dst"), F.col("to").alias("b")), "dst")
        pairs = freeze(moved.where("a <> b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct())
    if not moves:
        return pairs.select(F.col("src").alias("id"), F.col("dst").alias("label"))
    labels = moves[0].select(F.col("at").alias("id"), F.col("to").alias("label"))
    for move in moves[1:]:
        step = move.select(F.col("at").alias("label"), "to")
        labels = labels.join(step, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return freeze(labels)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links (a[i], b[i]): the least node of each node's
    component. Used inside a task to turn many links into one per node."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all() and (root[a] == root[b]).all():
            break
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    while (root[root] != root).any():
        root = root[root]
    return root
