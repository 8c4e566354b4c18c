"""The prefix trie of conversations, by a splitter skeleton.

A turn becomes an element of 20 bytes (16 of a digest of role and text, 4 of the
text's length), a conversation the path of its elements. Sorted by (path,
conv_id), the members of a node stand together. The sorted order is cut into
shards at splitter paths, and a node whose members stand in two shards is a
prefix of a splitter. So the trie of the splitters' prefixes, the skeleton, is
broadcast; a task that walks over its sorted shard finishes every other node,
and leaves partial aggregates for skeleton nodes, which are combined by a
grouped reduction.

Splitters come from a bounded sample in hash order; equal paths are cut by
conv_id, so copies of one conversation fill as many shards as they need. The
skeleton's size has a fixed bound: at most ``MOST_SHARDS`` splitters of
``SPLIT_TURNS`` turns and ``SKELETON_NODES`` nodes; splitters beyond it are left
out, which makes a shard longer and changes no result. Conversations that share
more than ``SPLIT_TURNS`` turns are not cut apart beyond those.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger.llm.common import freeze

#: Bytes of an element, and those at its end that hold the text's length.
ELEMENT, LENGTH = 20, 4
MOST_SHARDS = 1024
#: Sampled conversations per shard.
SAMPLE = 8
SPLIT_TURNS = 256
SKELETON_NODES = 65_536
#: Children that wait in memory for their parent's least member.
WAITING = 50_000
#: Ids of conversations that end at a skeleton node, in one row.
CHUNK = 4096
OUT_ROWS = 8192
NODE, PARTIAL, ENDS = 0, 1, 2
#: Columns of what a shard gives. ``node`` is the number of a skeleton node or of
#: a node with many children; ``parent`` is the number of a node whose least
#: member the shard does not know.
FOUND = "kind int, node long, shard int, seq long, conv_id long, depth long, parent long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_TYPES = pa.schema(
    [("kind", pa.int32()), ("node", pa.int64()), ("shard", pa.int32()), *((n, pa.int64()) for n in ("seq", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends", pa.string())]
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) for each conv_id of ``conversations`` (conv_id, turn,
    role, text): its turns in order as elements in hex.

    Turns are ordered by number, null first, and equal numbers by the digest
    of role and text. A null role or text is an empty one. Rows without a
    conv_id are no conversation; other columns are ignored. A conversation is
    one row: its texts stay behind, 20 bytes a turn remain.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)
    element = F.concat(F.substring(digest, 1, 32), F.lower(F.lpad(F.hex(F.octet_length(text)), 2 * LENGTH, "0")))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), element.alias("element")).alias("t"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return ordered.select("conv_id", F.transform("ts", lambda t: t["element"]).alias("turns"))


def borrow_heads(found: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Conversations (conv_id, turns) that begin like the first of their family:
    conversation c takes the first h turns of conversation c - c % family (all
    if it has fewer, none if there is no such conversation), then its own turns
    after its first h; h = crc32(c in decimal) % heads."""
    found = freeze(found)
    first = found.select(F.col("conv_id").alias("_first"), F.slice("turns", 1, heads - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = found.withColumn("_first", F.col("conv_id") - F.col("conv_id") % family).withColumn("_h", h)
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.array().cast("array<string>"))
    rest = F.filter("turns", lambda _, k: k >= F.col("_h"))
    return own.join(first, "_first", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _separators(sample: list[tuple[bytes, int]], every: int) -> tuple[list[tuple[bytes, int]], dict[tuple[int, bytes], int], list[tuple[int, int, int]]]:
    """(separators, skeleton, nodes) from a sorted sample of (path, conv_id).

    A separator is the shortest prefix of a sampled path that comes after the
    sampled path before it, or (path, conv_id) between equal paths. The skeleton
    maps (parent's number, element) to a number; nodes[number] is (parent,
    depth, bytes of the last text). Number 0 is the root.
    """
    separators: list[tuple[bytes, int]] = []
    skeleton: dict[tuple[int, bytes], int] = {}
    nodes = [(-1, 0, 0)]
    for at in range(every, len(sample), every):
        (before, _), (path, conv_id) = sample[at - 1], sample[at]
        if before == path:
            if len(path) >= SPLIT_TURNS * ELEMENT:
                continue  # cut in the sample: the whole path is not known here
            separator = (path, conv_id)
        else:
            separator = (path[: _common(before, path) * ELEMENT + ELEMENT], -(2**63))
        if separators and separator <= separators[-1] or len(nodes) + len(separator[0]) // ELEMENT > SKELETON_NODES:
            continue
        separators.append(separator)
        node = 0
        for depth, element in enumerate(_elements(separator[0]), 1):
            if (node, element) not in skeleton:
                skeleton[node, element] = len(nodes)
                nodes.append((node, depth, int.from_bytes(element[-LENGTH:], "big")))
            node = skeleton[node, element]
    return separators, skeleton, nodes


def _elements(path: bytes) -> Iterator[bytes]:
    return (path[k : k + ELEMENT] for k in range(0, len(path), ELEMENT))


def _common(a: bytes, b: bytes) -> int:
    """Number of leading elements that two paths share."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // ELEMENT
    at = 0
    while a[at : at + ELEMENT] == b[at : at + ELEMENT]:
        at += ELEMENT
    return at // ELEMENT


def _to_shards(separators: list[tuple[bytes, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, ids = batch.column("path"), batch.column("conv_id")
            shard = [bisect_right(separators, key) for key in zip(paths.to_pylist(), ids.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), paths, ids], ["shard", "path", "conv_id"])

    return run


class _Open:
    """A node on the path of the conversation at hand."""

    __slots__ = ("number", "least", "members", "children", "leaves", "saved", "ends", "chunk", "waiting")

    def __init__(self, number: int):
        self.number = number  # -1: neither in the skeleton nor with many children
        self.least, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.chunk, self.waiting = None, [], []


class _Shard:
    """A walk over the sorted conversations of one shard."""

    def __init__(self, shard: int, skeleton: dict[tuple[int, bytes], int], out: list[tuple]):
        self.shard, self.skeleton, self.out = shard, skeleton, out
        self.path, self.open, self.many, self.seq = b"", [_Open(0)], 0, 0

    def add(self, path: bytes, conv_id: int) -> None:
        self.close(_common(self.path, path))
        for element in _elements(path[(len(self.open) - 1) * ELEMENT :]):
            parent = self.open[-1].number
            self.open.append(_Open(self.skeleton.get((parent, element), -1) if self._in_skeleton(parent) else -1))
        self.path = path
        top = self.open[-1]
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        top.members += 1
        if self._in_skeleton(top.number):
            top.chunk.append(str(conv_id))
            if len(top.chunk) == CHUNK:
                self._end_chunk(top)
        elif top.ends is None:
            top.ends = hashlib.sha256(str(conv_id).encode())
        else:
            top.ends.update(f",{conv_id}".encode())

    def close(self, depth: int) -> None:
        """Finish the nodes below ``depth``; -1: the root as well."""
        while len(self.open) - 1 > depth:
            node, at = self.open.pop(), len(self.open)
            parent = self.open[-1] if self.open else None
            if parent:
                parent.members += node.members
                if node.least is not None:
                    parent.least = node.least if parent.least is None else min(parent.least, node.least)
            if self._in_skeleton(node.number):
                if node.chunk:
                    self._end_chunk(node)
                self.out.append((PARTIAL, node.number, self.shard, 0, node.least, at, None, None, node.members, node.children, node.leaves, node.saved, None))
                continue
            node.leaves = node.leaves or 1
            node.saved += (node.members - 1) * int.from_bytes(self.path[at * ELEMENT - LENGTH : at * ELEMENT], "big")
            self.out += [(*row[:7], node.least, *row[8:]) for row in node.waiting]
            parent.children += 1
            parent.leaves += node.leaves
            parent.saved += node.saved
            own = None if node.number < 0 else node.number
            row = (NODE, own, self.shard, 0, node.least, at, None if parent.number < 0 else parent.number, None, node.members, node.children, node.leaves, node.saved, (node.ends or hashlib.sha256()).hexdigest())
            if parent.number >= 0:
                self.out.append(row)
                continue
            parent.waiting.append(row)
            if len(parent.waiting) > WAITING:
                self.many += 1
                parent.number = (self.shard + 1 << 40) + self.many
                self.out += [(*row[:6], parent.number, *row[7:]) for row in parent.waiting]
                parent.waiting = []

    def _in_skeleton(self, number: int) -> bool:
        return 0 <= number < SKELETON_NODES

    def _end_chunk(self, node: _Open) -> None:
        self.seq += 1
        self.out.append((ENDS, node.number, self.shard, self.seq, *[None] * 8, ",".join(node.chunk)))
        node.chunk = []


def _walk(skeleton: dict[tuple[int, bytes], int]):
    """Over batches of (shard, path, conv_id), sorted by all three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        walk = None
        for batch in batches:
            for shard, path, conv_id in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id")), strict=True):
                if walk is None or walk.shard != shard:
                    if walk is not None:
                        walk.close(-1)
                    walk = _Shard(shard, skeleton, out)
                walk.add(path, conv_id)
                if len(out) >= OUT_ROWS:
                    yield _batch(out)
                    out.clear()
        if walk is not None:
            walk.close(-1)
        for at in range(0, len(out), OUT_ROWS):
            yield _batch(out[at : at + OUT_ROWS])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TYPES, strict=True)], schema=_TYPES)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's comma-joined ids, from rows sorted by node and place."""
    node, ends = None, None
    done: list[tuple[int, str]] = []
    for batch in batches:
        for n, chunk in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if n != node:
                if ends is not None:
                    done.append((node, ends.hexdigest()))
                node, ends = n, hashlib.sha256(chunk.encode())
            else:
                ends.update(b"," + chunk.encode())
    if ends is not None:
        done.append((node, ends.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])


def _skeleton_rows(nodes: list[tuple[int, int, int]], partial: dict[int, tuple]) -> list[tuple]:
    """Rows of the skeleton's nodes from their summed partial aggregates (least,
    members, and children, leaves, saved below them outside the skeleton)."""
    totals = [list(partial[k]) for k in range(len(nodes))]
    for k in range(len(nodes) - 1, -1, -1):  # a parent's number is less than its children's
        least, members, children, leaves, saved = totals[k]
        totals[k][3] = leaves = leaves if children else 1
        totals[k][4] = saved = saved + (members - 1) * nodes[k][2]
        if k:
            above = totals[nodes[k][0]]
            above[2] += 1
            above[3] += leaves
            above[4] += saved
    return [(k, t[0], depth, totals[parent][0] if k else None, *t[1:]) for k, ((parent, depth, _), t) in enumerate(zip(nodes, totals, strict=True))]


def trie(found: DataFrame) -> DataFrame:
    """One row per node of the trie of ``found`` (conv_id, turns): conv_id (the
    smallest member), depth, parent_conv_id (the parent's, null for the root),
    n_convs (members), n_children, n_leaves (childless nodes of its subtree,
    itself included), saved_tokens (summed over the subtree: bytes of the node's
    last text for each member but one) and ends_sha256 (of the ids of members
    that end there, ascending, comma-joined).

    A conversation without turns is a member of the root alone. Rows that repeat
    a conv_id count as members of their own. No conversations: no nodes.
    """
    spark = found.sparkSession
    paths = freeze(found.select(F.unhex(F.array_join("turns", "")).alias("path"), "conv_id"))
    shards = max(1, min(MOST_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sampled = paths.orderBy(F.xxhash64("conv_id"), "path").limit(SAMPLE * shards).select(F.substring("path", 1, SPLIT_TURNS * ELEMENT).alias("path"), "conv_id")
    sample = sorted((bytes(r["path"]), r["conv_id"]) for r in sampled.collect())
    separators, skeleton, nodes = _separators(sample, max(1, -(-len(sample) // shards)))
    dealt = paths.mapInArrow(_to_shards(separators), "shard int, path binary, conv_id long").repartitionById(len(separators) + 1, F.col("shard"))
    walked = freeze(dealt.sortWithinPartitions("shard", "path", "conv_id").mapInArrow(_walk(skeleton), FOUND))

    parts = walked.where(F.col("kind") == PARTIAL).groupBy("node").agg(F.min("conv_id"), *(F.sum(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))).collect()
    if not parts:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    rows = _skeleton_rows(nodes, {r[0]: tuple(r)[1:] for r in parts})
    shape = "node long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    frame = freeze(spark.createDataFrame(rows, shape).coalesce(1))
    chunks = walked.where(F.col("kind") == ENDS).select("node", "shard", "seq", "ends")
    ends = chunks.repartition("node").sortWithinPartitions("node", "shard", "seq").mapInArrow(_hash_ends, "node long, ends_sha256 string")
    top = frame.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))

    below = walked.where(F.col("kind") == NODE).withColumnRenamed("ends", "ends_sha256")
    known = F.broadcast(frame.select(F.col("node").alias("parent"), F.col("conv_id").alias("_known")))  # SKELETON_NODES rows at most
    below = below.join(known, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_known"))
    many = walked.where((F.col("kind") == NODE) & F.col("node").isNotNull()).select(F.col("node").alias("parent"), F.col("conv_id").alias("_many"))
    if not many.isEmpty():
        below = below.join(many, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_many"))
    return below.select(COLUMNS).unionByName(top.select(COLUMNS))
