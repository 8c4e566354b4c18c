"""Sharding by a k-d tree, in DataFrame functions only.

Documents are points in four metadata dimensions: source, language, size and
id. A node that must give k shards is split along its widest dimension where
the bytes on one side reach the share of floor(k / 2) shards, until each leaf
is one shard of the target bytes. All nodes of a level are split together. A
weighted median is found in a few passes of histograms that tasks
pre-aggregate; only bucket sums of a bounded number come to the driver, and the
tree itself has one cut per shard.

Documents of equal text share the place of the one with the least doc_id, and
so a shard. Groups that are a larger part of a shard (there is a bounded number
of them) are weights at one point, which a cut could not halve: they are given
to the emptiest shards first, largest first, and the tree then fills what room each
shard has left. Only a group larger than a whole shard is dealt out, by its
documents' own places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesledger.llm.common import freeze, order_bucket, rank_within

DIMENSIONS = ["x_source", "x_lang", "x_size", "x_id"]
#: Part of a shard's bytes beyond which a group of equal texts is placed first.
LARGE = 0.02
#: How near a cut's bytes come to the wanted ones, as part of the node's.
TOLERANCE = 0.0005
BUCKETS = 512
MAX_PASSES = 8


@dataclass
class Node:
    shards: range
    dimension: str = ""
    cut: float = 0.0
    below: Node | None = None
    above: Node | None = None

    def place(self) -> Column:
        """The shard of a row, as an expression of its dimensions."""
        if self.below is None or self.above is None:
            return F.lit(self.shards.start)
        return F.when(F.col(self.dimension) < self.cut, self.below.place()).otherwise(self.above.place())


def _leaves(node: Node) -> list[Node]:
    return [node] if node.below is None or node.above is None else _leaves(node.below) + _leaves(node.above)


def _histogram(points: DataFrame, root: Node, spans: dict[int, dict[str, tuple[float, float]]]) -> dict[tuple[int, str], dict[int, int]]:
    """Bytes by bucket for the given span of each (node, dimension); nodes go
    by their first shard. At most nodes * dimensions * BUCKETS rows come back."""
    entries = F.array(
        *(
            F.when(
                (F.col("node") == node) & (F.col(d) >= lo) & (F.col(d) < hi),
                F.struct(F.lit(d).alias("d"), F.least(F.floor((F.col(d) - lo) / (hi - lo) * BUCKETS), F.lit(BUCKETS - 1)).cast("int").alias("b")),
            )
            for node, by in spans.items()
            for d, (lo, hi) in by.items()
        )
    )
    placed = points.withColumn("node", root.place()).select("node", "size", F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("e"))
    found: dict[tuple[int, str], dict[int, int]] = {}
    for r in placed.groupBy("node", "e").agg(F.sum("size").alias("n")).collect():
        found.setdefault((r["node"], r["e"]["d"]), {})[r["e"]["b"]] = int(r["n"])
    return found


def build_tree(points: DataFrame, room: list[float]) -> Node:
    """The k-d tree over ``points`` (size and DIMENSIONS, each in [0, 1)); a shard
    is given bytes in proportion to its ``room``."""
    root = Node(range(len(room)))
    whole: dict[str, int] = {}
    while open_ := {n.shards.start: n for n in _leaves(root) if len(n.shards) > 1}:
        first = _histogram(points, root, {k: dict.fromkeys(DIMENSIONS, (0.0, 1.0)) for k in open_})
        spans: dict[int, dict[str, tuple[float, float]]] = {}
        wanted: dict[int, float] = {}
        allowed: dict[int, float] = {}
        hist = {}
        for k, node in open_.items():
            extent = {d: max(h) - min(h) + 1 if (h := first.get((k, d))) else 0 for d in DIMENSIONS}
            whole = whole or dict(extent)
            node.dimension = max(DIMENSIONS, key=lambda d, e=extent: e[d] / max(1, whole[d]))
            total = sum(first.get((k, node.dimension), {}).values())
            middle = node.shards.start + len(node.shards) // 2
            own, lower = sum(room[node.shards.start : node.shards.stop]), sum(room[node.shards.start : middle])
            wanted[k], allowed[k] = total * (lower / own if own else 0.5), total * TOLERANCE
            spans[k] = {node.dimension: (0.0, 1.0)}
            hist[k] = first.get((k, node.dimension), {})
        for _ in range(MAX_PASSES):
            for k in list(hist):
                node, ((lo, hi),) = open_[k], spans[k].values()
                width, below = (hi - lo) / BUCKETS, 0
                node.cut = hi
                del spans[k]
                for b in sorted(hist[k]):
                    if below + hist[k][b] > wanted[k]:
                        node.cut = lo + b * width
                        if wanted[k] - below > allowed[k] and below + hist[k][b] - wanted[k] > allowed[k] and node.cut + width > node.cut + width / BUCKETS > node.cut:
                            spans[k] = {node.dimension: (node.cut, node.cut + width)}
                            wanted[k] -= below
                        elif below + hist[k][b] - wanted[k] < wanted[k] - below:
                            node.cut += width
                        break
                    below += hist[k][b]
            if not spans:
                break
            hist = {k: h for (k, _), h in _histogram(points, root, spans).items()}
            hist |= {k: {} for k in spans if k not in hist}
        for node in open_.values():
            middle = node.shards.start + len(node.shards) // 2
            node.below, node.above = Node(range(node.shards.start, middle)), Node(range(middle, node.shards.stop))
    return root


def _unit(h: Column, bits: int) -> Column:
    """The top ``bits`` of a 64-bit hash as a fraction."""
    return F.shiftrightunsigned(h, 64 - bits).cast("double") / float(1 << bits)


def _place_large(groups: list, shards: int, target: float) -> tuple[list[int], list[float]]:
    """(shard of each group, room left in each shard): the largest first, each
    into the emptiest shard."""
    held, at = [0] * shards, [0] * len(groups)
    for k in sorted(range(len(groups)), key=lambda k: (-groups[k]["bytes"], groups[k]["text_hash"], groups[k]["text_crc32"])):
        at[k] = min(range(shards), key=lambda s: (held[s], s))
        held[at[k]] += groups[k]["bytes"]
    return at, [max(0.0, target - h) for h in held]


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source, lang): doc_id, size
    (UTF-8 bytes and 1), text_crc32, law, shard, slot (gapless from 0 in its
    shard, in order of a hash of doc_id), grown_shard (null).

    The law is ``bytes``: sizes of shards come near to equal, as far as single
    documents allow. A null text counts as an empty one; nulls in the metadata
    are values of their own; rows that repeat a doc_id are placed each. Without
    source or lang that dimension is constant; other columns are ignored. An
    empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    meta = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *meta, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    narrow = freeze(rows)
    total, least, most = narrow.agg(F.sum("size"), F.min("doc_id"), F.max("doc_id")).first()
    group = ["text_hash", "text_crc32", "size"]
    place = F.struct("doc_id", "source", "lang")
    target = (total or 0) / shards
    equal = narrow.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).withColumn("bytes", F.col("n") * F.col("size"))
    together = freeze(equal.where((F.col("n") > 1) & (F.col("bytes") <= target)))
    large = together.where(F.col("bytes") > LARGE * target).select(*group, "bytes").collect()  # 1 / LARGE for each shard at most
    at, room = _place_large(large, shards, target)
    given = [F.struct(*(F.lit(g[c]).cast("long").alias(c) for c in group), F.lit(k).alias("given")) for g, k in zip(large, at, strict=True)]
    placed = together.limit(0).select(*group, F.lit(0).alias("given")) if not given else narrow.sparkSession.range(1).select(F.inline(F.array(*given)))
    together = together.join(F.broadcast(placed), group, "left").select(*group, "first", "given")
    joined = narrow.join(together, group, "left").withColumn("at", F.coalesce("first", place))
    own = F.xxhash64("doc_id")
    tie = _unit(F.xxhash64(F.when(F.col("first").isNull(), own).otherwise(F.col("text_hash")), F.lit(1)), 53)
    grid = lambda x: (F.floor(x * (1 << 20)) + tie) / float(1 << 20)
    spread = max(1, (most or 0) - (least or 0) + 1)
    points = freeze(
        joined.select(
            "doc_id", "size", "text_crc32", "given", own.alias("own"),
            grid(_unit(F.xxhash64("at.source"), 20)).alias("x_source"),
            grid(_unit(F.xxhash64("at.lang"), 20)).alias("x_lang"),
            grid(F.log2(F.col("size").cast("double")) / 64).alias("x_size"),
            grid(F.coalesce((F.col("at.doc_id") - F.lit(least or 0)).cast("double") / spread, F.lit(0.0))).alias("x_id"),
        )
    )
    tree = build_tree(points.where("given is null"), room)
    dealt = points.select("doc_id", "size", "text_crc32", F.coalesce("given", tree.place()).alias("shard"), "own", order_bucket(F.col("own")).alias("bucket"))
    ranked = rank_within(dealt, ["shard"], ["own", "doc_id", "text_crc32"], "bucket", "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
