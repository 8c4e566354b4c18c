"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 3 bits meet in a third one that lies within half that
distance of each. Every fingerprint therefore names the variants of itself
that differ in up to 2 bits, fingerprints are shuffled on variants, and those
that name the same variant are verified and linked.

Distances between fingerprints of equal parity are even, so a meeting point of
odd parity always exists: fingerprints of even parity name their 64 variants
at one bit, those of odd parity themselves and their 2016 variants at two bits.
Only the leading bits of a variant travel: a fingerprint is sent once to each
of the few dozen prefixes that its variants have, and the receiving task
writes out the rest of the variant. The shuffle then has tens of rows a
fingerprint instead of a thousand.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesledger.llm.common import freeze, small_batches
from salesledger.llm.components import connected_components, local_roots

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Shingles whose bits are counted at once, and variants sorted at once.
COUNT_CHUNK = 1 << 16
SORT_CHUNK = 4_000_000


def fingerprint(raw: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint of a UTF-8 text: ASCII lower case, words, shingles
    with repeats (fewer words: one shingle of all), XXH64; a bit is set if it
    is set in over half the hashes. No words, or null: 0."""
    found = (raw or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not found:
        return 0
    k = min(shingle_words, len(found))
    shingles = map(b" ".join, zip(*(found[i:] for i in range(k)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(found) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNT_CHUNK):
        bits = np.unpackbits(hashes[at : at + COUNT_CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, rid) for every row of ``docs`` (doc_id, text); rid: a hash of
    the text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, shingle_words) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64)), batch.column("rid")], ["doc_id", "fp", "rid"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("rid")).mapInArrow(run, "doc_id long, fp long, rid long")


def _prefix_masks(bits: int, most: int) -> list[tuple[int, int]]:
    """(mask, flips) of up to ``most`` flips among the top ``bits`` bits."""
    tops = [1 << (63 - i) for i in range(bits)]
    masks = [(sum(c), n) for n in range(most + 1) for c in combinations(tops, n)]
    return [(m - (1 << 64) if m >= 1 << 63 else m, n) for m, n in masks]


def _mask_array(bits: int, most: int):
    return F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("flips")) for m, n in _prefix_masks(bits, most)))


def _named(fp: np.ndarray, prefix: np.ndarray, flips: np.ndarray, low_bits: int, turn: int, turns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variants that the rows name, the row of each, and whether it is the
    row's own fingerprint; of ``turns`` equal shares of all variants, one."""
    low = np.uint64(low_bits)
    base = (prefix.astype(np.uint64) << low) | (fp & ((np.uint64(1) << low) - np.uint64(1)))
    one = np.uint64(1) << np.arange(low_bits, dtype=np.uint64)
    i, j = np.triu_indices(low_bits, 1)
    two = one[i] | one[j]
    none = np.zeros(1, np.uint64)
    odd = np.bitwise_count(fp) % 2 == 1
    named, owner, center = [], [], []
    for rows, masks, is_center in (
        (np.flatnonzero(~odd & (flips == 1)), none, False),
        (np.flatnonzero(~odd & (flips == 0)), one, False),
        (np.flatnonzero(odd & (flips == 0)), none, True),
        (np.flatnonzero(odd & (flips == 0)), two, False),
        (np.flatnonzero(odd & (flips == 1)), one, False),
        (np.flatnonzero(odd & (flips == 2)), none, False),
    ):
        step = max(1, SORT_CHUNK // len(masks))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            names, owners = (base[some][:, None] ^ masks).ravel(), np.repeat(some, len(masks))
            if turns > 1:
                mine = (names * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(turns) == turn
                names, owners = names[mine], owners[mine]
            named.append(names)
            owner.append(owners)
            center.append(np.full(len(names), is_center))
    return np.concatenate(named), np.concatenate(owner), np.concatenate(center)


def _meetings(fp: np.ndarray, prefix: np.ndarray, flips: np.ndarray, low_bits: int, turn: int = 0, turns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Links (as row numbers) between rows that name the same variant."""
    odd = np.bitwise_count(fp) % 2 == 1
    named, owner, center = _named(fp, prefix, flips, low_bits, turn, turns)
    order = np.argsort(named)
    same = named[order][1:] == named[order][:-1]
    met = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    if not len(met):
        return met, met
    # the variant's owner, else one of even parity, is within 3 bits of all others; two odd ones alone may be 4 apart
    rank = np.where(center[met], 0, np.where(odd[owner[met]], 2, 1))
    met = met[np.lexsort((owner[met], rank, named[met]))]
    rank = np.where(center[met], 0, np.where(odd[owner[met]], 2, 1))
    found = named[met]
    starts = np.concatenate([[True], found[1:] != found[:-1]])
    head = np.flatnonzero(starts)[np.cumsum(starts) - 1]
    keep = (rank[head] < 2) & ~starts
    a, b = owner[met][head[keep]], owner[met][keep]
    near = np.bitwise_count(fp[a] ^ fp[b]) <= MAX_BITS
    return a[near], b[near]


def _cost(flips: np.ndarray, low_bits: int) -> np.ndarray:
    """About how many variants a row names."""
    return np.where(flips == 0, low_bits * low_bits // 4 + 1, low_bits // 2 + 1)


def _linked(low_bits: int):
    def forest(fp: np.ndarray, prefix: np.ndarray, flips: np.ndarray) -> Iterator[pa.RecordBatch]:
        own, at = np.unique(fp, return_inverse=True)
        turns = 1 + int(_cost(flips, low_bits).sum()) // (2 * SORT_CHUNK)  # over 1 where one prefix is very frequent
        found = [_meetings(fp, prefix, flips, low_bits, turn, turns) for turn in range(turns)]
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        root = local_roots(len(own), at[a], at[b])
        moved = np.flatnonzero(root != np.arange(len(own)))
        yield pa.RecordBatch.from_arrays([pa.array(own[moved].view(np.int64)), pa.array(own[root[moved]].view(np.int64))], ["src", "dst"])

    def pieces(prefix: np.ndarray, flips: np.ndarray, most: int) -> Iterator[slice]:
        """Slices of whole prefixes that name about ``most`` variants each."""
        cost = np.cumsum(_cost(flips, low_bits))
        last = np.flatnonzero(np.concatenate([prefix[1:] != prefix[:-1], [True]]))
        start = 0
        for k, end in enumerate(last):
            if k + 1 == len(last) or cost[last[k + 1]] - (cost[start - 1] if start else 0) > most:
                yield slice(start, end + 1)
                start = end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def columns(batch):
            return (batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("prefix").to_numpy(zero_copy_only=False), batch.column("flips").to_numpy(zero_copy_only=False))

        for batch in batches:
            held.append(columns(batch))
            size += batch.num_rows
            if size < SORT_CHUNK // 512:
                continue
            fp, prefix, flips = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = int(np.searchsorted(prefix, prefix[-1]))  # the last prefix may go on in the next batch
            held, size = [(fp[whole:], prefix[whole:], flips[whole:])], len(fp) - whole
            for s in pieces(prefix[:whole], flips[:whole], SORT_CHUNK):
                yield from forest(fp[s], prefix[s], flips[s])
        if held:
            fp, prefix, flips = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(fp):
                for s in pieces(prefix, flips, SORT_CHUNK):
                    yield from forest(fp[s], prefix[s], flips[s])

    return run


def fingerprint_links(distinct_fps: DataFrame) -> DataFrame:
    """(src, dst) links whose components are those of all pairs of distinct
    fingerprints (fp) that differ in at most three bits."""
    n = distinct_fps.count()
    bits = min(24, max(6, (n // 64).bit_length()))
    odd = F.bit_count("fp") % 2 == 1
    sent = distinct_fps.select("fp", F.explode(F.when(odd, _mask_array(bits, 2)).otherwise(_mask_array(bits, 1))).alias("m")).select(
        "fp", F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("m.mask")), 64 - bits).alias("prefix"), F.col("m.flips").alias("flips")
    )
    tasks = max(int(distinct_fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 20_000)
    return sent.repartition(tasks, "prefix").sortWithinPartitions("prefix").mapInArrow(_linked(64 - bits), "src long, dst long")


def _components(prints: DataFrame) -> DataFrame:
    """(fp, component_id, label) for each fingerprint of ``prints``."""
    distinct = freeze(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected_components(fingerprint_links(distinct.select("fp")))
    labelled = freeze(distinct.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    least = freeze(labelled.groupBy("label").agg(F.min("least").alias("component_id")))
    return freeze(labelled.join(least, "label").select("fp", "component_id", "label"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex
    digits), component_id (the least doc_id reachable over links of at most
    three differing bits).

    Null and blank texts have fingerprint zero and link as any other. Rows that
    repeat a doc_id stay, each with its own fingerprint; a null doc_id stays
    and is a component's id only where no other row is. Other columns are
    ignored; an empty table gives an empty result.
    """
    prints = freeze(fingerprints(docs, shingle_words).drop("rid"))
    per_fp = _components(prints).drop("label")
    return prints.join(per_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row of each component: that with the least doc_id
    (nulls last), then the least hash of the text; of rows equal in both, one."""
    prints = freeze(fingerprints(docs, shingle_words))
    first = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid")
    best = prints.join(_components(prints), "fp").groupBy("label").agg(F.min(first).alias("best"))
    wanted = freeze(best.select(F.col("best.doc_id").alias("_best_id"), F.col("best.rid").alias("_best_rid")))
    rid = F.xxhash64(F.col("text").cast("string"))
    found = docs.withColumn("_rid", rid).join(wanted, F.col("doc_id").cast("long").eqNullSafe(F.col("_best_id")) & (F.col("_rid") == F.col("_best_rid")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", "_rid").orderBy(F.lit(1)))
    return found.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_rid")
