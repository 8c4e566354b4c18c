"""Best-fit packing by a configuration linear program.

Token lengths are counted into a histogram of at most 4096 entries, the only
thing that comes to the driver. A configuration is a set of lengths that fit
one sequence. Multiplicative weights price the lengths, first for the program's
dual, then for a fractional solution: in each round a knapsack dynamic program
over the prices gives the best configuration that holds a given length, lengths
behind their share of the round are covered by theirs if it is worth enough, and
lengths ahead become cheaper, those behind dearer. The solution is rounded to
whole sequences that never take more pieces than there are; what rounding leaves
goes to the best fit, counted by length as well.
Pieces are then ranked within their length and joined to the places that the
plan has for that length and rank.
"""

from __future__ import annotations

import math
import os
import re
import struct
import sys
import types
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesledger.llm.common import freeze, order_bucket, rank_within, small_batches

CAPACITY = 4096
END_ID = 1
#: Passes of the program over what is left, and rounds of each.
PASSES, ROUNDS = 4, 40
#: Price change of a length that is a whole share behind.
RATE = 0.05
#: How far below the best configuration's worth a length's own may lie, in the
#: first pass; the n-th takes n times that.
MARGIN = 0.03
#: Smaller amounts of a fractional solution count as none.
LEAST = 1e-6
#: (grid of lengths, rounds) of the lower bound.
BOUND_ROUNDS = ((1, 150), (16, 600))
#: Words whose ids a worker keeps, and the longest (bytes) that it keeps.
CACHE_WORDS = 500_000
CACHE_BYTES = 64
#: Text that a worker encodes at once.
GATHER_BYTES = 8 << 20


def _dearest(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room 0..capacity: the worth of the dearest set of lengths that
    fits (repeats allowed), and the length to take first, 0 for none."""
    value, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    priced = np.flatnonzero(price[: capacity + 1])
    for room in range(1, capacity + 1):
        fit = priced[: np.searchsorted(priced, room, "right")]
        with_first = value[room - fit] + price[fit]
        if len(fit) and with_first.max() > value[room - 1]:
            value[room], take[room] = with_first.max(), fit[with_first.argmax()]
        else:
            value[room], take[room] = value[room - 1], take[room - 1]
    return value, take


def knapsack(price: np.ndarray, capacity: int) -> np.ndarray:
    """For each room 0..capacity: the length to take first in the dearest set
    of lengths that fits (repeats allowed), 0 to leave the rest empty."""
    return _dearest(price, capacity)[1]


def _filled(take: np.ndarray, room: int, first: int = 0) -> dict[int, int]:
    """The dearest set for ``room``, with ``first`` in it, as lengths with counts."""
    held = {first: 1} if first else {}
    room -= first
    while room > 0 and (k := int(take[room])) > 0:
        held[k] = held.get(k, 0) + 1
        room -= k
    return held


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> dict[tuple[tuple[int, int], ...], float]:
    """A fractional solution of the configuration program: configurations as
    (length, count) pairs, and how many sequences have each. No length is held
    more than ``counts`` has it; what is held less is left to the rounding.

    A pass starts from the dual's prices. In each of its rounds every length that is
    behind its share gets sequences of the best configuration that holds it, if
    that one is worth nearly as much as the best of all; else it waits and becomes
    dearer. The next pass takes what the passes before left, with a wider margin."""
    found: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    left = counts.astype(np.float64)
    left[0] = 0
    for turn in range(1, PASSES + 1):
        if left.sum() < 1:
            break
        _one_pass(left, capacity, MARGIN * turn, found)
    return found


def _one_pass(left: np.ndarray, capacity: int, margin: float, found: dict[tuple[tuple[int, int], ...], float]) -> None:
    """Adds a pass's configurations to ``found`` and takes what they hold from ``left``."""
    demand = left.copy()
    lengths = np.flatnonzero(demand)
    price = np.zeros(capacity + 1)
    price[lengths] = _start_prices(demand, lengths, capacity)
    total = price.sum()
    for turn in range(1, ROUNDS + 1):
        value, take = _dearest(np.where(left > 0, price, 0.0), capacity)
        due = demand * turn / ROUNDS - (demand - left)
        worth = price[lengths] + value[capacity - lengths]
        near = worth >= (1 - margin) * value[capacity]
        for length in lengths[near][np.argsort(-worth[near], kind="stable")].tolist():
            if due[length] <= LEAST:
                continue
            held = _filled(take, capacity, length)
            times = min(due[length] / held[length], *(left[k] / v for k, v in held.items()))
            if times <= LEAST:
                continue
            found[tuple(sorted(held.items()))] += times
            for k, v in held.items():
                due[k] -= v * times
                left[k] -= v * times
        left[left <= LEAST] = 0
        ahead = 1 - left[lengths] / demand[lengths] - turn / ROUNDS
        price[lengths] *= np.exp(-RATE * ahead)
        price[lengths] *= total / price[lengths].sum()


def _start_prices(demand: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    grid, rounds = BOUND_ROUNDS[-1]
    prices = _dual(demand, capacity, grid, rounds)[1]
    classes = np.flatnonzero(prices)
    if not len(classes):
        return lengths / capacity
    return np.interp(lengths / grid, classes + 0.5, np.maximum.accumulate(prices[classes]))


def _rounded(found: dict[tuple[tuple[int, int], ...], float], remain: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Whole sequences of a fractional solution: each configuration's whole part,
    then one more of those with the largest fractions while their pieces last.
    Takes what they hold from ``remain``."""
    out = []
    parts = [(held, int(times + LEAST), times) for held, times in found.items()]
    largest = sorted(((held, 1, times) for held, whole, times in parts if times - whole > LEAST), key=lambda x: int(x[2]) - x[2])
    for held, times, _ in parts + largest:
        times = min(times, *(int(remain[k]) // v for k, v in held))
        if times > 0:
            out.append((dict(held), times))
            for k, v in held:
                remain[k] -= v * times
    return out


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing of ``counts[length]`` pieces needs, from the
    configuration program's dual: at prices of the lengths at which no
    configuration is worth over 1, all pieces together are worth no more than the
    sequences that hold them. Multiplicative weights look for such prices, by the
    best configuration of each round; once with the lengths as they are, and for
    more rounds with lengths taken down to a grid, which leaves it a bound."""
    tokens = int((np.arange(len(counts)) * counts).sum())
    found = [_dual(counts, capacity, grid, rounds)[0] for grid, rounds in BOUND_ROUNDS]
    return max(-(-tokens // capacity), math.ceil(max(found) - 1e-9))


def _dual(counts: np.ndarray, capacity: int, grid: int, rounds: int) -> tuple[float, np.ndarray]:
    """The best bound that the rounds find, and its price for each length of the
    grid, at which no configuration is worth over 1 (zeros if there is no piece)."""
    units = capacity // grid
    demand = np.bincount(np.arange(len(counts)) // grid, counts, minlength=units + 1)
    demand[0] = 0
    best, prices, share = 0.0, np.zeros(units + 1), np.zeros(units + 1)
    here = np.flatnonzero(demand)
    weight = here * demand[here]
    for turn in range(1, rounds + 1 if len(here) else 1):
        share[here] = weight / weight.sum() / demand[here]
        value, take = _dearest(share, units)
        if 1 / value[units] > best:
            best, prices = 1 / value[units], share / value[units]
        held = np.zeros(units + 1)
        for k, v in _filled(take, units).items():
            held[k] = v
        gain = held[here] / demand[here]
        weight = weight * np.exp(-gain / gain.max() * 2 / math.sqrt(turn))
    return best, prices


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations (lengths with counts) and how many sequences have each,
    for ``counts[length]`` pieces; every piece is in one."""
    remain = counts.astype(np.int64).copy()
    bins: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    open_ = np.zeros(capacity + 1, bool)

    def add(held: dict[int, int], times: int) -> None:
        free = capacity - sum(k * v for k, v in held.items())
        bins[free].append((held, times))
        open_[free] = True

    for held, times in _rounded(solve(counts, capacity), remain):
        add(held, times)
    for length in np.flatnonzero(remain)[::-1].tolist():
        left = int(remain[length])
        while left:
            at = length + int(open_[length:].argmax())
            if not open_[at]:
                add({}, left)
                continue
            held, times = bins[at].pop()
            open_[at] = bool(bins[at])
            each = min(at // length, left)
            use = min(times, left // each)
            if use < times:
                bins[at].append((held, times - use))
                open_[at] = True
            add(held | {length: held.get(length, 0) + each}, use)
            left -= each * use
    return [(held, times) for found in bins.values() for held, times in found if held]


def _places(spark: SparkSession, found: list[tuple[dict[int, int], int]]) -> DataFrame:
    """(length, rank, sequence_id, offset) for every piece of the plan."""
    rows, used, base = [], defaultdict(int), 0
    for held, times in found:
        offset = 0
        for length, each in held.items():
            rows.append((length, used[length], each, times, base, offset))
            used[length] += each * times
            offset += length * each
        base += times
    table = pd.DataFrame(rows, columns=["length", "first", "each", "times", "base", "offset"]).astype("int64")
    spans = spark.createDataFrame(table, "length long, first long, each long, times long, base long, offset long")
    nth = spans.select("*", F.explode(F.expr("sequence(0L, each * times - 1)")).alias("nth"))
    return nth.selectExpr("length", "first + nth as rank", "base + nth div each as sequence_id", "offset + (nth % each) * length as offset")


#: An ASCII letter or one of Latin-1 in UTF-8, then one full stop or comma: the
#: mark is a token sequence of its own for the tokenizer.
MARKED = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[.,]\Z")


class WordIds:
    """Token ids of words, as little-endian 32-bit bytes, for a tokenizer that
    lower-cases and splits texts at white space. Words beyond ``CACHE_WORDS``
    are kept for their batch alone."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[bytes, bytes] = {}
        self.marks = dict(zip((b".", b","), self._packed([b".", b","]), strict=True))

    def _packed(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in found]

    def _ids(self, names: list[bytes]) -> list[bytes]:
        ids = dict(zip(names, map(self.kept.get, names), strict=True))
        new = [w for w, known in ids.items() if known is None]
        marked = [w for w in new if MARKED.search(w, max(0, len(w) - 3))]
        plain = list(set(new).difference(marked).union(x[:-1] for x in marked if ids.get(x[:-1]) is None))
        ids.update(zip(plain, self._packed(plain), strict=True))
        ids.update([(w, ids[w[:-1]] + self.marks[w[-1:]]) for w in marked])
        room = max(0, CACHE_WORDS - len(self.kept))
        self.kept.update(islice(((w, ids[w]) for w in [*plain, *marked] if len(w) <= CACHE_BYTES), room))
        return [ids[w] for w in names]

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of each text; null has none. Arrow splits and gathers, so
        that Python sees each word of a batch once."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words = split.flatten().dictionary_encode()
        packed = pa.array(self._ids(words.dictionary.cast(pa.binary()).to_pylist()), pa.binary()).take(words.indices)
        if not len(packed):
            return [b""] * len(texts)
        _, offsets, data = packed.buffers()
        ends = np.frombuffer(offsets, np.int32)[packed.offset :][np.asarray(split.offsets) - split.offsets[0].as_py()].tolist()
        raw = memoryview(data) if data is not None else memoryview(b"")
        return [bytes(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def worker_words(path: str) -> WordIds:
    """The worker process's words, which outlive a task."""
    kept = vars(sys.modules.setdefault("_llm_worker", types.ModuleType("_llm_worker")))
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold ``GATHER_BYTES``: the more texts at once,
    the fewer words to look up for each."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHER_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text as token ids and
    an end id, cut where longer than ``capacity``."""
    small_batches(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()
    size = capacity * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(tokenizer_path)
        for batch in _gathered(batches):
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text")), strict=True):
                ids += end
                out += [(doc_id, k, at // 4, len(cut := ids[at : at + size]) // 4, zlib.crc32(cut)) for k, at in enumerate(range(0, len(ids), size))]
            columns = zip(*out, strict=True) if out else ([],) * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text): doc_id,
    piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Rows that repeat a doc_id are
    packed each. Other columns are ignored; an empty table gives an empty
    result. Pieces of one length go to that length's places in order of a hash
    of doc_id and piece.
    """
    spark = docs.sparkSession
    cut = freeze(pieces(docs, tokenizer_path, capacity).withColumn("h", F.xxhash64("doc_id", "piece")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    ranked = rank_within(cut.withColumn("bucket", order_bucket(F.col("h"))), ["length"], ["h", "doc_id", "piece", "ids_crc32"], "bucket", "rank")
    placed = ranked.join(_places(spark, plan(counts, capacity)), ["length", "rank"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
