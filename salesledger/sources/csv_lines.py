"""What a task does with the lines of a CSV split, as Arrow batches in file order.

``split_functions`` tells for each split what it does to the state "inside a quoted
cell"; ``records`` puts lines together once the state before each split is known.
Executors need not have this package, so its functions travel by value.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT_SCHEMA = "file string, block long, head binary, _opens boolean, _out boolean, _in boolean, n_out long, n_in long, n_lines long"
RECORD_SCHEMA = "split long, pos long, record binary, lines long, part int"
#: What an error says when the two passes did not see the same splits.
SPLITS_CHANGED = "the splits of the input changed while it was read"
#: A record's lines at a split's start that it does not begin in, and at the
#: end of the split that it begins in but does not end in.
LEADING, TRAILING = 0, 1
# States along a line: at a cell's start, in a bare cell, in a quoted cell, and
# after a quote in one (the next character tells whether it was the last).
_START, _BARE, _QUOTED, _QUOTE = range(4)


def ends_quoted(line: bytes, inside: bool) -> bool:
    """Whether a line that starts inside a quoted cell (or outside) ends inside one."""
    head, *pieces = line.split(b'"')
    if inside:
        state = _QUOTED
    else:
        state = _START if not head or head.endswith(b",") else _BARE
    for text in pieces:
        if state == _START or state == _QUOTE:
            state = _QUOTED
        elif state == _QUOTED and not text:
            state = _QUOTE
        else:
            state = _START if text.endswith(b",") else _BARE
    return state == _QUOTED


def _edges(batch: pa.RecordBatch, columns: Iterable[str]) -> list[tuple[int, int]]:
    """(start, stop) of the runs of rows with equal values of ``columns``."""
    change = np.zeros(batch.num_rows - 1, bool)
    for c in columns:
        column = batch.column(c)
        if pa.types.is_string(column.type):
            column = column.dictionary_encode().indices
        values = column.to_numpy(zero_copy_only=False)
        change |= values[1:] != values[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def split_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per split of (file, block, line, quoted, blank): its first line that is
    not blank, whether a line opens a cell that it does not close, for a start outside
    and inside the state at its end and the records that begin in it, and its lines."""
    names = [c.split()[0] for c in SPLIT_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    key, head, opens, state, begun, n_lines = None, None, False, [False, True], [0, 0], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*key, head, opens, *state, *begun, n_lines], types, strict=True)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        for lo, hi in _edges(batch, ["file", "block"]):
            run = batch.slice(lo, hi - lo)
            its = (run.column("file")[0].as_py(), run.column("block")[0].as_py())
            if its != key:
                if key is not None:
                    yield row()
                key, head, opens, state, begun, n_lines = its, None, False, [False, True], [0, 0], 0
            n_lines += hi - lo
            solid = ~run.column("blank").to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(solid)]).tolist()  # lines that are not blank
            if head is None and before[-1]:
                head = run.column("line")[int(solid.argmax())].as_py()
            quoted, done = run.column("quoted"), 0
            at = np.flatnonzero(quoted.to_numpy(zero_copy_only=False)).tolist()
            for k, line in zip(at, run.column("line").filter(quoted).to_pylist(), strict=True):
                # the state holds from the last quoted line up to this one
                for s in (0, 1):
                    if not state[s]:
                        begun[s] += before[k + 1] - before[done]
                if state[0] == state[1]:
                    state = [ends_quoted(line, state[0])] * 2
                else:
                    state = [ends_quoted(line, state[0]), ends_quoted(line, state[1])]
                opens, done = opens or state[0], k + 1
            for s in (0, 1):
                if not state[s]:
                    begun[s] += before[-1] - before[done]
    if key is not None:
        yield row()


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of (split, start, header, unclosed, n_lines, pos, line, quoted, blank),
    without headers.

    ``start``: whether the split starts inside a cell. ``header`` and ``unclosed``:
    the number of the record in the split that is the header or never closed; 0 is the
    one that the leading lines belong to. ``part`` is null for a whole record. Of an unclosed
    record, which may be the rest of a file, only the first line is kept."""
    names = ["split", "pos", "record", "lines", "part"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]
    split, header, unclosed, number, inside = None, -1, -1, 0, False
    held: list[bytes] = []
    n_held, began, n_lines, seen = 0, 0, 0, 0
    out: list[tuple] = []

    def flush(whole: bool) -> None:
        """The record that was held, or its part in this split."""
        nonlocal held, n_held
        if n_held and number != header:
            part = LEADING if not number else None if whole else TRAILING
            out.append((split, began, b"\n".join(held) if held else None, n_held, part))
        held, n_held = [], 0

    def ended() -> None:
        """The split's end: both passes must have met the same lines in it."""
        if seen != n_lines:
            raise ValueError(SPLITS_CHANGED)
        flush(False)

    for batch in batches:
        if not batch.num_rows:
            continue
        for lo, hi in _edges(batch, ["split"]):
            run = batch.slice(lo, hi - lo)
            if (its := run.column("split")[0].as_py()) != split:
                ended()
                if its is None:
                    raise ValueError(SPLITS_CHANGED)
                split, number, seen = its, 0, 0
                inside, header, unclosed, n_lines = (run.column(c)[0].as_py() for c in ("start", "header", "unclosed", "n_lines"))
            seen += hi - lo
            columns = (run.column(c).to_pylist() for c in ("pos", "line", "quoted", "blank"))
            for pos, line, quoted, blank in zip(*columns, strict=True):
                if not inside:
                    if blank:
                        continue
                    number += 1
                    inside = quoted and ends_quoted(line, False)
                    if not inside:
                        if number != header:
                            out.append((split, pos, line, 1, None))
                        continue
                    held, n_held, began = [line], 1, pos
                    continue
                if not n_held:
                    began = pos
                if number != unclosed and number != header:
                    held.append(line)
                n_held += 1
                if quoted and not ends_quoted(line, True):
                    inside = False
                    flush(True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out = []
    ended()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
