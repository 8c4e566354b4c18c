"""CSV scan for sales and ledger uploads.

All columns are read as text (types are decided by the cleaning rules), the
header row names the columns, and every row gets a ``row_seq`` that follows file
order: ``struct(file path, split start, position)``. The position alone is not
enough: a file split into several partitions, or several files packed into
one, would interleave.

Files are read in splits, also where quoted cells hold newlines. One pass over
the lines finds, for each split, its first line, whether any line opens a quoted
cell that it does not close, and what the split does to the state "inside a quoted
cell", which depends on the state before it. Files without such a line are plain:
every line is a record, and Spark's reader takes their splits as they are. For the
others the splits' functions are composed along a file (one row per split), and a
second pass over the same splits puts the lines of each record together where they are;
only records that cross a split's end are grouped. Their cells are parsed once and
written in file order.

Records that cannot be rows are rejects, not errors and not silence: those
with more cells than the header, and a last record whose quote is never closed.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from salesledger.functions import strip_replacement_chars
from salesledger.session import written_once
from salesledger.sources.csv_lines import LEADING, RECORD_SCHEMA, SPLIT_SCHEMA, SPLITS_CHANGED, records, split_functions

SEQ_COL = "row_seq"
TOO_LONG = "more cells than the header"
UNCLOSED = "a quote that is never closed"
# Times that splits are cut anew, as when executors come or go between the passes.
TRIES = 5
# Lines that a header may span.
HEADER_LINES = 100
# A cell that ends a record, to tell how many cells it has.
_END = "\u0001end\u0001"


@dataclass
class CsvTable:
    """Files with one header: ``rows`` (the header's columns and ``row_seq``, in tasks
    that see them in file order), and ``rejects``: file, row_seq, reason, record (of an
    unclosed one the first line), lines. Rows and rejects together are the files' records."""

    names: list[str]
    files: list[str]
    rows: DataFrame
    rejects: DataFrame


def scan_csv(
    spark: SparkSession, paths: str | Sequence[str], csv_only: bool = True, multiline: bool = True, strict: bool = False
) -> list[CsvTable]:
    """Read one file, a folder, or a list of either: a table for each distinct
    header, in the order of its first file.

    ``csv_only`` keeps only ``*.csv`` names in folders. Quoted newlines are part of
    their cell; ``multiline=False`` takes every line as a record, for input
    known to have none. Missing cells at the end of a row are null, blank lines
    are no records, bytes that are not UTF-8 are dropped. An unreadable path, no
    file at all, and a file without a header are a ``ValueError``. With ``strict``
    a reject raises when the rows are read, whichever columns are used.
    """
    where = [paths] if isinstance(paths, str) else list(paths)
    try:
        lines = _lines(spark, where, csv_only)
        splits = _splits(lines, multiline)
        layout = _layout(lines, splits)
    except Exception as exc:  # noqa: BLE001 - one kind of error for every unreadable input
        raise ValueError(f"cannot read CSV text from {paths}: {exc}") from exc
    tables = []
    for header, files in layout.items():
        names = _names(spark, min(f for f, _ in files))
        parts = []
        for spread in (False, True):
            own = [f for f, multi in files if multi == spread]
            if own:
                whole = len(own) == sum(map(len, layout.values()))
                read = where if whole else [_as_path(f) for f in own]
                if not spread:
                    parts.append(_plain(spark, read, csv_only and whole, names, strict))
                    continue
                # fewer files may be cut into other splits
                its_lines = lines if whole else _lines(spark, read, False)
                parts.append(_spread(its_lines, splits if whole else _splits(its_lines, multiline), names, strict))
        rows, rejects = parts[0]
        for r, j in parts[1:]:
            rows, rejects = rows.unionByName(r), rejects.unionByName(j)
        tables.append(CsvTable(names, sorted(f for f, _ in files), rows, rejects))
    return sorted(tables, key=lambda t: t.files[0])


def read_csv_text(
    spark: SparkSession,
    paths: str | Sequence[str],
    csv_only: bool = True,
    multiline: bool = True,
    with_seq: bool = True,
) -> DataFrame:
    """The rows of files that share one header, read strictly; see :func:`scan_csv`.
    Files with different headers are a ``ValueError`` (``read_csv_groups`` reads
    those)."""
    tables = scan_csv(spark, paths, csv_only, multiline, strict=True)
    if len(tables) > 1:
        shown = "; ".join(f"{t.files[0]}: {', '.join(t.names)}" for t in tables[:3])
        raise ValueError(f"the files have {len(tables)} different headers: {shown}")
    return tables[0].rows if with_seq else tables[0].rows.drop(SEQ_COL)


def read_csv_groups(spark: SparkSession, paths: str | Sequence[str], multiline: bool = True) -> list[DataFrame]:
    """One table per distinct header among ``paths``, each like ``read_csv_text``:
    normalize the names, then ``unionByName``."""
    return [t.rows for t in scan_csv(spark, paths, multiline=multiline, strict=True)]


def all_rejects(tables: Sequence[CsvTable]) -> DataFrame:
    """The rejects of several tables."""
    rejects = tables[0].rejects
    for t in tables[1:]:
        rejects = rejects.unionByName(t.rejects)
    return rejects


# -- the layout of the files ---------------------------------------------------


def _lines(spark: SparkSession, where: Sequence[str], csv_only: bool) -> DataFrame:
    """(file, block, pos, line): the lines of files, in splits."""
    reader = spark.read.option("lineSep", "\n")
    if csv_only:
        reader = reader.option("pathGlobFilter", "*.csv")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return reader.text(list(where)).select(*place, F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def _has_quote(line: Column) -> Column:
    return F.contains(line, F.lit('"'))


def _is_blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\r\t", "  ")) == ""


def _splits(lines: DataFrame, multiline: bool) -> DataFrame:
    """A row per split that has lines; see ``split_functions``."""
    quoted = _has_quote(F.col("line")) if multiline else F.lit(False)
    rows = lines.select("file", "block", F.col("line").cast("binary").alias("line"), quoted.alias("quoted"), _is_blank(F.col("line")).alias("blank"))
    return written_once(rows.mapInArrow(split_functions, SPLIT_SCHEMA))


def _layout(lines: DataFrame, splits: DataFrame) -> dict[str, list[tuple[str, bool]]]:
    """header's hash -> (file, whether a line opens a cell that it does not close)."""
    text = F.xxhash64(F.rtrim(F.translate(F.col("head").cast("string"), "\r", " ")))
    found = splits.where("head is not null").groupBy("file").agg(F.min_by(text, "block").alias("first"), F.bool_or("_opens").alias("multi")).collect()
    if not found:
        raise ValueError("no CSV file with a header")
    without = {_as_path(f) for f in lines.inputFiles()} - {_as_path(r["file"]) for r in found}
    if without:
        raise ValueError(f"no header in {', '.join(sorted(without)[:3])}")
    layout: dict[str, list[tuple[str, bool]]] = defaultdict(list)
    for r in found:
        layout[str(r["first"])].append((r["file"], r["multi"]))
    return layout


def _as_path(uri: str) -> str:
    uri = re.sub("^file:/+", "/", uri)
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def _names(spark: SparkSession, file: str) -> list[str]:
    """The names in a file's header; empty and repeated ones take their place's number."""
    lines = _lines(spark, [_as_path(file)], False).where(~_is_blank(F.col("line"))).select("line").head(HEADER_LINES)
    cells = next(csv.reader(r["line"].rstrip("\r") + "\n" for r in lines))
    if any("\r" in c for c in cells):
        raise ValueError(f"{file} ends its lines with carriage returns alone")
    names = [c.replace("\ufffd", "") for c in cells]
    seen = [n.lower() for n in names]
    return [f"_c{k}" if not n else f"{n}{k}" if seen.count(n.lower()) > 1 else n for k, n in enumerate(names)]


# -- records to rows -------------------------------------------------------------


def _schema(names: Sequence[str], bad: str) -> StructType:
    """Columns by place: header names may repeat or clash with ours."""
    return StructType([StructField(f"c{k}", StringType()) for k in range(len(names))] + [StructField(bad, StringType())])


def _only(rows: DataFrame, fits: Column, strict: bool, message: str, record: str) -> DataFrame:
    """The rows that fit; with ``strict`` others raise. A filter, so no projection removes it."""
    if strict:
        fits = F.when(fits, True).otherwise(F.raise_error(F.concat(F.col(f"{SEQ_COL}.file"), F.lit(f": {message}: "), F.col(record))).cast("boolean"))
    return rows.where(fits)


def _fits(names: Sequence[str], bad: str) -> Column:
    """Whether a record has no more cells than the header; ``bad`` is the text of one
    with too few or too many."""
    cells = StructType([StructField(f"c{k}", StringType()) for k in range(len(names))])
    with_end = F.from_csv(F.concat(F.col(bad), F.lit("," + _END)), F.lit(cells.simpleString()), {"escape": '"', "multiLine": "true"})
    short = F.coalesce(F.array_contains(F.array(*[with_end.getField(f.name) for f in cells]), _END), F.lit(False))
    return F.col(bad).isNull() | short


def _split(parsed: DataFrame, names: Sequence[str], bad: str, fits: Column, strict: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of (c0, c1, ..., bad, row_seq, lines)."""
    message = f"a row has more than the header's {len(names)} cells"
    rows = _only(parsed, fits, strict, message, bad).select(*[strip_replacement_chars(F.col(f"c{k}")).alias(n) for k, n in enumerate(names)], SEQ_COL)
    rejects = parsed.where(~fits).select(F.col(f"{SEQ_COL}.file").alias("file"), SEQ_COL, F.lit(TOO_LONG).alias("reason"), F.col(bad).alias("record"), "lines")
    return rows, rejects


def _plain(spark: SparkSession, where: Sequence[str], csv_only: bool, names: Sequence[str], strict: bool) -> tuple[DataFrame, DataFrame]:
    """Files in which every line is a record."""
    bad = "_bad"
    # without column pruning every record's cells are counted, whichever columns are used
    options = {"header": True, "encoding": "UTF-8", "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "columnPruning": False}
    reader = spark.read.schema(_schema(names, bad)).options(**options)
    if csv_only:
        reader = reader.option("pathGlobFilter", "*.csv")
    seq = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))
    parsed = reader.csv(list(where)).withColumns({SEQ_COL: seq, "lines": F.lit(1).cast("long")})
    # always true: the reader refuses queries that use the column of bad records alone
    return _split(parsed.where(F.coalesce(F.length("c0"), F.lit(0)) >= 0), names, bad, _fits(names, bad), strict)


def _spread(lines: DataFrame, splits: DataFrame, names: Sequence[str], strict: bool) -> tuple[DataFrame, DataFrame]:
    """Files with records over several lines. ``splits`` are those of ``lines``."""
    bad, seq = "_bad", F.struct("file", "block", "pos").alias(SEQ_COL)
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}

    def parsed(found: DataFrame, record: Column, *own: str) -> DataFrame:
        cell = F.from_csv(F.regexp_replace(record, "\r$", ""), F.lit(_schema(names, bad).simpleString()), options)
        cells = found.select(*own, F.inline(F.array(cell)))  # a generator: parsed once for all columns
        return written_once(cells.withColumn("_fits", _fits(names, bad)))

    for tried in range(1, TRIES + 1):
        placed = written_once(_placed(splits))
        found = _records(lines, placed)
        try:
            in_splits = parsed(found, F.when(F.col("part").isNull(), F.col("record")), *[c for c in found.columns if c != "record"])
            break
        except Exception as exc:  # noqa: BLE001 - raised by a task
            if SPLITS_CHANGED not in str(exc) or tried == TRIES:
                raise
            splits = _splits(lines, True)
    over = _crossing(in_splits.where("part is not null"))
    across = parsed(over, F.when(~F.col("unclosed"), F.col("text")), *over.columns)
    whole = in_splits.where("part is null").withColumn("unclosed", F.lit(False))
    rows, rejects = _split(whole.select("*", seq), names, bad, F.col("_fits"), strict)
    crossing = across.select("*", seq)
    closed = _only(crossing, ~F.col("unclosed"), strict, UNCLOSED, "text")
    more, too_long = _split(closed, names, bad, F.col("_fits"), strict)
    unclosed = crossing.where("unclosed").select("file", SEQ_COL, F.lit(UNCLOSED).alias("reason"), F.col("text").alias("record"), "lines")
    return rows.unionByName(more), rejects.unionByName(too_long).unionByName(unclosed)


def _state_after(rows: DataFrame, start: Column, group: Sequence[str], order: str, name: str) -> DataFrame:
    """Add ``name``: the state after each row along ``order``, from ``start`` before
    the first. A row leaves ``_out`` if it meets the state outside, ``_in`` if it
    meets the state inside; so it keeps a state, turns it, or sets it."""
    along = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns, sets = F.col("_out") & ~F.col("_in"), F.col("_out") == F.col("_in")
    counted = rows.withColumn("_turns", F.sum(turns.cast("long")).over(along))
    last_set = F.last(F.when(sets, F.struct(F.col("_out").alias("state"), "_turns")), ignorenulls=True).over(along)

    def turned(state: Column, n: Column) -> Column:
        return F.when(n % 2 == 1, ~state).otherwise(state)

    state = F.coalesce(turned(F.col("_set.state"), F.col("_turns") - F.col("_set._turns")), turned(start, F.col("_turns")))
    return counted.withColumn("_set", last_set).withColumn(name, state).drop("_turns", "_set")


def _placed(splits: DataFrame) -> DataFrame:
    """(split, file, block, start, header, unclosed, n_lines, owner): what ``records`` must
    know of a split, and the block in which the record of its leading lines begins.

    Windows run over a file's splits, one row each."""
    in_file = Window.partitionBy("file").orderBy("block")
    opened = _state_after(splits, F.lit(False), ["file"], "block", "_left_open")
    started = opened.withColumn("start", F.coalesce(F.lag("_left_open").over(in_file), F.lit(False)))
    counted = started.withColumn("_n", F.when(F.col("start"), F.col("n_in")).otherwise(F.col("n_out")))
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    all_splits = in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    holder = F.when(F.col("_n") > 0, F.struct("block", F.col("_n").alias("no")))
    owners = counted.select(
        "file",
        "block",
        "start",
        "_n",
        "n_lines",
        F.last(holder, ignorenulls=True).over(before).alias("_before"),
        F.last(holder, ignorenulls=True).over(all_splits).getField("block").alias("_last"),
        F.first(holder, ignorenulls=True).over(all_splits).getField("block").alias("_first"),
        F.last("_left_open").over(all_splits).alias("_open"),
    )
    # lines before a split's first record belong to the last record of the splits before it
    leading_header = (F.col("_before.block") == F.col("_first")) & (F.col("_before.no") == 1)
    header = F.when(F.col("block") == F.col("_first"), 1).when(leading_header, 0).otherwise(-1)
    unclosed = F.when(F.col("_open") & (F.col("block") == F.col("_last")), F.col("_n")).when(F.col("_open") & (F.col("_before.block") == F.col("_last")), 0).otherwise(-1)
    return owners.select(
        F.monotonically_increasing_id().alias("split"), "file", "block", "start", header.cast("long").alias("header"), unclosed.cast("long").alias("unclosed"), "n_lines", F.col("_before.block").alias("owner")
    )


def _records(lines: DataFrame, placed: DataFrame) -> DataFrame:
    """(file, block, pos, record, lines, part, text, owner, unclosed), without headers,
    in file order. A record that crosses a split's end comes in parts (see
    ``records``): its ``text``, the block that it begins in, whether it is never closed."""
    known = lines.join(F.broadcast(placed.drop("owner")), ["file", "block"], "left")
    rows = known.select("split", "start", "header", "unclosed", "n_lines", "pos", F.col("line").cast("binary").alias("line"), _has_quote(F.col("line")).alias("quoted"), _is_blank(F.col("line")).alias("blank"))
    found = rows.mapInArrow(records, RECORD_SCHEMA).withColumn("record", F.col("record").cast("string"))
    back = found.join(F.broadcast(placed.select("split", "file", "block", F.col("unclosed").alias("_unclosed"), F.col("owner").alias("_owner"))), "split")
    leading, part = F.col("part") == LEADING, F.col("part").isNotNull()
    return back.select(
        "file",
        "block",
        "pos",
        "record",
        "lines",
        "part",
        F.when(part, F.col("record")).alias("text"),
        F.when(leading, F.col("_owner")).when(part, F.col("block")).alias("owner"),
        F.when(leading, F.col("_unclosed") == 0).when(part, F.col("_unclosed") > 0).alias("unclosed"),
    )


def _crossing(parts: DataFrame) -> DataFrame:
    """(file, block, pos, text, lines, unclosed) of the records that cross a split's
    end: at most one begins in a split."""
    kept = F.collect_list(F.when(F.col("text").isNotNull(), F.struct("block", "text")))
    joined = parts.groupBy("file", "owner").agg(kept.alias("ls"), F.sum("lines").alias("lines"), F.bool_or("unclosed").alias("unclosed"), F.min_by("pos", "block").alias("pos"))
    text = F.array_join(F.transform(F.sort_array("ls"), lambda x: x["text"]), "\n")
    return joined.select("file", F.col("owner").alias("block"), "pos", text.alias("text"), "lines", "unclosed")
