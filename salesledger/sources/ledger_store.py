"""The ledger as Parquet files and a log of versions.

A version is a list of files. Every commit is an entry of a log
(``<path>_meta/log``) that adds files, removes files or raises the high-water
mark; entries are created exclusively, so a writer that comes second reads again
and tries the next number. Files are written before their entry, so a failure
half-way changes nothing.

* ``append`` and ``import_rows`` add files; an import first reserves its ids by
  raising the mark, so two imports at once get different ones, and ids are never
  reused, even after deletes or a failed write.
* ``update`` and ``delete`` rewrite the files that hold a named id, found by the
  ids' range of each file and a scan of the id column of those that could.
* Rules of the table (no null id, amount, category or date; no id twice) are
  observed while files are written; a breach raises and nothing is committed.
* With each batch of files goes a small table of parts: per file, day and category
  the parts of its total and its count. ``cells`` adds up the parts of a version's
  files, so a summary reads no rows of the ledger; ``page`` finds the days
  of a page in them.

Files that no version lists any more are the caller's to remove.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from salesledger.functions import money_parts
from salesledger.operators.changes import apply_updates, delete_ids, latest_changes
from salesledger.operators.ids import number_in_place, number_rows
from salesledger.operators.ledger import PAGE_SIZE, LedgerSummary, ledger_summary
from salesledger.session import written_once
from salesledger.sources.commit_log import CommitLog, join_path

LEDGER_SCHEMA = StructType(
    [
        StructField("id", LongType(), False),
        StructField("amount", DoubleType(), False),
        StructField("category", StringType(), False),
        StructField("description", StringType(), True),
        StructField("date", DateType(), False),
    ]
)
NOT_NULL = tuple(f.name for f in LEDGER_SCHEMA if not f.nullable)
_PARTS_SCHEMA = "file string, date date, category string, _exact decimal(38,4), _rest double, _n long, min_id long, max_id long"
#: Every so many entries one holds the whole state, so that few are read.
SNAPSHOT_EVERY = 16
#: Times that a commit is tried again after another writer's.
TRIES = 100

# A file of the ledger: [name, least id, greatest id]; the name is batch/file.
File = list


class LedgerTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.log = CommitLog(spark, join_path(f"{self.path}_meta", "log"))

    # -- versions ----------------------------------------------------------
    def _state(self) -> tuple[int, dict]:
        """(number of the last entry, {"hwm": ..., "files": {name: File}})."""
        last = self.log.last()
        if last < 0:
            raise ValueError(f"no ledger at {self.path}")
        state: dict = {"hwm": 0, "files": {}}
        for entry in self.log.read(last - last % SNAPSHOT_EVERY, last):
            state = _apply(state, entry)
        return last, state

    def _commit(self, change: Callable[[dict], dict]) -> dict:
        """Create the next entry from the state that it follows; the entry."""
        for _ in range(TRIES):
            last, state = self._state()
            entry = change(state)
            full = (last + 1) % SNAPSHOT_EVERY == 0
            after = _apply(state, entry)
            stored = {"hwm": after["hwm"], "all": list(after["files"].values())} if full else entry
            if self.log.create(last + 1, stored):
                return entry
        raise RuntimeError(f"other writers kept changing {self.path}")

    def high_water_mark(self) -> int:
        return self._state()[1]["hwm"]

    def version(self) -> int:
        """The number of the last commit."""
        return self._state()[0]

    def files(self) -> list[str]:
        """Paths of the current version's files."""
        return [join_path(self.path, name) for name in self._state()[1]["files"]]

    # -- declaration and scans -------------------------------------------
    def create_if_absent(self) -> LedgerTable:
        if self.log.last() < 0:
            self.log.create(0, {"hwm": 0, "all": []})  # whoever is first
        return self

    def read(self) -> DataFrame:
        return self._read(self._state()[1]["files"])

    def _read(self, names: Sequence[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(*[join_path(self.path, n) for n in names])

    def newest_first(self) -> DataFrame:
        return self.read().orderBy(F.desc("date"), F.desc("id"))

    def _parts(self, names: Sequence[str]) -> DataFrame:
        """The parts of some files."""
        if not names:
            return self.spark.createDataFrame([], _PARTS_SCHEMA)
        batches = sorted({n.partition("/")[0] for n in names})
        parts = self.spark.read.schema(_PARTS_SCHEMA).parquet(*[self._parts_path(b) for b in batches])
        listed = self.spark.createDataFrame([(n,) for n in names], "file string")
        return parts.join(listed, "file", "left_semi")

    def _parts_path(self, batch: str) -> str:
        return join_path(f"{self.path}_meta", "parts", batch)

    def cells(self) -> DataFrame:
        """``day_category_totals`` of the ledger, from the parts of its files: no
        row of the ledger is read."""
        parts = self._parts(list(self._state()[1]["files"]))
        return parts.groupBy("date", "category").agg(F.sum("_exact").alias("_exact"), F.sum("_rest").alias("_rest"), F.sum("_n").alias("_n"))

    def summary(self) -> LedgerSummary:
        """KPIs, breakdown, highest category and trend, from the parts."""
        return ledger_summary(self.cells())

    def page(self, page_no: int = 1, size: int = PAGE_SIZE) -> DataFrame:
        """One page of the newest-first listing. Counts per day tell on which days
        it lies; only files with rows of those days are read, and of those only
        the days, so a deep page costs no more than the first."""
        if page_no < 1 or size < 1:
            raise ValueError("page_no and size must be ≥ 1")
        names, start = list(self._state()[1]["files"]), (page_no - 1) * size
        parts = self._parts(names)
        days = parts.groupBy("date").agg(F.sum("_n").alias("n"))  # one row a day
        upto = days.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        hit = upto.where((F.col("upto") > start) & (F.col("upto") - F.col("n") < start + size))
        first, last, before = hit.agg(F.min("date"), F.max("date"), F.min(F.col("upto") - F.col("n"))).first()
        if first is None:
            return self._read([])
        of_days = F.col("date").between(first, last)
        read = self._read([r["file"] for r in parts.where(of_days).select("file").distinct().collect()])
        return read.where(of_days).orderBy(F.desc("date"), F.desc("id")).offset(start - before).limit(size)

    # -- writes ----------------------------------------------------------
    def append(self, rows: DataFrame) -> int:
        """Append numbered rows; returns how many were written. An id that occurs
        twice, or in the table already, raises."""
        added, n = self._write(rows)
        if not added:
            return 0
        ids = self._ids([f[0] for f in added])
        _refuse(ids.groupBy("id").count().where("count > 1").select("id"), "ids that occur twice")
        checked: set[str] = set()

        def change(state: dict) -> dict:
            near = [f[0] for f in state["files"].values() if f[0] not in checked and any(f[1] <= a[2] and a[1] <= f[2] for a in added)]
            if near:
                _refuse(ids.join(self._ids(near), "id", "left_semi"), "ids that the table holds")
            checked.update(state["files"])
            return {"hwm": max(state["hwm"], max(f[2] for f in added)), "add": added}

        self._commit(change)
        return n

    def import_rows(self, cleaned: DataFrame, order_cols: Sequence[str | Column], start_after: int | None = None, in_place: bool = False) -> int:
        """Number ``cleaned`` (amount, category, description, date, order
        columns) after ``start_after`` (default: the high-water mark) in
        ``order_cols`` order, append. ``in_place``: see ``number_in_place``."""
        numbered, n = number_in_place(cleaned) if in_place else number_rows(cleaned, order_cols)
        if not n:
            return 0
        # ids of a write that fails are skipped, never handed out again
        reserved = self._commit(lambda state: {"hwm": max(state["hwm"], start_after or 0) + n})
        added, written = self._write(numbered.withColumn("id", F.col("id") + F.lit(reserved["hwm"] - n)))
        self._commit(lambda state: {"hwm": state["hwm"], "add": added})
        return written

    def replace(self, new_content: DataFrame) -> None:
        """The table's new content as a whole."""
        added, _ = self._write(new_content)
        if added:
            _refuse(self._ids([f[0] for f in added]).groupBy("id").count().where("count > 1").select("id"), "ids that occur twice")
        top = max((f[2] for f in added), default=0)
        self._commit(lambda state: {"hwm": max(state["hwm"], top), "add": added, "remove": list(state["files"])})

    def update(self, changes: DataFrame, order_col: str | None = None) -> int:
        """Changes that an edit form would accept, the last per id; returns the
        number of files that were written anew."""
        last = written_once(latest_changes(changes, order_col, only_valid=True))
        return self._rewrite(last.select("id"), lambda rows: apply_updates(rows, last))

    def delete(self, ids: DataFrame) -> int:
        """Remove the rows with these ids; returns the number of files that were
        written anew."""
        named = written_once(ids.select(F.col("id").cast("long").alias("id")).distinct())
        return self._rewrite(named, lambda rows: delete_ids(rows, named))

    def _rewrite(self, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Write the files that hold one of ``ids`` anew. If another writer took one
        of them away meanwhile, all is done again."""
        for _ in range(TRIES):
            state = self._state()[1]
            held = self._holding(state["files"], ids)
            if not held:
                return 0
            added, _ = self._write(change(self._read(held)))
            entry = self._commit(lambda now, held=held, added=added: {"hwm": now["hwm"], "add": added, "remove": held} if set(held) <= set(now["files"]) else {"hwm": now["hwm"]})
            if "remove" in entry:
                return len(held)
        raise RuntimeError(f"other writers kept changing {self.path}")

    def _holding(self, files: dict[str, File], ids: DataFrame) -> list[str]:
        """Names of the files that hold one of ``ids``."""
        low, high = ids.agg(F.min("id"), F.max("id")).first()
        near = [f[0] for f in files.values() if low is not None and f[1] <= high and low <= f[2]]
        if not near:
            return []
        found = self._ids(near, with_file=True).join(ids, "id", "left_semi").select("file").distinct()
        return sorted(r["file"] for r in found.collect())

    def _ids(self, names: Sequence[str], with_file: bool = False) -> DataFrame:
        ids = self._read(names).select("id", _file_name().alias("file"))
        return ids if with_file else ids.select("id")

    def _write(self, rows: DataFrame) -> tuple[list[File], int]:
        """Write rows as a batch of files and their parts; (files, rows). Breaches
        of the table's rules are counted on the way and raise."""
        batch = uuid.uuid4().hex
        seen = Observation("ledger_write")
        nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in NOT_NULL]
        out = rows.select(*[F.col(f.name).cast(f.dataType) for f in LEDGER_SCHEMA]).observe(seen, F.count(F.lit(1)).alias("n"), *nulls)
        out.write.parquet(join_path(self.path, batch))
        stats = seen.get
        breached = [f"{c} is null in {stats[c]} rows" for c in NOT_NULL if stats.get(c)]
        if breached:
            raise ValueError(f"not written, {self.path} is unchanged: {', '.join(breached)}")
        n = int(stats.get("n") or 0)
        if not n:
            return [], 0
        exact, rest = money_parts("amount")
        written = self.spark.read.schema(LEDGER_SCHEMA).parquet(join_path(self.path, batch)).withColumn("file", _file_name())
        parts = written.groupBy("file", "date", "category").agg(
            exact.cast("decimal(38,4)").alias("_exact"), rest.alias("_rest"), F.count("id").alias("_n"), F.min("id").alias("min_id"), F.max("id").alias("max_id")
        )
        parts.write.parquet(self._parts_path(batch))
        stored = self.spark.read.schema(_PARTS_SCHEMA).parquet(self._parts_path(batch))
        files = stored.groupBy("file").agg(F.min("min_id"), F.max("max_id")).collect()  # one row a file
        return sorted([list(f) for f in files]), n


def _file_name() -> Column:
    """batch/file of a row of the ledger."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -2)


def _apply(state: dict, entry: dict) -> dict:
    """The state after a log entry."""
    if "all" in entry:
        return {"hwm": entry["hwm"], "files": {f[0]: f for f in entry["all"]}}
    removed = set(entry.get("remove", ()))
    kept = {name: f for name, f in state["files"].items() if name not in removed}
    return {"hwm": entry["hwm"], "files": kept | {f[0]: f for f in entry.get("add", ())}}


def _refuse(ids: DataFrame, what: str) -> None:
    found = [r["id"] for r in ids.select("id").head(3)]
    if found:
        raise ValueError(f"not written: {what}, such as {found}")
