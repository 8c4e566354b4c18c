"""Sinks: CSV with header, named report tables, and dashboard documents as
rows of JSON objects."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DecimalType, FractionalType, StringType, TimestampNTZType, TimestampType

from salesledger.sources.commit_log import CommitLog, join_path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header row and no index column; cells keep their outer blanks."""
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(**options).csv(path)


def render_rows(df: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Rows as an export sheet shows them, by column type: dates and
    timestamps as ``date_format`` text, missing text as ''; other values
    unchanged (a missing number is an empty cell in the sink)."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            cols.append(F.coalesce(F.date_format(c, date_format), F.lit("")).alias(f.name))
        elif isinstance(f.dataType, StringType):
            cols.append(F.coalesce(c, F.lit("")).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def write_report(tables: Mapping[str, DataFrame], root: str, report_id: str, fmt: str = "parquet") -> dict[str, str]:
    """One table per report sheet; returns their paths.

    The tables are written to a folder of their own, then one entry in the
    report's log makes them the report: a failure between tables leaves the report
    as it was. ``report_paths`` finds the current one."""
    spark = next(iter(tables.values())).sparkSession
    log, folder = _report_log(spark, root, report_id), uuid.uuid4().hex
    paths = {}
    for name, df in tables.items():
        paths[name] = join_path(root, f"report_id={report_id}", folder, name)
        if fmt == "csv":
            write_csv(df, paths[name])
        else:
            df.write.mode("overwrite").format(fmt).save(paths[name])
    while not log.create(log.last() + 1, {"folder": folder, "tables": list(tables), "format": fmt}):
        pass  # another run of the report came first; this one is newer
    return paths


def report_paths(spark: SparkSession, root: str, report_id: str) -> dict[str, str]:
    """The paths of the report's tables, as last published; empty if there are none."""
    log = _report_log(spark, root, report_id)
    last = log.last()
    entries = log.read(last, last) if last >= 0 else []
    return {name: join_path(root, f"report_id={report_id}", e["folder"], name) for e in entries for name in e["tables"]}


def _report_log(spark: SparkSession, root: str, report_id: str) -> CommitLog:
    return CommitLog(spark, join_path(root, f"report_id={report_id}", "versions"))


def _json_value(c: Column, kind: DataType) -> Column:
    """JSON text of a value.  Fractions have four places (money is exact there,
    shares have two); numbers too large for that are written in full."""
    if isinstance(kind, StringType):
        quoted = F.to_json(F.array(c))
        text = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    elif isinstance(kind, FractionalType) and not (isinstance(kind, DecimalType) and kind.scale == 0):
        text = F.coalesce(c.try_cast("decimal(38,4)").cast("string"), c.cast("string"))
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit("null")).otherwise(text)


def json_rows(df: DataFrame, section: str, key_col: str | None = None) -> DataFrame:
    """A table as rows of a document: ``section``, ``key`` (the row's
    ``key_col``, '' without one) and ``json`` (the row as one object).

    Every row is rendered where it is, so no task holds a whole section and
    nothing is cut off; a reader orders a section by what its objects hold.
    """
    parts: list[Column] = []
    for i, f in enumerate(df.schema):
        parts += [F.lit(("{" if i == 0 else ",") + json.dumps(f.name) + ":"), _json_value(F.col(f"`{f.name}`"), f.dataType)]
    key = F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit("")) if key_col else F.lit("")
    return df.select(F.lit(section).alias("section"), key.alias("key"), F.concat(*parts, F.lit("}")).alias("json"))
