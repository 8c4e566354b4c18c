"""A log of numbered JSON entries in a shared folder, one file each.

An entry is made by creating its file exclusively: of several writers that try for
a number, one succeeds and the others read again. The text is written under a
temporary name first, so a reader sees a whole entry or none.

On a local path the exclusive step is a hard link, on others Hadoop's rename,
which does not replace a file (on HDFS; an object store needs a file system
that keeps this promise).
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def join_path(base: str, *names: str) -> str:
    return "/".join([base.rstrip("/"), *names])


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def last(self) -> int:
        """The highest number, or -1."""
        try:
            found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(self.path).select(F.max("path")).first()[0]
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return -1
        return -1 if found is None else int(os.path.basename(found).partition(".")[0])

    def read(self, first: int, last: int) -> list[dict]:
        """The entries from ``first`` to ``last``, in order."""
        if last < first:
            return []
        paths = [join_path(self.path, self._name(n)) for n in range(first, last + 1)]
        rows = self.spark.read.option("wholetext", True).text(paths).select("_metadata.file_name", "value").collect()
        return [json.loads(r["value"]) for r in sorted(rows, key=lambda r: r["file_name"])]

    def create(self, number: int, entry: dict) -> bool:
        """Make entry ``number``; False if there is one already."""
        text, name, temporary = json.dumps(entry), self._name(number), f".{uuid.uuid4().hex}.tmp"
        local = re.fullmatch(r"(?:file:/+)?(?!\w+:)(.*)", self.path)
        if local:
            folder = local[1] if not self.path.startswith("file:") else "/" + local[1]
            os.makedirs(folder, exist_ok=True)
            written = os.path.join(folder, temporary)
            with open(written, "x") as f:
                f.write(text)
            try:
                os.link(written, os.path.join(folder, name))
            except FileExistsError:
                return False
            finally:
                os.unlink(written)
            return True
        jvm = self.spark.sparkContext._jvm
        at = lambda n: jvm.org.apache.hadoop.fs.Path(join_path(self.path, n))
        fs = at(name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(at(temporary), False)
        out.write(bytearray(text.encode()))
        out.close()
        done = not fs.exists(at(name)) and fs.rename(at(temporary), at(name))
        if not done:
            fs.delete(at(temporary), False)
        return done

    @staticmethod
    def _name(number: int) -> str:
        return f"{number:012d}.json"
