"""Parquet table reader: a plain scan, so that filters and projections reach
Parquet.  A known ``schema`` skips schema inference (a footer-reading job per
read)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
