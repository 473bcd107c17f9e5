"""Tables by path."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def get_df(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> tuple[DataFrame, str]:
    """A CSV table with a header and its name, the last part of the path without its ending. Types are inferred unless ``schema`` is given."""
    found = re.search(r"([^/\\]+?)(?:\.[^./\\]+)?/*$", path)
    if not found:
        raise ValueError(f"no table name in {path!r}")
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path), found[1]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
