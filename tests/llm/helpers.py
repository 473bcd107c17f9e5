"""Fixtures of the corpus operators' tests."""

import os
import random

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns that operators use inside, as extra columns of their input.
CLASHES = ("_id", "_text", "_len", "_key", "kept", "keep_id", "fp", "score", "ids", "size", "shard", "entities", "block", "_gone_id", "_gone_key", "_gone_h", "decoded", "h", "again", "id", "root")


def docs(spark, rows, parts=3):
    """A table of (doc_id, text) with columns of clashing names."""
    kind = T.StructType([*DOCS.fields[:2], *(T.StructField(c, T.StringType()) for c in CLASHES)])
    return spark.createDataFrame([(i, t, *(f"{c}-{i}" for c in CLASHES)) for i, t in rows], kind).repartition(parts)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


#: Nulls, empty and very long texts, ties and repeated rows.
ODD = [
    (1, None), (2, ""), (3, "a"), (4, "a"), (None, "b"), (5, "b"), (6, " \t\n"), (7, "é" * 70), (8, "é" * 70), (8, "é" * 70),
    (9, words(60_000, 1)), (10, words(60_000, 1)), (11, words(60_000, 2)), (12, "\x00 ퟿ 𝔘𝔫𝔦  "), (13, "MiXed Case"), (14, "mixed case"), (None, None),
]


def table(sf, name):
    import duckdb

    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet'").fetchall()


def have_data():
    return os.path.isdir(SF)
