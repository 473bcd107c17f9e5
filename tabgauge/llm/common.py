"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a table of fixed-width keys is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


#: Rows and bytes of a batch between the JVM and Python, unless the session sets its own; texts are long, so these are below Spark's defaults.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "16777216")}


def small_batches(spark: SparkSession) -> None:
    """Replace Spark's default batch sizes in this session; sizes that were set stay."""
    for name, (default, ours) in BATCH.items():
        if str(spark.conf.get(name, default)).rstrip("b") in (default, "64MB", "64m"):
            spark.conf.set(name, ours)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table for a query, whose batches are small from then on."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take ``spark.checkpoint.dir`` as the shared folder; set one only in local mode, where it is unset."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared checkpoint folder; the table read again, and its path."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def reread(df: DataFrame) -> DataFrame:
    return written(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made and that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tasks_for(df: DataFrame, bytes_each: int = 64 << 20, most: int = 1 << 16) -> int:
    """Partitions for a shuffle of ``df``: the session's number, or more if the plan's statistics say that a partition would exceed ``bytes_each``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n, min(most, size // bytes_each)) if size < 1 << 50 else n  # beyond that nothing is known


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialised table of fixed-width keys for broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fresh(taken: Iterable[str], *stems: str) -> list[str]:
    """The stems as column names that differ from all of ``taken``, whatever the case."""
    held, out = {t.lower() for t in taken}, []
    for stem in stems:
        while stem.lower() in held:
            stem = f"_{stem}"
        held.add(stem.lower())
        out.append(stem)
    return out


def text_hash(text_col: str) -> Column:
    """With the id it tells rows apart; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def drop_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the rows that ``gone`` names, all columns.

    ``gone`` is materialised and has distinct rows (id, h, again): id and ``text_hash`` of rows that go; if ``again``, one of them stays. It is broadcast
    if it has at most ``broadcast_rows`` rows; beyond that ``docs`` is dealt out by id and hash, evenly, and merged with it.
    """
    i, h, own = fresh(docs.columns, "_gone_id", "_gone_h", "_own_h")
    keys = gone.select(F.col("id").alias(i), F.col("h").alias(h), "again")
    same = F.col(id_col).eqNullSafe(F.col(i)) & (text_hash(text_col) == F.col(h))
    left = docs.join(small(keys.drop("again"), broadcast_rows), same, "left_anti")
    twins = keys.where("again").drop("again")
    if twins.isEmpty():
        return left
    back = docs.join(small(twins, broadcast_rows), same, "left_semi").withColumn(own, text_hash(text_col)).dropDuplicates([id_col, own]).drop(own)
    return left.unionByName(back)


def bounded_sample(rows: DataFrame, id_col: str, class_col: str, most: int, seed: int) -> DataFrame:
    """(id, class) of at most ``most`` rows of each class, those whose hashed ids come first; written to the checkpoint folder.

    A threshold on the hash, from the class's count, leaves about three times as many rows to be ranked, whatever the class's size.
    """
    keys = rows.select(id_col, class_col).where(F.col(class_col).isNotNull())
    counts = cut(keys.groupBy(class_col).agg(F.count(F.lit(1)).alias("_n")))
    place = F.xxhash64(id_col, F.lit(seed)).bitwiseAND(F.lit(2**40 - 1))
    near = keys.join(small(counts), class_col).where(place < F.lit(2.0**40 * 3 * most) / F.col("_n"))
    rank = F.row_number().over(Window.partitionBy(class_col).orderBy(place, id_col))
    return cut(near.withColumn("_rank", rank).where(F.col("_rank") <= most).select(id_col, class_col))


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of record batches that hold about ``max_bytes`` of ``column`` each, one row at least."""
    for batch in batches:
        start = held = 0
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
