"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

All steps are DataFrame expressions. A text meets the full hash only if another text has
its length and its prefix hash. Only fixed-width keys are shuffled, never texts. The keys that survive the prefix step meet the texts by a
broadcast; if they are more than ``broadcast_rows``, the lengths do instead, and if those are more too, every text is hashed in full where it is read.

Defined cases
-------------
* a null text equals the empty text; texts are compared as they are, without normalisation;
* of equal texts the row with the largest id stays; a null id is smaller than any id;
* rows that repeat both id and text: exactly one of them stays (``kept``), all are returned; rows of one id with different texts are rows of their own;
* texts of any length are compared whole, by their SHA-256; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgauge.llm.common import BROADCAST_ROWS, cut, drop_rows, small, text_hash

PREFIX_CHARS = 128


def refine(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Mapping[str, Column] | None = None,
    prefix_chars: int = PREFIX_CHARS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per input row: ``id_col``, the ``carry`` expressions, keep_id, group_size, kept.

    ``carry`` holds further expressions over the columns of ``docs``, evaluated in the same scan.
    """
    carry = dict(carry or {})
    text = F.coalesce(F.col(text_col), F.lit(""))
    scan = docs.select(
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        F.octet_length(text).alias("_len"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_prefix"),
        *[e.alias(f"_c{i}") for i, e in enumerate(carry.values())],
    )
    more_than_one = F.col("count") > 1
    lengths = cut(scan.groupBy("_len").count().where(more_than_one).select("_len"))
    # Counted before the join, so that many copies of one text meet its length as one row.
    prefixes = scan.groupBy("_len", "_prefix").count().join(lengths, "_len", "left_semi").where(more_than_one).select("_len", "_prefix")
    prefixes = cut(prefixes)
    hit, by = F.lit(True), None
    for survivors in (prefixes, lengths):  # no text is shuffled: what is too long to be broadcast isn't asked
        if survivors.limit(broadcast_rows + 1).count() <= broadcast_rows:
            hit, by = F.col("_hit"), survivors.withColumn("_hit", F.lit(True))
            break
    met = scan if by is None else scan.join(F.broadcast(by), [c for c in by.columns if c != "_hit"], "left")  # counted above
    marked = met.select(
        "_id", "_len", "_prefix",
        F.when(hit, F.sha2("_text", 256)).alias("_full"),
        F.monotonically_increasing_id().alias("_row"),
        *[f"_c{i}" for i in range(len(carry))],
    )
    marked = cut(marked)  # row numbers are fixed here
    groups = cut(  # written, so that a join with a very large group can be split
        marked.where(F.col("_full").isNotNull())
        .groupBy("_len", "_prefix", "_full")
        .agg(F.max(F.struct("_id", "_row")).alias("_top"), F.count(F.lit(1)).alias("_size"))
        .where("_size > 1")
    )
    joined = marked.join(groups, ["_len", "_prefix", "_full"], "left")
    return joined.select(
        F.col("_id").alias(id_col),
        *[F.col(f"_c{i}").alias(name) for i, name in enumerate(carry)],
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_top._id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_top._row") == F.col("_row"), F.lit(True)).alias("kept"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns kept.

    Rows are known by id and text hash, a null text as the empty one. Where dropped rows repeat both of the row that stays, one of them all stays.
    Up to ``broadcast_rows`` dropped rows are broadcast; beyond that ``docs`` is dealt out once by these keys (see ``drop_rows``).
    """
    found = refine(docs, id_col, text_col, {"_key": text_hash(text_col)}, broadcast_rows=broadcast_rows).where(~F.col("kept"))
    again = F.max(F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("again")
    gone = cut(found.groupBy(F.col(id_col).alias("id"), F.col("_key").alias("h")).agg(again))
    return drop_rows(docs, gone, id_col, text_col, broadcast_rows)
