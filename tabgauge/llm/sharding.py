"""Shards of near-equal bytes by sampled splitters.

1. One scan gives (id, size, crc, key, tie) per row, ``key`` a hash of the text and ``tie`` a hash of the id; it is written once.
2. Keys are sampled with a chance in proportion to size / total size + 1 / rows. The sample is put in order by a range partitioning of its own (on the driver up to ``SAMPLE_ROWS``) and its quantiles are the splitters
   of fine ranges, ``ranges_per_shard`` to a shard; only splitters reach the driver, as arrays. Ranges that hold over twice their share are sampled again and subdivided.
3. Splitters fall between groups of equal texts, so a group stays in one shard. Heavy groups (over a hundredth of a shard)
   are ranges of their own, subdivided by ``tie``; only a group that is larger than a whole shard is spread over several.
4. The driver places ranges (a number bounded by parameters, some 50 bytes each): heavy groups by decreasing size into the emptiest shard, then
   light ranges in key order, each shard up to its equal share of the bytes. A row's slot is its range's offset in the
   shard plus its number in the range, so no task sorts more than a fine range.

Defined cases: size is UTF-8 bytes of the text (null: none) plus 1; a null and an empty text are equal; rows repeated with id and
text are kept and get slots of their own; null ids sort first; an empty table gives no rows; other columns are not read. With fewer
rows than shards some shards are empty. Rows equal in both text and id can't be told apart and share a range. Texts of any length are hashed and measured whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabgauge.llm.common import cut, small

LOW = -(2**63)
RANGES_PER_SHARD = 128
SAMPLES_PER_RANGE = 24


#: Rows of a sample, two numbers each, that the driver or one task puts in order.
SAMPLE_ROWS = 500_000


def _range_of(keys: np.ndarray, ties: np.ndarray):
    """A column function: the number of splitters that are at or below (key, tie)."""

    @F.pandas_udf("int")
    def number(key: pd.Series, tie: pd.Series) -> pd.Series:
        k = key.to_numpy()
        first, last = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = first.copy()
        for at in np.unique(first[last > first]):
            rows = (first == at) & (last > first)
            end = last[rows][0]
            out[rows] = at + np.searchsorted(ties[at:end], tie.to_numpy()[rows], "right")
        return pd.Series(out.astype(np.int32))

    return number


def _merged(*parts: tuple[np.ndarray, np.ndarray], heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Splitters (key, tie) in order, each once; those of light keys are moved to the start of the key's group."""
    keys, ties = np.concatenate([k for k, _ in parts]), np.concatenate([t for _, t in parts])
    ties = np.where(np.isin(keys, heavy), ties, LOW)
    order = np.lexsort((ties, keys))
    keys, ties = keys[order], ties[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ties[1:] != ties[:-1])
    return keys[new], ties[new]


def _quantiles(sample: DataFrame, rows: float, shares: list[tuple[int, int]], sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of each range of ``sample`` (_range, _key, _tie), as many quantiles as ``shares`` (range, share) says, less one. ``rows`` is about the sample's size."""
    tasks = int(rows // sample_rows) + 1
    if tasks == 1:
        found = sample.toArrow()
        own, keys, ties = (found.column(c).to_numpy() for c in ("_range", "_key", "_tie"))
        order = np.lexsort((ties, keys, own))
        own, keys, ties = own[order], keys[order], ties[order]
        numbers, share = (np.array(x, np.int64) for x in zip(*sorted(shares)))
        first, n = np.searchsorted(own, numbers), np.searchsorted(own, numbers, "right") - np.searchsorted(own, numbers)
        i = np.arange(len(own)) - np.repeat(first, n)
        share, n = np.repeat(share, n), np.repeat(n, n)
        chosen = (i > 0) & (i * share // n > (i - 1) * share // n)
        return keys[chosen], ties[chosen]
    inner = (1 << 33) - 1
    held = cut(sample.repartitionByRange(tasks, "_key", "_tie").sortWithinPartitions("_key", "_tie").withColumn("_m", F.monotonically_increasing_id()))
    task, at = F.shiftright("_m", 33).alias("_task"), F.col("_m").bitwiseAND(F.lit(inner))
    counts = sorted((r["_task"], r["n"]) for r in held.groupBy(task).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each task
    offsets, before = [], 0
    for t, n in counts:
        offsets.append((t, before))
        before += n
    placed = held.select("*", task).join(F.broadcast(sample.sparkSession.createDataFrame(offsets, "_task long, _before long")), "_task").withColumn("_g", F.col("_before") + at)
    ranges = placed.groupBy("_range").agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_n")).join(sample.sparkSession.createDataFrame(shares, "_range int, share int"), "_range")
    i = F.col("_g") - F.col("_first")
    step = lambda x: F.floor(x * F.col("share") / F.col("_n"))
    found = placed.join(small(cut(ranges)), "_range").where((i > 0) & (step(i) > step(i - 1))).select("_key", "_tie").toArrow()
    return found.column("_key").to_numpy(), found.column("_tie").to_numpy()


def place(size: np.ndarray, key: np.ndarray, heavy: np.ndarray, n_shards: int) -> np.ndarray:
    """A shard for each range. size: bytes of the ranges, in key order; key: of pieces of heavy groups the key, where ``heavy`` says so."""
    shard = np.zeros(len(size), np.int64)
    share = size.sum() / n_shards
    load = np.zeros(n_shards)
    groups: dict[int, list[int]] = {}
    for i in np.flatnonzero(heavy).tolist():
        groups.setdefault(int(key[i]), []).append(i)
    items: list[list[int]] = []
    for pieces in groups.values():  # a group beyond a shard's share goes piece by piece
        items += [pieces] if size[pieces].sum() <= share else [[p] for p in pieces]
    for item in sorted(items, key=lambda x: -size[x].sum()):
        at = int(load.argmin())
        shard[item] = at
        load[at] += size[item].sum()
    light = np.flatnonzero(~heavy)
    room = np.maximum(0.0, share - load)
    ends = np.cumsum(room * (size[light].sum() / max(1.0, room.sum())))
    done = np.cumsum(size[light]) - size[light]
    shard[light] = np.minimum(n_shards - 1, np.searchsorted(ends, done + size[light] / 2))
    return shard


def shard_by_bytes(
    docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
    ranges_per_shard: int = RANGES_PER_SHARD, samples_per_range: int = SAMPLES_PER_RANGE, seed: int = 7, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = cut(docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text).cast("long") + 1).alias("_size"),
        F.crc32(text).alias("_crc"),
        F.xxhash64(text).alias("_key"),
        F.xxhash64(F.col(id_col), F.lit(seed)).alias("_tie"),
    ))
    n = n_shards * ranges_per_shard
    total = base.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
    bytes_all, rows_all = int(total[0]), max(1, int(total[1]))
    # At most 100 * n_shards groups hold over a hundredth of a shard's bytes or rows each, so they fit the driver.
    heavy = {
        r["_key"]: r["b"]
        for r in base.groupBy("_key").agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n"))
        .where((F.col("b") * (100 * n_shards) > bytes_all) | ((F.col("n") * (100 * n_shards) > rows_all) & (F.col("n") > 1))).collect()
    }
    heavy_keys = np.array(sorted(heavy), np.int64)
    weight = F.col("_size") / float(max(1, bytes_all)) + 1.0 / rows_all
    spark = docs.sparkSession

    def quantiles(of: DataFrame, times: float, shares: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Of a sample of about 2 * times * n * samples_per_range keys at most, as the weights of all rows add up to 2."""
        some = of.where(F.rand(seed) < weight * (times * n * samples_per_range)).select("_range", "_key", "_tie")
        return _quantiles(some, 2 * times * n * samples_per_range, shares, sample_rows)

    def counted(by: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, dict[str, np.ndarray]]:
        """Rows with their range, and the ranges in key order."""
        rows = base.withColumn("_range", _range_of(*by)("_key", "_tie"))
        found = rows.groupBy("_range").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).orderBy("_range").toArrow()
        held = {c: found.column(c).to_numpy() for c in found.column_names}
        return rows, held | {"heavy": (held["lo"] == held["hi"]) & np.isin(held["lo"], heavy_keys)}

    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    above = heavy_keys[heavy_keys < 2**63 - 1] + 1
    apart = (np.concatenate([heavy_keys, above]), np.full(len(heavy_keys) + len(above), LOW))  # heavy keys stand apart
    splitters = _merged(quantiles(base.withColumn("_range", F.lit(0)), 1, [(0, n)]) if bytes_all else nothing, apart, heavy=heavy_keys)
    for _ in range(3):
        held, ranges = counted(splitters)
        weigh = ranges["bytes"] / max(1, bytes_all) + ranges["rows"] / rows_all
        full = (weigh > 4 / n) & ((ranges["lo"] != ranges["hi"]) | ranges["heavy"])
        if not full.any():
            break
        shares = [(int(r), int(w / 2 * n) + 1) for r, w in zip(ranges["_range"][full], weigh[full])]
        known = small(spark.createDataFrame([r for r, _ in shares], "int").toDF("_full"))  # overfull ranges are fewer than n / 2
        more = quantiles(held.join(known, F.col("_range") == F.col("_full"), "left_semi"), 4, shares)
        finer = _merged(splitters, more, heavy=heavy_keys)
        if len(finer[0]) == len(splitters[0]):
            break
        splitters = finer
    held, ranges = counted(splitters)
    shard = place(ranges["bytes"], ranges["lo"], ranges["heavy"], n_shards)
    # The ranges at the shards' ends are subdivided once more, so that the ends fall where they should.
    light = np.flatnonzero(~ranges["heavy"])
    edge = np.flatnonzero(np.diff(shard[light], append=-1) != 0)
    ends = sorted({int(ranges["_range"][light[i]]) for e in edge.tolist() for i in (e, e + 1) if i < len(light)})
    if ends:
        known = small(spark.createDataFrame(ends, "int").toDF("_end"))
        cuts = quantiles(held.join(known, F.col("_range") == F.col("_end"), "left_semi"), 4, [(r, 8 * samples_per_range) for r in ends])
        splitters = _merged(splitters, cuts, heavy=heavy_keys)
    held, ranges = counted(splitters)
    shard = place(ranges["bytes"], ranges["lo"], ranges["heavy"], n_shards)
    offset = np.zeros(len(shard), np.int64)
    order = np.argsort(shard, kind="stable")
    before = np.cumsum(ranges["rows"][order]) - ranges["rows"][order]
    first = np.concatenate([[True], np.diff(shard[order]) != 0])[: len(order)]
    offset[order] = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(order))))
    columns = {"_range": ranges["_range"], "shard": shard.astype(np.int32), "_offset": offset}
    plan = spark.createDataFrame(pa.table(columns), "_range int, shard int, _offset long")
    numbered = held.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy("_key", "_tie", "_id")))
    return numbered.join(small(plan), "_range").select(  # the plan has a row for each fine range
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard",
        (F.col("_offset") + F.col("_n") - 1).cast("long").alias("slot"),
    )
