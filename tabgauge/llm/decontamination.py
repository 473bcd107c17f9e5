"""Benchmark passages in documents by spaced-seed hashing.

Tokens are runs of letters and digits (any byte from 128 on counts as a letter) of the lower-cased text. A mask picks some of ``SPAN``
successive tokens and ignores the rest; the hashes of the picked tokens of benchmark and documents are joined. A hit lines up a document
and an item. On that diagonal, the pair overlaps if any stretch of at least ``MIN_TOKENS`` tokens (or the whole item, if shorter) has
``IDENTITY`` of its tokens equal, so substituted tokens are tolerated. Every such stretch of items of ``SPAN`` tokens and more is hit by a mask.

1. The benchmark's hashes are made in tasks and written, a row for each hash and item with the places. Three bits of each hash go into a filter, whose size is bounded by a parameter.
2. One pass over the documents hashes all their places. Those that the filter lets through are kept, with the tokens of the few documents that have any. A full filter lets more
   through but loses nothing, so a benchmark of any size takes one pass.
3. Hashes are joined, and pairs of a document and an item are verified one by one; equal places of repeated tokens are laid over each other as runs, so they take time and memory in
   proportion to the texts. A passage that many documents share meets the benchmark's few rows in a broadcast, or, if they are many, in a join that is split at hot keys.

Defined cases: null and empty texts have no tokens and match nothing; items of fewer than ``MIN_ITEM`` tokens match nothing; items shorter
than the masks match where all their tokens occur in a row; equal items are each reported; repeated documents are each reported; a
null item id is reported as null; documents of any length are hashed whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.llm.common import BROADCAST_ROWS, cut, drop_rows, pieces, text_hash
from tabgauge.llm.features import pack, words

#: Fixed masks of eight tokens and more; 1: the token counts. The first ones pass every fifth to every eighth token substituted and runs of eight
#: equal tokens, the others irregular substitutions. Together they hit every stretch of 12 tokens and more of which 0.8 are equal: one of 26 and more splits
#: into such stretches, and up to 25 all places of the substituted tokens were tried.
MASKS = ("111101111", "111110111", "111111011", "111111101", "11111111", "110110110111", "111010011011", "101101110101", "1100101011", "1010001111", "111111")
SPAN = 12
MIN_TOKENS = 13
MIN_ITEM = 5
IDENTITY = 0.8
#: Tokens of the benchmark up to which the filter grows with it: 2**28 bits at most.
SLICE_TOKENS = 100_000
BITS_PER_HASH, LEAST_BITS, MOST_BITS = 256, 16, 28
#: Bytes of the benchmark's rows up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
_APART = np.array([not (c >= 128 or 48 <= c <= 57 or 97 <= c <= 122) for c in range(256)])


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens in one array, and the text of each."""
    packed = pack([(t or "").lower().encode("utf-8", "replace") for t in texts])
    first, _, hashed = words(packed, _APART)
    return hashed, np.searchsorted(packed.start, first, "right") - 1


#: All masks by number: the fixed ones, and for items that are shorter one over all their tokens.
ALL_MASKS = (*MASKS, *("1" * n for n in range(MIN_ITEM, SPAN)))


def masks_of(tokens_: int) -> range:
    """Numbers of the masks for an item of so many tokens."""
    if tokens_ < MIN_ITEM:
        return range(0)
    return range(len(MASKS)) if tokens_ >= SPAN else range(len(MASKS) + tokens_ - MIN_ITEM, len(MASKS) + tokens_ - MIN_ITEM + 1)


def seed_hashes(hashed: np.ndarray, number: int) -> np.ndarray:
    """The hash of a mask at each place where it fits."""
    mask = ALL_MASKS[number]
    n = len(hashed) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number + 1, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ hashed[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return out


#: Where the three bits of a hash start.
_SHIFTS = (0, 18, 36)


class Filter:
    """Bits of hashes; ``passing`` gives the places of those that may be among them."""

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.mask = table, np.uint64((1 << bits) - 1)

    def passing(self, h: np.ndarray) -> np.ndarray:
        at = np.arange(len(h))
        for shift in _SHIFTS:
            p = h[at] >> np.uint64(shift) & self.mask
            at = at[(self.table[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        return at


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, id, tokens) of the benchmark's rows and (mask, hash, item, places) of their hashes, both written."""
    numbered = cut(benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).withColumn("item", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            hashed, owner = tokens(batch.column(1).to_pylist())
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            out = [hashed[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(out, pa.binary())], names=["item", "id", "tokens"])

    items = cut(numbered.mapInArrow(run, f"item bigint, id {benchmark.schema[id_col].dataType.simpleString()}, tokens binary"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "tokens", 1 << 20):
            out = [(np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64), [])]
            for item, blob in zip(batch.column("item").to_pylist(), batch.column("tokens").to_pylist()):
                own = np.frombuffer(blob, np.uint64)
                for number in masks_of(len(own)):
                    found, places = _by_hash(seed_hashes(own, number), np.arange(len(own)))
                    out.append((np.full(len(found), number, np.int32), found, np.full(len(found), item), places))
            mask, hashes, item, places = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(mask)), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(item)), pa.array([x for own in places for x in own], pa.binary())],
                names=["mask", "hash", "item", "places"])

    return items, cut(items.select("item", "tokens").mapInArrow(seeds, "mask int, hash bigint, item bigint, places binary"))


def _by_hash(h: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Distinct hashes and for each the places, as 32-bit numbers."""
    order = np.argsort(h, kind="stable")
    found, first = np.unique(h[order], return_index=True)
    sorted_ = places[: len(h)][order].astype(np.uint32)
    return found, [x.tobytes() for x in np.split(sorted_, first[1:])] if len(found) else []


def _filter(seeds: DataFrame, most_tokens: int) -> tuple[np.ndarray, int]:
    """The filter's bytes, 2**bits bits; the words that reach the driver are at most 2**bits / 64."""
    n = min(seeds.count(), most_tokens * len(MASKS))
    bits = min(MOST_BITS, max(LEAST_BITS, (n * BITS_PER_HASH).bit_length()))
    places = F.explode(F.array(*[F.shiftrightunsigned("hash", s).bitwiseAND(F.lit((1 << bits) - 1)) for s in _SHIFTS])).alias("p")
    word, bit = F.shiftrightunsigned("p", 6).alias("word"), F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("held")
    rows = seeds.select(places).groupBy(word).agg(bit).toArrow()
    table = np.zeros(1 << bits - 6, np.uint64)
    table[rows.column("word").to_numpy()] = rows.column("held").to_numpy().view(np.uint64)
    return table.view(np.uint8), bits


def diagonals(doc_tokens: int, item_tokens: int, positions: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
    """Distinct places of the item's start in the document, of pairs of equal hashes; negative ones reach out of it."""
    marked = np.zeros(doc_tokens + item_tokens, bool)
    runs = lambda x: np.split(x, np.flatnonzero(np.diff(x) != 1) + 1)
    for p, q in zip(positions, places):
        a, b = runs(p), runs(q)
        if len(a) * len(b) < min(len(p), len(q)) + 16:
            for x in a:
                for y in b:
                    marked[x[0] - y[-1] + item_tokens : x[-1] - y[0] + item_tokens + 1] = True
        else:
            few, sign = (q, -1) if len(q) <= len(p) else (p, 1)
            many = p if few is q else -q
            for y in few:
                marked[many + sign * y + item_tokens] = True
    return np.flatnonzero(marked) - item_tokens


def overlap(doc: np.ndarray, item: np.ndarray, start: int) -> tuple[int, int, int] | None:
    """(first token in the document, tokens, equal tokens) of the best dense stretch with ``item`` laid at ``start``.

    An equal token adds 1 and another one takes 4, so a stretch has IDENTITY of its tokens equal if its sum isn't negative. The whole item is taken
    if it is, else the stretch of highest sum if it is long enough, else the longest one.
    """
    a, b = max(0, start), min(len(doc), start + len(item))
    equal = doc[a:b] == item[a - start : b - start]
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -4))])
    least = min(MIN_TOKENS, len(item))
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    first = int(total[: end + 1].argmin())
    # whole items are held to the share of equal tokens alone
    if b - a == len(item) and total[-1] >= 0:
        first, end = 0, b - a
    elif end - first < least:
        starts = np.searchsorted(-low, -total)  # for each end the first place that isn't higher
        end = int((np.arange(len(total)) - starts).argmax())
        first = int(starts[end])
    n = end - first
    return (a + first, n, int(equal[first:end].sum())) if n and n >= least else None


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, slice_tokens: int) -> DataFrame:
    """(id, h, n, item id, first_token, n_tokens, n_equal) of each row and item that overlap; n numbers the rows with hits."""
    items, seeds = _items(benchmark, item_col, item_text_col)
    numbers = sorted(r["mask"] for r in seeds.select("mask").distinct().collect())  # of the masks, a fixed few
    table, bits = _filter(seeds, slice_tokens)
    held = docs.sparkSession.sparkContext.broadcast(table.tobytes())
    source = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("h"), F.col(text_col).alias("text"))
    kind, item_kind = source.schema["id"].dataType.simpleString(), items.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, task, done = Filter(np.frombuffer(held.value, np.uint8), bits), TaskContext.get().partitionId() << 33, 0
        for batch in pieces(batches, "text", 1 << 20):
            hashed, owner = tokens(batch.column(2).to_pylist())
            at, h = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for number in numbers:
                every = seed_hashes(hashed, number)
                some = filter_.passing(every)
                some = some[owner[some] == owner[some + len(ALL_MASKS[number]) - 1]]
                at.append(some)
                h.append(every[some])
            at, h = np.concatenate(at), np.concatenate(h)
            if not len(at):
                continue
            order = np.argsort(owner[at], kind="stable")
            at, h = at[order], h[order]
            rows, first = np.unique(owner[at], return_index=True)
            start = np.searchsorted(owner, rows)
            end = np.searchsorted(owner, rows, "right")
            ends = np.append(first[1:], len(at))
            yield pa.RecordBatch.from_arrays([
                pa.array(task + done + np.arange(len(rows))), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                pa.array([hashed[a:b].tobytes() for a, b in zip(start, end)], pa.binary()), pa.array([h[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                pa.array([(at[a:b] - s).astype(np.uint32).tobytes() for a, b, s in zip(first, ends, start)], pa.binary())], names=["n", "id", "h", "tokens", "hashes", "at"])
            done += len(rows)

    rows = cut(source.mapInArrow(scan, f"n bigint, id {kind}, h bigint, tokens binary, hashes binary, at binary"))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "at", 1 << 20):
            out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), [])]
            for n, h, at in zip(*(batch.column(c).to_pylist() for c in ("n", "hashes", "at"))):
                found, places = _by_hash(np.frombuffer(h, np.uint64), np.frombuffer(at, np.uint32))
                out.append((np.full(len(found), n), found, places))
            n, hashes, places = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(n)), pa.array(np.concatenate(hashes).view(np.int64)), pa.array([x for own in places for x in own], pa.binary())], names=["n", "hash", "positions"])

    def bounded(df: DataFrame, column: str) -> DataFrame:
        count, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column) + 40), F.lit(0))).first()
        return F.broadcast(df) if count <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df

    met = rows.select("n", "hashes", "at").mapInArrow(hits, "n bigint, hash bigint, positions binary").join(bounded(seeds.drop("mask"), "places"), "hash")
    pairs = met.groupBy("n", "item").agg(F.collect_list("positions").alias("positions"), F.collect_list("places").alias("places"))  # at most a row for each hash of the item
    whole = rows.select("n", "id", "h", "tokens").join(pairs, "n").join(bounded(items.select("item", F.col("id").alias("item_id"), F.col("tokens").alias("item_tokens")), "item_tokens"), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n", "id", "h", "item_id", "first_token", "n_tokens", "n_equal"]
        for batch in batches:
            keep, out = [], []
            for i in range(batch.num_rows):
                doc, item = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("tokens", "item_tokens"))
                positions, places = ([np.frombuffer(x, np.uint32).astype(np.int64) for x in batch.column(c)[i].as_py()] for c in ("positions", "places"))
                best = (0, 0, 0)
                for start in diagonals(len(doc), len(item), positions, places).tolist():
                    found = overlap(doc, item, start)
                    if found and found[1:] > best[1:]:
                        best = found
                if best[1]:
                    keep.append(i)
                    out.append(best)
            if keep:
                some = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names[:4]), *(pa.array([x[k] for x in out], pa.int32()) for k in range(3))], names=names)

    return whole.mapInArrow(verify, f"n bigint, id {kind}, h bigint, item_id {item_kind}, first_token int, n_tokens int, n_equal int")


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """One row per document and item that overlap: ids, first_token, n_tokens, n_equal."""
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, slice_tokens)
    return found.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "first_token", "n_tokens", "n_equal")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                      slice_tokens: int = SLICE_TOKENS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, all columns."""
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, slice_tokens)
    gone = cut(found.select("id", "h").distinct().withColumn("again", F.lit(False)))
    return drop_rows(docs, gone, id_col, text_col, broadcast_rows)
