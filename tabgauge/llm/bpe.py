"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Each task splits its documents into pre-tokens and gathers blocks of about ``BLOCK_CHARS`` characters. A block holds its distinct words once
   and, for each position of each document, the number of the word there.
2. The blocks' words are dealt out by their hash, so equal words of all blocks meet in one task, which encodes each distinct word once.
3. The words' ids are joined back to the blocks that asked, and every document is put together by position.

Words, positions and ids travel as compressed arrays. A word asks once for each block however often it occurs, so the commonest word is no hot
key; a document stays in its block, and blocks are bounded by characters (a document longer than that is a block of its own).
Block numbers come from task numbers; the words and the positions of a block leave the same shuffle, so they always agree.

Decoding joins ids with the table of token bytes. As the vocabulary fixes the table's size and its key is the place in it, the table goes to all tasks as one array and each id meets its
row by place: a map-side join, in which a document's tokens stay together and in order, where a join of one row for each token would shuffle several times the text. No Python runs there.

Defined cases: null and empty texts have no ids and decode to no bytes; a null id or repeated rows are encoded like others; special tokens are ordinary
text; a text of any length is encoded whole, in a block of its own; other columns are not read; an empty table gives no rows. Ids that the table lacks raise an error in decoding, and
a column that has the name of its result is replaced.
"""

from __future__ import annotations

import base64
import pickle
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabgauge.llm.common import fresh, tasks_for

BLOCK_CHARS = 6_000_000
LEAST_BUCKETS, MOST_BUCKETS = 256, 1 << 16
#: Stand for an absent token and between tokens; no bytes' characters.
_ABSENT, _APART = "\u0100", "\u0101"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a line each, base64 of the bytes, then the id."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


def _pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays in the narrowest type that holds their numbers, and bytes, compressed."""
    out = []
    for x in parts:
        if not isinstance(x, bytes):
            kind = np.dtype(np.min_scalar_type(int(x.max()))) if len(x) else np.dtype(np.uint8)
            x = x.astype(kind).tobytes()
            out.append(b"%c" % kind.itemsize)
        else:
            out.append(b"\0")
        out += [len(x).to_bytes(8, "little"), x]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpack(blob: bytes) -> list:
    held, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(held):
        width, n = held[at], int.from_bytes(held[at + 1 : at + 9], "little")
        at += 9
        out.append(held[at : at + n] if width == 0 else np.frombuffer(held, f"<u{width}", n // width, at))
        at += n
    return out


_SHORT = 240


def _spread(codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Small numbers as a byte; of others the upper part as a byte above _SHORT, and two lower bytes apart."""
    over = codes >= _SHORT
    rest = codes[over] - _SHORT
    if len(rest) and int(rest.max()) >= (256 - _SHORT) << 16:
        return (codes,)
    lead = codes.copy()
    lead[over] = _SHORT + (rest >> 16)
    return lead, rest & 255, rest >> 8 & 255


def _gathered(parts: list[np.ndarray]) -> np.ndarray:
    if len(parts) == 1:
        return parts[0].astype(np.uint32)
    codes = parts[0].astype(np.uint32)
    over = codes >= _SHORT
    codes[over] = ((codes[over] - _SHORT) << 16) + (parts[2].astype(np.uint32) << 8) + parts[1] + _SHORT
    return codes


class Block:
    """Distinct words and positions of some documents."""

    def __init__(self) -> None:
        self.ids: list = []
        self.number: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id, text: str, find) -> None:
        number = self.number
        self.ids.append(doc_id)
        self.codes.append(np.array([number.setdefault(w, len(number)) for w in find(text)], np.uint32))
        self.chars += len(text) + 1

    def packed(self, buckets: int) -> tuple[bytes, bytes]:
        """Positions with the buckets of the words, and the words by bucket."""
        words = [w.encode("utf-8", "replace") for w in self.number]
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words))
        words = [words[i] for i in order]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.uint16, len(words))
        lengths = np.fromiter(map(len, self.codes), np.uint32, len(self.codes))
        positions = _pack(pickle.dumps(self.ids), lengths, bucket, *_spread(rank[codes]))
        by_bucket = np.argsort(bucket, kind="stable")
        held = [words[i] for i in by_bucket]
        return positions, _pack(np.bincount(bucket, minlength=buckets), np.fromiter(map(len, held), np.uint32, len(held)), b"".join(held))


def encode(docs: DataFrame, ranks: dict[bytes, int] | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text",
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: ``id_col`` and ids, an array of int, as the vocabulary's merges give them for each match of ``pattern``."""
    if ranks is None:
        ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    source = docs.select(id_col, text_col)
    id_type, id_arrow = source.schema[0].dataType.simpleString(), to_arrow_type(source.schema[0].dataType)
    n = tasks_for(source)
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 2 * n))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        task, done, block = TaskContext.get().partitionId(), 0, Block()

        def row() -> pa.RecordBatch:
            positions, words = block.packed(buckets)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | done]), pa.array([positions], pa.binary()), pa.array([words], pa.binary())], names=["block", "positions", "words"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                if block.ids and block.chars + len(text) > block_chars:
                    yield row()
                    done, block = done + 1, Block()
                block.add(doc_id.as_py(), text, find)
        if block.ids:
            yield row()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("words")):
                counts, lengths, data = _unpack(blob.as_py())
                full, last = np.flatnonzero(counts), np.cumsum(counts, dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                own = [_pack(lengths[last[b] - counts[b] : last[b]], data[ends[last[b] - counts[b]] : ends[last[b]]]) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([block] * len(full), pa.int64()), pa.array(own, pa.binary())], names=["bucket", "block", "words"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        now, known = -1, {}
        for batch in batches:
            out = []
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("words")):
                if bucket != now:
                    now, known = bucket, {}
                lengths, data = _unpack(blob.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                ids = []
                for a, b in zip((ends - lengths).tolist(), ends.tolist()):
                    word = data[a:b]
                    got = known.get(word)
                    if got is None:
                        got = known[word] = np.array(piece(word), np.uint32).tobytes()
                    ids.append(got)
                counts = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                out.append(_pack(counts, np.frombuffer(b"".join(ids), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "ids"])

    def assemble(asked: pa.Table, given: pa.Table) -> pa.Table:
        doc_ids, lengths, bucket, *codes = _unpack(asked.column("positions")[0].as_py())
        codes = _gathered(codes)
        counts, flat = np.zeros(len(bucket), np.int64), np.zeros(0, np.uint32)
        order = np.argsort(bucket, kind="stable")  # words as they were dealt: by bucket, then by number
        parts = [_unpack(blob) for _, blob in sorted(zip(given.column("bucket").to_pylist(), given.column("ids").to_pylist()))]
        if parts:
            counts[order] = np.concatenate([c for c, _ in parts])
            flat = np.concatenate([i for _, i in parts])
        starts = np.empty(len(bucket), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        chunks, step = [np.zeros(0, np.int32)], 1 << 18
        before = np.zeros(len(codes) + 1, np.int64)  # ids before each position
        for k in range(0, len(codes), step):
            c = codes[k : k + step]
            size = counts[c]
            before[k + 1 : k + 1 + len(c)] = before[k] + np.cumsum(size)
            first = np.repeat(starts[c] - (np.cumsum(size) - size), size)
            chunks.append(flat[first + np.arange(len(first))].astype(np.int32))
        ends = before[np.cumsum(lengths, dtype=np.int64)]
        ids = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int64()), pa.array(np.concatenate(chunks))).cast(pa.list_(pa.int32()))
        return pa.table({id_col: pa.array(pickle.loads(doc_ids), id_arrow), "ids": ids})

    blocks = source.mapInArrow(split, "block bigint, positions binary, words binary").repartition(n, "block")
    words = blocks.mapInArrow(deal, "bucket int, block bigint, words binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    given = words.mapInArrow(merge, "block bigint, bucket int, ids binary")
    return blocks.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(assemble, f"`{id_col}` {id_type}, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int] | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for, as ``out_col``."""
    if ranks is None:
        ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    by_id: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        by_id[i] = token.decode("latin-1")  # a character for each byte
    (text_col,) = fresh([*encoded.columns, out_col], "joined")
    table = F.split(F.lit(_APART.join(_ABSENT if x is None else x for x in by_id)), _APART)  # a constant, folded into an array that tasks hold once
    tokens = F.transform(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda i: F.get(table, i))
    joined = encoded.select(*encoded.columns, F.array_join(tokens, "", _ABSENT).alias(text_col))
    text, others = F.col(text_col), [c for c in encoded.columns if c != out_col]
    return joined.select(*others, F.when(F.contains(text, F.lit(_ABSENT)), F.raise_error(F.lit("KeyError: an id that the token table lacks"))).otherwise(F.encode(text, "ISO-8859-1")).alias(out_col))
