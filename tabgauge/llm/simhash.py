"""Near duplicates by SimHash and a Gray-order hierarchical index.

Fingerprints: bit i is set if it is set in over half of the document's shingle hashes (XXH64, seed 42, of the UTF-8 bytes of ``SHINGLE``
successive words joined by single spaces; shingles count as often as they occur; fewer words make one shingle; no word gives 0).

Links are pairs of distinct fingerprints that differ in at most ``LIMIT`` = 4 bits. The 64 bits fall into LIMIT + 1 = 5 blocks; two linked fingerprints agree
on one block at least, so for each block the fingerprints are dealt out by its value. In a task the fingerprints, rotated so that the block
comes first, are sorted by Gray rank, where neighbours share long prefixes and more. Over them stands a tree: a node holds the bits that all below it share (mask and
pattern); what the upper node already holds is factored out of the lower one. Two branches are compared top down; the differences of shared bits add up on
the way and a pair of branches beyond the limit is dropped as a whole. So are branches that are already in one component: a task returns a forest of links, not all pairs.
A block value with more than ``CAP`` fingerprints is dealt out again by the 5 parts of the other bits, so no task holds an unbounded group of different fingerprints.

Equal fingerprints are one node. Components of the links are found by star contraction; the fingerprints are never collected.

Defined cases: null and empty texts and texts of white space have fingerprint 0, linked like any other; null ids are the least of reasons to be a component's id (only
if all its ids are null); repeated rows are each returned; rows of one id with different texts are rows of their own; very long texts are hashed in chunks, whole;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.llm.common import BROADCAST_ROWS, cut, drop_rows, pieces, small, text_hash
from tabgauge.llm.components import connected
from tabgauge.llm.features import mix, pack, words

SHINGLE = 4
SEED = 42
LIMIT = 4
CAP = 50_000
FAN = 8
#: Of near copies that a filter drops beside equal components: words of a shingle, least Jaccard similarity, and bands to find candidates by, each of some least hashes.
#: Two sets of similarity J agree on no band with probability (1 - J**6)**40, whatever the edit: 5e-6 at 0.8. At 0.3 it is 0.97, at 0.08 (a shared passage) 0.99999.
COPY_SHINGLE, COPY_SIMILARITY, COPY_BANDS, COPY_LEAST = 5, 0.8, 40, 6
#: Rounds in which a group's least document is compared with all of its group, documents of a group that one task takes at once, and links that one task settles.
LEADERS, FOLLOWERS, LINKS = 3, 128, 200
#: Rows of the index that one task takes.
INDEX_ROWS = 250_000
_APART = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()  # splits at space, \t, \n, \v, \f, \r
    if not found:
        return 0
    digest, seed = xxhash.xxh64_intdigest, SEED
    whole = b" ".join(found)
    if len(found) <= shingle:
        return digest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(found) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    set_bits, n, step = np.zeros(64, np.int64), len(first), 1 << 14
    for k in range(0, n, step):  # so that a very long text takes little memory
        part = np.fromiter((digest(whole[a:b], seed) for a, b in zip(first[k : k + step], last[k : k + step])), np.uint64, min(step, n - k))
        set_bits += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * set_bits > n).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``id_col`` and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, fp bigint")


def blocks(bits: int, n: int) -> list[tuple[int, int]]:
    """(offset from the top, width) of ``n`` blocks of almost equal width."""
    edges = [round(i * bits / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def rotate(x: np.ndarray, offset: int, bits: int = 64) -> np.ndarray:
    """The low ``bits`` of x rotated left by ``offset``; higher bits stay."""
    if offset == 0:
        return x
    whole = np.uint64(2**bits - 1)
    low = x & whole
    turned = ((low << np.uint64(offset)) & whole) | (low >> np.uint64(bits - offset))
    return turned | (x & ~whole)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of x among all words in Gray order, where neighbours differ in one bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def find(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of each a and b, in place; a label is the smallest member's number."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label[:] = shorter


def index_links(v: np.ndarray, fixed: int, limit: int = LIMIT, chunk: int = 20_000) -> np.ndarray:
    """For each of the distinct words v the number of a member of its component.

    Words link if they differ in at most ``limit`` bits and agree on the ``fixed`` highest ones.
    """
    n = len(v)
    order = np.argsort(gray_rank(v), kind="stable")
    v = v[order]
    top = np.uint64((2**fixed - 1) << (64 - fixed) if fixed else 0)
    label = np.arange(n)
    ands, ors = [v], [v]  # level 0: the words themselves
    while len(ands[-1]) > FAN:
        at = np.arange(0, len(ands[-1]), FAN)
        ands.append(np.bitwise_and.reduceat(ands[-1], at))
        ors.append(np.bitwise_or.reduceat(ors[-1], at))
    masks = [~(o ^ a) for a, o in zip(ands, ors)]
    size = len(ands[-1])
    a, b = np.triu_indices(size)
    # (level, nodes a, nodes b, differences found so far); nodes are numbered within their level, a <= b
    stack = [(len(ands) - 1, a, b, np.zeros(len(a), np.int64), np.zeros(len(a), np.uint64))]
    while stack:
        level, a, b, apart, known = stack.pop()
        if len(a) > chunk:
            stack.append((level, a[chunk:], b[chunk:], apart[chunk:], known[chunk:]))
            a, b, apart, known = a[:chunk], b[:chunk], apart[:chunk], known[:chunk]
        shared = masks[level][a] & masks[level][b]
        new = shared & ~known  # the upper nodes' shared bits are counted already
        differ = (ands[level][a] ^ ands[level][b]) & new
        apart = apart + np.bitwise_count(differ)
        keep = (apart <= limit) & ((differ & top) == 0)
        if level == 0:
            keep &= a != b
            find(label, a[keep], b[keep])
            continue
        width = FAN**level
        a, b, apart, known = a[keep], b[keep], apart[keep], shared[keep]
        if level == 1 and len(a):  # branches that are in one component already need no comparison
            lows = np.minimum.reduceat(label, np.arange(0, n, width))
            highs = np.maximum.reduceat(label, np.arange(0, n, width))
            one = (lows[a] == highs[a]) & (lows[b] == highs[b]) & (lows[a] == lows[b])
            a, b, apart, known = a[~one], b[~one], apart[~one], known[~one]
        below = len(ands[level - 1])
        i, j = np.divmod(np.arange(FAN * FAN), FAN)
        x = (a[:, None] * FAN + i).ravel()
        y = (b[:, None] * FAN + j).ravel()
        ok = (x < below) & (y < below) & (x <= y)
        if ok.any():
            stack.append((level - 1, x[ok], y[ok], np.repeat(apart, FAN * FAN)[ok], np.repeat(known, FAN * FAN)[ok]))
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def links(fps: DataFrame, cap: int = CAP) -> DataFrame:
    """Links (a, b) between the nodes of distinct fingerprints (seed, fp, node) of one seed, that connect all that differ in at most LIMIT bits."""
    parts, key = blocks(64, LIMIT + 1), ["seed", "turn", "value"]
    kind = fps.schema["node"].dataType.simpleString()
    dealt = fps.select("seed", "fp", "node", F.explode(F.array(*[
        F.struct(F.lit(k).alias("turn"), F.lit(-1).alias("again"), F.shiftrightunsigned(F.shiftleft("fp", at), 64 - width).alias("value"), F.lit(0).cast("long").alias("second"))
        for k, (at, width) in enumerate(parts)])).alias("k")).select("seed", "fp", "node", "k.*")
    full = cut(dealt.groupBy(*key).count().where(F.col("count") > cap).select(*key))
    if not full.isEmpty():
        flagged = dealt.join(small(full.withColumn("_full", F.lit(True)), BROADCAST_ROWS), key, "left")
        rest = flagged.where(F.col("_full").isNull()).select(*dealt.columns)
        hot = flagged.where("_full")
        again = []
        for k, (at, width) in enumerate(parts):  # the other bits, after the block, in five parts of their own
            for r, (at2, width2) in enumerate(blocks(64 - width, LIMIT + 1)):
                start = (at + width + at2) % 64  # where the part starts, counted from the top and around
                turned = F.col("fp") if start == 0 else F.shiftleft("fp", start).bitwiseOR(F.shiftrightunsigned("fp", 64 - start))
                again.append(hot.where(F.col("turn") == k).select("seed", "fp", "node", "turn", F.lit(r).alias("again"), "value", F.shiftrightunsigned(turned, 64 - width2).alias("second")))
        dealt = rest
        for part in again:
            dealt = dealt.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        fp = table.column("fp").to_numpy().view(np.uint64)
        group = np.column_stack([table.column(c).to_numpy() for c in ("seed", "turn", "again")])
        order = np.lexsort(group.T)
        group, fp, node = group[order], fp[order], table.column("node").combine_chunks().take(pa.array(order))
        edge = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(1)]))
        for at, end in zip(edge, np.append(edge[1:], len(fp))):
            _, k, r = group[at].tolist()
            own, (offset, width) = fp[at:end], parts[k]
            v = rotate(own, offset)
            if r >= 0:
                inner = blocks(64 - width, LIMIT + 1)[r]
                v, width = rotate(v, inner[0], 64 - width), width + inner[1]
            to = index_links(v, width)
            linked = np.flatnonzero(to != np.arange(len(own)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([node.take(pa.array(linked + at)), node.take(pa.array(to[linked] + at))], names=["a", "b"])

    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() * len(parts) // INDEX_ROWS))
    return dealt.repartition(n, *key, "again", "second").select("seed", "fp", "node", "turn", "again").mapInArrow(run, f"a {kind}, b {kind}")


def _components(marked: DataFrame) -> DataFrame:
    """(fp, least) of the fingerprints of ``marked`` (id, h, fp): the least row (no id, id, h) of each one's component."""
    row = F.struct(F.col("id").isNull().alias("no"), "id", "h")
    nodes = cut(marked.groupBy("fp").agg(F.min(row).alias("least")))
    roots = connected(links(nodes.select(F.lit(0).alias("seed"), "fp", F.col("fp").alias("node"))), "a", "b")
    linked = cut(nodes.join(roots, nodes.fp == roots.node).select("fp", "least", "root").unionByName(
        nodes.join(roots.select("root").distinct(), nodes.fp == F.col("root")).select("fp", "least", "root")))
    least = cut(linked.groupBy("root").agg(F.min("least").alias("top")))  # written, so that a join with a large component can be split
    return linked.join(least, "root").select("fp", F.col("top").alias("least")).unionByName(nodes.join(linked.select("fp"), "fp", "left_anti"))


def _marked(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, h, fp) of every row, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["id", "h", "fp"])

    source = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("h"), F.col(text_col).alias("text"))
    return cut(source.mapInArrow(run, f"id {source.schema[0].dataType.simpleString()}, h bigint, fp bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``id_col``, fp and component_id, the smallest id that links reach."""
    marked = _marked(docs, id_col, text_col, shingle)
    return marked.join(_components(marked), "fp").select(F.col("id").alias(id_col), "fp", F.col("least.id").alias("component_id"))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, as fingerprints know words, in one array, and the text of each."""
    packed = pack([(t or "").encode("utf-8", "replace").translate(_LOWER) for t in texts])
    first, _, hashed = words(packed, _APART)
    return hashed, np.searchsorted(packed.start, first, "right") - 1


def word_fingerprints(texts: list[str | None], seeds: int) -> np.ndarray:
    """(texts, seeds) fingerprints of successive pairs of words (of the word, if there is one only), for each seed apart."""
    hashed, owner = word_hashes(texts)
    n = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    pair = mix(hashed[:-1] * np.uint64(3) + hashed[1:]) if len(hashed) else hashed
    inside = np.concatenate([owner[1:] == owner[:-1], [False]]) if len(owner) else np.zeros(0, bool)
    lone = n[owner] == 1 if len(owner) else inside
    held, own = np.where(lone, hashed, np.append(pair, np.uint64(0)) if len(hashed) else hashed)[inside | lone], owner[inside | lone]
    out = np.zeros((len(texts), seeds), np.uint64)
    if not len(held):
        return out
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    count = np.diff(np.append(first, len(own)))
    for s in range(seeds):
        bits = np.unpackbits(mix(held + np.uint64(0x9E3779B97F4A7C15 * (s + 1) % 2**64)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        most = 2 * np.add.reduceat(bits, first, axis=0, dtype=np.int64) > count[:, None]
        out[own[first], s] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted 32-bit hashes of the text's shingles (fewer words: of all of them), each once."""
    hashed, _ = word_hashes([text])
    if not len(hashed):
        return np.zeros(0, np.uint32)
    width = min(shingle, len(hashed))
    h = np.zeros(len(hashed) - width + 1, np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashed[i : len(hashed) - width + 1 + i])
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def least_hashes(texts: list[str | None], shingle: int, bands: int, least: int) -> np.ndarray:
    """(texts, bands) keys, each of the least of the text's shingles (as in ``shingle_set``) in ``least`` random orders; 0 for texts without words."""
    hashed, owner = word_hashes(texts)
    out = np.zeros((len(texts), bands), np.uint64)
    if not len(hashed):
        return out
    n = np.bincount(owner, minlength=len(texts))
    held, own = [], []
    for width in range(1, shingle + 1):  # fewer words than a shingle's make one of all
        inside = np.flatnonzero((n[owner] == width) if width < shingle else (n[owner] >= width))
        inside = inside[inside <= len(hashed) - width]
        inside = inside[owner[inside] == owner[inside + width - 1]]
        h = np.zeros(len(inside), np.uint64)
        for i in range(width):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashed[inside + i])
        held.append(h)
        own.append(owner[inside])
    h, of = np.concatenate(held), np.concatenate(own)
    if len(held[-1]) < len(h):
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    keys = mix(np.arange(1, 2 * bands * least + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(bands, least, 2)
    for k in range(bands):
        key = np.full(len(first), k + 1, np.uint64)
        for flip, times in keys[k]:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((h ^ flip) * (times | np.uint64(1)), first))
        out[of[first], k] = np.maximum(key, np.uint64(1))
    return out


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets' Jaccard similarity is at least ``similarity``; empty sets are like nothing."""
    if not len(a) or not len(b) or min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def similar_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = COPY_SHINGLE, similarity: float = COPY_SIMILARITY, bands: int = COPY_BANDS,
                   leaders: int = LEADERS, followers: int = FOLLOWERS, most_links: int = LINKS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, h) of the rows that have ``similarity`` with a smaller row that stays (Jaccard, of ``shingle`` words); h is ``text_hash``.

    Candidates are components of rows that share any of ``bands`` keys of least shingle hashes. By increasing (id, h), a row goes if a row that stays is like it: no two rows of a
    component that both stay are alike, and none goes that isn't like one that stays. That is found in a bounded number of steps: in each of ``leaders`` rounds the least row of each
    component stays and all that are like it go, in parts of ``followers`` rows; what is then left of a component is compared in tiles of two such parts, and its links are settled
    in one task if they are at most ``most_links``, else by rounds of joins. No step sorts or holds a component's rows in one task. Rows without an id are left out.
    """
    source = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("h"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    kind = source.schema[0].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 18):
            found = least_hashes(batch.column(2).to_pylist(), shingle, bands, COPY_LEAST)
            row, band = np.nonzero(found)  # texts without words have 0
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row)) for i in (0, 1)), pa.array(found[row, band].view(np.int64))], names=["id", "h", "key"])

    node = F.struct("id", "h")
    marked = cut(source.mapInArrow(keys, f"id {kind}, h bigint, key bigint"))
    # A row is tied to the least one with its key of a band.
    least = cut(marked.groupBy("key").agg(F.min(node).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    roots = connected(marked.join(least, "key").select(node.alias("a"), "b").where("a != b").distinct(), "a", "b")
    of = F.xxhash64("root").alias("root")  # roots with one hash are compared as one component
    group = cut(roots.select("node.*", of).union(roots.select("root").distinct().select("root.*", of)))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3)), pa.array(made, pa.binary())], names=["id", "h", "root", "held"])

    held_rows = f"id {kind}, h bigint, root bigint, held binary"
    left = cut(source.join(small(group, broadcast_rows), ["id", "h"]).select("id", "h", "text", "root").mapInArrow(sets, held_rows))
    numbers = lambda column: [np.frombuffer(x, np.uint32) for x in column.to_pylist()]

    def follow(members: pa.Table, led: pa.Table) -> pa.Table:
        out = members.select(["id", "h", "root", "held"])
        if not members.num_rows:
            return out.append_column("like", pa.array([], pa.bool_()))
        top = np.frombuffer(led.column("stay")[0].as_py(), np.uint32)
        like = pa.array([alike(x, top, similarity) for x in numbers(members.column("held"))], pa.bool_())
        return out.set_column(3, "held", pa.compute.if_else(like, pa.scalar(b"", pa.binary()), out.column("held"))).append_column("like", like)

    gone = [source.select("id", "h").limit(0)]
    for _ in range(leaders):
        if left.isEmpty():
            break
        tops = cut(left.groupBy("root").agg(F.min(F.struct("id", "h")).alias("top"), F.ceil(F.count(F.lit(1)) / followers).cast("int").alias("parts")))
        known = left.join(small(tops, broadcast_rows), "root")
        copies = known.where(node == F.col("top")).select("root", F.col("held").alias("stay"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).toDF("root", "stay", "part")
        members = known.where(node != F.col("top")).select("id", "h", "root", "held", F.pmod(F.xxhash64("id", "h"), F.col("parts")).cast("int").alias("part"))
        judged = cut(members.groupBy("root", "part").cogroup(copies.groupBy("root", "part")).applyInArrow(follow, f"{held_rows}, like boolean"))
        gone.append(judged.where("like").select("id", "h"))
        left = judged.where("NOT like").drop("like")

    def tile(rows: pa.Table) -> pa.Table:
        part, x, y = (rows.column(c).to_pylist() for c in ("part", "x", "y"))
        nodes, held = list(zip(rows.column("id").to_pylist(), rows.column("h").to_pylist())), numbers(rows.column("held"))
        upper = [i for i, p in enumerate(part) if p == x[0]]
        lower = upper if x[0] == y[0] else [i for i, p in enumerate(part) if p == y[0]]
        found = [(max(nodes[i], nodes[j]), min(nodes[i], nodes[j])) for n, i in enumerate(upper) for j in (upper[n + 1 :] if lower is upper else lower) if alike(held[i], held[j], similarity)]
        names, ends = ["a", "b"], pa.struct([("id", rows.schema.field("id").type), ("h", pa.int64())])
        return pa.table({"root": pa.array([rows.column("root")[0].as_py()] * len(found), pa.int64()), **{c: pa.array([{"id": f[k][0], "h": f[k][1]} for f in found], ends) for k, c in enumerate(names)}})

    if not left.isEmpty():
        sizes = cut(left.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root", F.ceil(F.col("n") / followers).cast("int").alias("parts")))
        dealt = left.join(small(sizes, broadcast_rows), "root").withColumn("part", F.pmod(F.xxhash64("id", "h"), F.col("parts")).cast("int"))
        tiled = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
            "id", "h", "root", "held", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
        ends = f"struct<id:{kind},h:bigint>"
        found = cut(tiled.groupBy("root", "x", "y").applyInArrow(tile, f"root bigint, a {ends}, b {ends}"))
        gone.append(settle(found, most_links, broadcast_rows).select("a.id", "a.h"))
    return reduce(DataFrame.union, gone)


def settle(found: DataFrame, most_links: int = LINKS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(a) of the nodes that go, of links (root, a, b) with b < a: by increasing node, one goes if it has a link to one that stays."""
    kind = found.schema["a"].dataType.simpleString()
    many = cut(found.groupBy("root").count().where(F.col("count") > most_links).select("root"))

    def one_task(links: pa.Table) -> pa.Table:
        below: dict[tuple, list[tuple]] = {}
        for a, b in zip(links.column("a").to_pylist(), links.column("b").to_pylist()):
            below.setdefault((a["id"], a["h"]), []).append((b["id"], b["h"]))
        out: set[tuple] = set()
        for a in sorted(below):
            if any(b not in out for b in below[a]):
                out.add(a)
        return pa.table({"a": pa.array([{"id": i, "h": h} for i, h in sorted(out)], links.schema.field("a").type)})

    gone = [cut(found.join(small(many, broadcast_rows), "root", "left_anti").groupBy("root").applyInArrow(one_task, f"a {kind}"))]
    left = cut(found.join(small(many, broadcast_rows), "root", "left_semi").select("a", "b").distinct())
    while not left.isEmpty():  # a link leads down, so in each round at least the least node of what hangs together is settled
        first = left.select("b").distinct().join(left.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
        out = cut(left.join(first, "b", "left_semi").select("a").distinct())
        gone.append(out)
        left = cut(left.join(out, "a", "left_anti").join(out.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b"))
    return reduce(DataFrame.union, gone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float | None = COPY_SIMILARITY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns.

    Of a component of fingerprints the row with the least (id, text hash) stays; then, unless ``similarity`` is None, ``similar_copies`` of what is left go too, as
    4 of 64 bits hold fewer pairs together than a similarity of 0.8 asks for. Rows are known by id and text, so rows of one id with different texts don't go together; of
    rows that repeat both, one stays. Rows without an id stay. ``docs`` is read several times, so it has to give the same rows each time, as a stored table does.
    """
    marked = _marked(docs, id_col, text_col, shingle)
    found = marked.join(_components(marked), "fp").where(F.col("id").isNotNull())
    own = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("h") == F.col("least.h"))
    counted = found.groupBy("id", "h").agg(F.first(own).alias("again"), F.count(F.lit(1)).alias("n"))
    gone = cut(counted.where("NOT again OR n > 1").select("id", "h", "again"))
    left = drop_rows(docs, gone, id_col, text_col, broadcast_rows)
    if similarity is None:
        return left
    copies = cut(similar_copies(left, id_col, text_col, similarity=similarity, broadcast_rows=broadcast_rows).distinct().withColumn("again", F.lit(False)))
    return drop_rows(left, copies, id_col, text_col, broadcast_rows)
