"""Quality by supervised subword embeddings.

A document's features are its words (runs without white space, case and marks kept), the byte 3- and 4-grams within and at the ends of
words, and one feature for all pairs of equal successive words; all are hashed to ``BUCKETS`` vectors of ``SIZE`` numbers. The average of
these vectors goes through a linear layer and a softmax. Vectors and layer are learned by numpy stochastic gradient descent on a bounded
sample of labelled documents, at most ``PER_LABEL`` of each label, whole texts. As the layer is linear, scoring needs one number per bucket.

Defined cases: a null or empty text has the one feature that every document has, and gets a score too; null ids and repeated rows are scored
like others; labels other than 0 and 1 and unlabelled documents teach nothing; a document with several labels teaches each; without labels of both kinds every score is 0.5.
A text of any length counts whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.llm.common import bounded_sample, pieces
from tabgauge.llm.features import gram_hashes, mix, pack, sums, words

BUCKETS = 1 << 17
SIZE = 12
PER_LABEL = 1500
EPOCHS = 6
THRESHOLD = 0.7
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_REPEAT, _ALWAYS = np.uint32(0), np.uint32(1)


def document_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers of all texts in one array, and each text's [start, end) in it."""
    packed = pack([t.encode("utf-8", "replace") for t in texts])
    first, _, hashed = words(packed, _SPACE)
    owner_of = np.searchsorted(packed.start, first, "right") - 1
    bucket = lambda h: (h % np.uint64(BUCKETS - 2)).astype(np.uint32) + np.uint32(2)
    again = np.zeros(len(hashed), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (owner_of[1:] == owner_of[:-1])
    inside, owner = packed.inside, packed.owner
    owners, found = [np.arange(len(texts)), owner_of, owner_of[again]], [np.full(len(texts), _ALWAYS), bucket(hashed), np.full(int(again.sum()), _REPEAT)]
    space = _SPACE[packed.data]
    for n in (3, 4):
        inner = np.convolve(space, np.ones(n - 2, np.int8))[n - 3 : len(space)]  # spaces among the n-2 bytes from here on
        keep = inner[np.minimum(inside + 1, len(inner) - 1)] == 0
        owners.append(owner[keep])
        found.append(bucket(mix(gram_hashes(packed.data, n)[inside[keep]])))
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    ends = np.cumsum(np.bincount(owners, minlength=len(texts)))
    return found[order], np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


@dataclass
class Model:
    """Score of each bucket (its vector times the layer's difference of classes) and the bias."""

    bucket: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        ids, start, end = document_features([t or "" for t in texts])
        z = sums(self.bucket[ids].astype(np.float64), start, end) / np.maximum(1, end - start) + self.bias
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.4, seed: int = 5) -> Model:
    """docs: of each document its distinct buckets and their shares. Classes weigh alike."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    layer, bias = np.zeros((SIZE, 2), np.float32), np.zeros(2, np.float32)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    done, total = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            at, share = docs[i]
            step = rate * (1 - done / total)
            done += 1
            held = vectors[at]
            mean = share @ held
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[i]
            back = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            # the gradient of a vector is its share of the document; shares are small, so vectors take longer steps
            vectors[at] = held - (step * 60 * share)[:, None] * back
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Model:
    """A model from at most ``per_label`` documents of each label, those whose hashed ids come first.

    ``labels`` has the ids that may be learned from. The sample is drawn from it, so that no text but the sample's moves.
    """
    chosen = bounded_sample(labels.where(F.col(label_col).isin(0, 1)), id_col, label_col, per_label, 13)
    # At most twice per_label rows.
    sample = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(F.broadcast(chosen), id_col).select(id_col, text_col, label_col)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, 1 << 20):
            ids, start, end = document_features([t or "" for t in batch.column(1).to_pylist()])
            found = [np.unique(ids[a:b], return_counts=True) for a, b in zip(start, end)]
            yield pa.RecordBatch.from_arrays([
                pa.array([str(x) for x in batch.column(0).to_pylist()]), batch.column(2).cast(pa.int32()),
                pa.array([f.astype(np.uint32).tobytes() for f, _ in found], pa.binary()),
                pa.array([n.astype(np.uint32).tobytes() for _, n in found], pa.binary())], names=["id", "label", "at", "n"])

    rows = sample.mapInArrow(examples, "id string, label int, at binary, n binary").collect()
    rows.sort(key=lambda r: (r.id, bytes(r.at)))
    labels = np.array([r.label for r in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    docs = []
    for r in rows:
        n = np.frombuffer(r.n, np.uint32)
        docs.append((np.frombuffer(r.at, np.uint32), (n / n.sum()).astype(np.float32)))
    return fit(docs, labels)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``id_col``, score, predicted."""
    bucket, bias = model.bucket.tobytes(), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(np.frombuffer(bucket, np.float32), bias)
        for batch in pieces(batches, text_col, 1 << 19):
            s = held.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns."""
    bucket, bias = model.bucket.tobytes(), model.bias
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(np.frombuffer(bucket, np.float32), bias)
        for batch in pieces(batches, text_col, 1 << 19):
            yield batch.filter(pa.array(held.score(batch.column(place).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
