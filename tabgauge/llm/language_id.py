"""Languages by hierarchical discrimination: the family first, then pairwise linear SVMs within it.

Features are counts of byte 2- and 3-grams of the lower-cased text (all ASCII but letters read as spaces), hashed to
``DIM`` places; a text is the vector of square roots of its relative counts, which has length one. A one-versus-rest linear
SVM picks the family; among the languages of a family one-versus-one SVMs vote, and margins break ties. All SVMs are fit
by numpy on a bounded sample of labelled rows (``per_language`` documents of each language, each whole and in two short windows).

Defined cases: null texts, empty ones and texts without a letter are ``und`` with score 0; null languages teach nothing; without any labelled
row all are ``und``; one language only is predicted with score 1; of equal votes the larger margins win, then the language that comes first by name. Repeated rows are each
predicted; null ids are kept; a text of any length counts whole; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgauge.llm.common import bounded_sample, pieces, small
from tabgauge.llm.features import gram_hashes, pack

DIM = 4096
PER_LANGUAGE = 400
WINDOWS = (60, 250)
UNKNOWN = "und"

#: Which languages are close relatives; a language named nowhere is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "be"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
    "semitic": ("ar", "he", "am"),
}

_TO_SPACE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def normalise(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_TO_SPACE)


def has_letter(text: str | None) -> bool:
    return bool(text) and next(filter(str.isalpha, text), None) is not None


def vectors(texts: list[str]) -> np.ndarray:
    """A row of square roots of relative n-gram counts for each text."""
    packed = pack([normalise(t) for t in texts])
    place, inside = packed.owner * DIM, packed.inside
    counts = np.zeros(len(texts) * DIM)
    for n in (2, 3):
        h = (gram_hashes(packed.data, n) >> np.uint64(7)) % np.uint64(DIM)
        # n-grams of spaces only say how many digits and marks there are
        blank = np.convolve(packed.data == 32, np.ones(n, np.int8))[n - 1 :][inside] == n
        counts += np.bincount(place[~blank] + h[inside][~blank].astype(np.int64), minlength=len(texts) * DIM)
    counts = counts.reshape(len(texts), DIM)
    return np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True))).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 50.0, steps: int = 150) -> np.ndarray:
    """Weights and bias (last) that minimise |w|^2/2 + c * mean of squared hinge losses, classes weighted alike; y is +1 or -1."""
    n = len(y)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    seen, ahead = w.copy(), w.copy()
    rate = 1.0 / (1.0 + 4.0 * c)  # rows have length sqrt(2) with the bias, so this step is safe
    for t in range(steps):
        loss = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        pull = -2 * c * weight * y * loss
        grad = np.append(x.T @ pull + ahead[:-1], pull.sum()).astype(np.float32)
        w = ahead - rate * grad
        ahead = w + (t / (t + 3)) * (w - seen)
        seen = w
    assert n
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_w: np.ndarray | None = None  # a column for each family, bias last
    pair_w: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        if not known or not self.families:
            return out, score
        x = vectors([texts[i] for i in known])
        x1 = np.column_stack([x, np.ones(len(x), np.float32)])
        if len(self.families) == 1:
            best, sure = np.zeros(len(x), int), np.ones(len(x))
        else:
            m = x1 @ self.family_w
            best = m.argmax(1)
            top2 = np.sort(m, 1)[:, -2:]
            sure = 1 / (1 + np.exp(-2.0 * (top2[:, 1] - top2[:, 0])))
        for f, family in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            names = self.members[family]
            if not len(rows):
                continue
            votes, margins = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for (a, b), w in self.pair_w.items():
                if a in names:
                    m, i, j = x1[rows] @ w, names.index(a), names.index(b)
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    margins[:, i] += m
                    margins[:, j] -= m
            pick = (votes + 0.5 * np.tanh(margins / (1 + np.abs(margins).max(1, keepdims=True)))).argmax(1)
            own = margins[np.arange(len(rows)), pick] / max(1, len(names) - 1)
            chance = 1 / (1 + np.exp(-4.0 * own)) if len(names) > 1 else np.ones(len(rows))
            for r, p, q in zip(rows, pick, chance * sure[rows]):
                out[known[r]] = names[p]
                score[known[r]] = q
        return out, np.round(np.clip(score, 0, 1), 6)


def family_of(lang: str, families: dict[str, tuple[str, ...]]) -> str:
    return next((f for f, names in families.items() if lang in names), f"other:{lang}")


def fit(x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    names = sorted(set(langs))
    y = np.array([names.index(v) for v in langs])
    model = Model()
    for lang in names:
        model.members.setdefault(family_of(lang, families), []).append(lang)
    model.families = sorted(model.members)
    if len(model.families) > 1:
        own = np.array([model.families.index(family_of(v, families)) for v in names])[y]
        model.family_w = np.column_stack([fit_svm(x, np.where(own == f, 1, -1).astype(np.float32)) for f in range(len(model.families))])
    for members in model.members.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                rows = (y == names.index(a)) | (y == names.index(b))
                model.pair_w[a, b] = fit_svm(x[rows], np.where(y[rows] == names.index(a), 1, -1).astype(np.float32))
    return model


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE, families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """A model from at most ``per_language`` rows of each language: those whose hashed ids come first."""
    usable = labelled.where(F.col(lang_col).isNotNull())
    chosen = bounded_sample(usable, id_col, lang_col, per_language, 11)
    # The chosen ids are bounded by per_language times the number of languages.
    sample = usable.select(id_col, text_col, lang_col).join(small(chosen), [id_col, lang_col], "left_semi").select(text_col, lang_col)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, 1 << 20):
            texts, langs = [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not has_letter(text):
                    continue
                at = [text] + [text[(k := len(text) * (j + 1) // 3) : k + n] for j, n in enumerate(WINDOWS) if len(text) > 2 * n]
                texts += [t for t in at if has_letter(t)]
                langs += [lang] * (len(texts) - len(langs))
            if texts:
                x = vectors(texts)
                found = [np.flatnonzero(row) for row in x]
                yield pa.RecordBatch.from_arrays([
                    pa.array(langs), pa.array([f.astype(np.int16).tobytes() for f in found], pa.binary()),
                    pa.array([row[f].astype(np.float16).tobytes() for row, f in zip(x, found)], pa.binary())], names=["lang", "at", "value"])

    rows = sample.mapInArrow(examples, "lang string, at binary, value binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.value)))
    x = np.zeros((len(rows), DIM), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.at, np.int16)] = np.frombuffer(r.value, np.float16)
    return fit(x, [r.lang for r in rows], families) if rows else Model()


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, 1 << 18):
            lang, score = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, lang_pred string, score double")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
