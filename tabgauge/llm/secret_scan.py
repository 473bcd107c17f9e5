"""Secrets by patterns and by sliding-window Shannon entropy.

The base patterns give spans of kinds ``assign``, ``access`` and ``hex``. Besides, candidate strings (long runs of one
character class) are scanned with a window whose character counts are updated by one step in and one step out; the
entropy is kept as a running sum of n*log2(n). Overlapping windows at or above the class's threshold form one span. A
span that the allow-list matches, or that other spans cover already, is not added; one that they cover in part is added whole, so spans may overlap. Base
spans are never dropped.

Defined cases: a null or empty text has no spans; equal rows are each scanned; a text of any length is scanned whole, in time that grows with its length; an
empty table gives no rows; other columns are not read; positions are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
# Runs are matched greedily from their first character, so a lower bound drops the same runs that a later test would.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")


@dataclass(frozen=True)
class EntropyClass:
    """Runs of ``chars`` at least ``window`` long; a window passes at ``bits`` or more of entropy per character."""

    kind: str
    chars: str
    window: int
    bits: float


CLASSES = (
    EntropyClass("entropy_hex", r"0-9a-fA-F", 20, 3.0),
    EntropyClass("entropy_base64", r"A-Za-z0-9+/_=-", 20, 3.8),
)

#: Strings that look random but are no secrets.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUIDs
    r"sha(?:1|224|256|384|512)[-:_].*",  # integrity digests
    r"(?:0123456789|1234567890|abcdefghij|ABCDEFGHIJ).*",  # alphabets
    r".*(?:EXAMPLE|example|placeholder|xxxx|XXXX|0000000).*",
    r"[A-Za-z]+(?:[-_/][A-Za-z]+)+",  # words joined by dashes, paths
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of BASE_KINDS."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    found.sort(key=lambda x: (x[0], x[2]))
    return [(a, b, BASE_KINDS[k]) for a, b, k in found]


def window_spans(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Unions of the windows of ``run`` whose entropy is at least ``bits``.

    With counts n of a window of w characters the entropy is log2(w) - sum(n*log2(n))/w; moving it by one character
    changes two terms of the sum.
    """
    if len(run) < window:
        return []
    part = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    most = (math.log2(window) - bits) * window + 1e-9
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(run):
        if i >= window:
            out = run[i - window]
            n = counts[out]
            counts[out] = n - 1
            total += part[n - 1] - part[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += part[n + 1] - part[n]
        if i >= window - 1 and total <= most:
            a, b = i - window + 1, i + 1
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
    return spans


class Union:
    """Characters that spans cover: intervals in order, apart from one another."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def covers(self, a: int, b: int) -> bool:
        """Whether all of [a, b) is covered."""
        i = bisect_right(self.starts, a) - 1
        return i >= 0 and self.ends[i] >= b


class Scanner:
    """All spans of a text: base kinds, then the entropy classes in their order."""

    def __init__(self, classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW):
        self.classes = [(k, c, re.compile(f"[{c.chars}]{{{c.window},}}")) for k, c in enumerate(classes)]
        self.allow = re.compile("|".join(f"(?:{a})" for a in allow)) if allow else None

    def scan(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans, and all spans by start, then kind."""
        base = base_spans(text)
        extra: list[tuple[int, int, int]] = []
        taken = [(a, b) for a, b, _ in base]
        for k, c, runs in self.classes:
            before = Union(taken)  # spans of one class don't overlap
            for m in runs.finditer(text):
                run = m[0]
                if self.allow and self.allow.fullmatch(run):
                    continue
                for a, b in window_spans(run, c.window, c.bits):
                    a, b = a + m.start(), b + m.start()
                    if self.allow and self.allow.fullmatch(text, a, b) or before.covers(a, b):
                        continue
                    taken.append((a, b))
                    extra.append((a, b, k))
        order = {k: i for i, k in enumerate(BASE_KINDS)} | {c.kind: len(BASE_KINDS) + k for k, c, _ in self.classes}
        everything = [*base, *((a, b, self.classes[k][1].kind) for a, b, k in extra)]
        everything.sort(key=lambda x: (x[0], order[x[2]]))
        return base, everything


SCHEMA = "{id} {type}, base array<struct<start:bigint,end:bigint,kind:string>>, spans array<struct<start:bigint,end:bigint,kind:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW,
) -> DataFrame:
    """One row per document: ``id_col``, ``base`` and ``spans``, arrays of (start, end, kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allow)
        rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1):
                x, y = scanner.scan(text.as_py() or "")
                base.append(rows(x))
                spans.append(rows(y))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _SPANS), pa.array(spans, _SPANS)], names=[id_col, "base", "spans"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, SCHEMA.format(id=f"`{id_col}`", type=source.schema[0].dataType.simpleString()))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[{kind}]") -> str:
    """``text`` with each span replaced by ``mark``; of overlapping spans the union is replaced, named by the first."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], mark.format(kind=kind)]
        at = max(at, b)
    return "".join([*out, text[at:]])
