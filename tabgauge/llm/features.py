"""Hashed words and byte n-grams of a batch of texts, as numpy arrays.

Texts are laid out in one byte buffer, a space before and after each and spaces between, so that no n-gram reaches
into another text: the features of a text don't depend on its neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PAD = 4
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INVERSE = pow(_P, -1, 2**64)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_ODD = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_P**i and its inverse modulo 2**64, for i below n."""
    up, down = np.full(n, _P, np.uint64), np.full(n, _P_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(31))


@dataclass
class Packed:
    """Bytes of several texts and the region [start, end) of each, its two spaces included."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """For each byte of the regions, in order, the number of its text."""
        return np.repeat(np.arange(len(self.start)), self.end - self.start)

    @property
    def inside(self) -> np.ndarray:
        """The positions of the regions' bytes."""
        flags = np.zeros(len(self.data) + 1, np.int8)
        flags[self.start] += 1
        flags[self.end] -= 1
        return np.flatnonzero(np.cumsum(flags[:-1]))


def pack(texts: list[bytes]) -> Packed:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b" " + (b" " * (PAD + 2)).join(texts) + b" " * (PAD + 1), np.uint8)
    start = np.concatenate([[0], np.cumsum(lengths + PAD + 2)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    return Packed(data, start, start + lengths + 2)


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each position on; positions near the end see zeros. n is at most 4."""
    wide = np.concatenate([data, np.zeros(n - 1, np.uint8)]).astype(np.uint64)
    h = np.full(len(data), n, np.uint64)
    for i in range(n):
        h += (wide[i : i + len(data)] + np.uint64(1)) * np.uint64(_ODD[i])
    return h ^ (h >> np.uint64(29))


def words(packed: Packed, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the maximal runs of bytes that are not ``apart`` (a table of 256 flags)."""
    edge = np.diff(np.concatenate([[True], apart[packed.data], [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(packed.data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((packed.data.astype(np.uint64) + np.uint64(1)) * up[: len(packed.data)], dtype=np.uint64)])
    return first, last, mix((total[last] - total[first]) * down[first])


def sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values[start:end], each added up on its own."""
    if not len(start):
        return np.zeros(0)
    out = np.add.reduceat(np.append(values, 0.0), np.column_stack([start, end]).ravel())[::2]
    return np.where(end > start, out, 0.0)
