"""Words of a batch of texts as numpy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word is a run of bytes other than these.
SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: Odd multipliers of the polynomial hashes over bytes and over words.
BYTE_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASE = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 2048


def texts(column: pa.Array) -> pa.Array:
    """Text as bytes; null as empty."""
    return pc.fill_null(column, "").cast(pa.large_binary())


def chunks(column: pa.Array, most: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive rows of about ``most`` bytes: first row and texts. A longer text is a chunk of its own."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for row, size in enumerate(sizes):
        if row > first and (total + size > most or row - first >= rows):
            yield first, column.slice(first, row - first).to_pylist()
            first, total = row, 0
        total += int(size)
    if len(column) > first:
        yield first, column.slice(first).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose high and low bits look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        steps = np.full(size, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    up, down = _powers(base, 1 << max(16, int(size).bit_length()))
    return up[:size], down[:size]


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for many spans, the same wherever the span stands."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


@lru_cache(maxsize=4)
def hashed_places(bits: int, base: int, dims: int) -> np.ndarray:
    """The place, below ``dims`` (a power of two), of every number of ``bits`` bits. Built in parts, to stay small."""
    out = np.empty(1 << bits, np.uint16)
    step = 1 << 16
    for low in range(0, 1 << bits, step):
        keys = np.arange(low, low + step, dtype=np.uint64) * np.uint64(base)
        out[low : low + step] = mix(keys) >> np.uint64(64 - dims.bit_length() + 1)
    return out


@dataclass
class Words:
    """Words of a few texts: bytes, where each word starts and ends, its text, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, rows: list[bytes], lower: bool = False) -> Words:
        data = np.frombuffer(b" ".join(rows) + b" ", np.uint8)
        if lower:
            data = LOWER[data]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = IS_WORD[data]
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        begin = np.cumsum([0] + [len(r) + 1 for r in rows])
        first = np.searchsorted(start, begin)
        doc = np.repeat(np.arange(len(rows)), np.diff(first))
        return cls(data, start, end, doc, first)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        return spans(self.data.astype(np.uint64) + np.uint64(1), self.start, self.end, BYTE_BASE[which])


def windows(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``length`` words, by its first word; runs may cross texts."""
    n = max(0, len(hashes) - length + 1)
    at = np.arange(n)
    return spans(hashes, at, at + length, WORD_BASE[which])


IS_WORD = np.ones(256, np.int8)
IS_WORD[list(SPACE)] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
