"""Monotone sequences and n-gram trie levels in Elias-Fano form, in memory-mapped files."""

from __future__ import annotations

import os

import numpy as np

#: Place of the r-th set bit of a byte.
PLACE = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _set = [i for i in range(8) if _byte >> i & 1]
    PLACE[_byte, : len(_set)] = _set


#: Numbers looked up at once, so that what is computed for them stays in a core's cache.
PIECE = 1 << 14
NONE, ALL = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, flip: np.uint64 = NONE) -> np.ndarray:
    """Place of the k-th (from 0) set bit, or zero bit if all are flipped, given the number of them before each word."""
    at = np.searchsorted(before, k, side="right") - 1
    rest, word, out = k - before[at], words[at] ^ flip, at * 64
    for bits in (32, 16, 8):  # the half of the word, then of the half, ... that holds the bit
        ones = np.bitwise_count(word & np.uint64((1 << bits) - 1)).astype(np.int64)
        over = rest >= ones
        rest -= ones * over
        out += bits * over
        word >>= (bits * over).astype(np.uint64)
    return out + PLACE[(word & np.uint64(0xFF)).astype(np.int64), rest]


class EliasFano:
    """A sequence of whole numbers that never falls: about 2 + log2(largest / length) bits each.

    The low bits of a number stand in a packed array; the high parts are unary
    gaps in a bit vector, with a count of set bits before each 64 of them.
    """

    ARRAYS = ("low", "high", "ones", "zeros")

    def __init__(self, size: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.size, self.bits, self.low, self.high, self.ones, self.zeros = size, bits, low, high, ones, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.int64)
        n = len(values)
        most = int(values[-1]) + 1 if n else 1
        bits = max(0, (most // max(1, n)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        at = np.arange(n, dtype=np.int64) * bits
        part = (values & ((1 << bits) - 1)).astype(np.uint64)
        shift = (at & 63).astype(np.uint64)
        word = at >> 6
        if bits:
            head = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[head]] = np.bitwise_or.reduceat(part << shift, head)
        over = np.flatnonzero((at & 63) + bits > 64)  # at most one a word
        low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        up = values >> bits
        place = up + np.arange(n)
        length = (int(up[-1]) if n else 0) + n + 1
        raw = np.zeros((length // 64 + 1) * 64, np.uint8)
        raw[place] = 1
        high = np.packbits(raw, bitorder="little").view(np.uint64)
        per = raw.reshape(-1, 64).sum(axis=1, dtype=np.int64)
        ones = np.cumsum(per) - per
        return cls(n, bits, low, high, ones, np.arange(len(per)) * 64 - ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> shift
        over = (at & 63) + self.bits > 64
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return (out & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        if not self.size:
            return np.zeros(len(i), np.int64)
        if len(i) > PIECE:
            return np.concatenate([self.at(i[a : a + PIECE]) for a in range(0, len(i), PIECE)])
        return (_select(self.high, self.ones, i) - i) << self.bits | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first number that is at least ``x``; the length where there is none."""
        if len(x) > PIECE:
            return np.concatenate([self.successor(x[a : a + PIECE]) for a in range(0, len(x), PIECE)])
        up = x >> self.bits
        top = int(self.at(np.array([self.size - 1]))[0]) >> self.bits if self.size else -1
        out = np.full(len(x), self.size, np.int64)
        inside = np.flatnonzero(up <= top)
        up, want = up[inside], x[inside] & ((1 << self.bits) - 1)
        low = np.zeros(len(up), np.int64)
        some = up > 0
        low[some] = self._zero(up[some] - 1) - (up[some] - 1)  # ones before the bucket
        end = self._zero(up) - up
        high = end.copy()
        while True:  # binary search by the low bits among the numbers of one bucket
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            less = self._low(mid) < want[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        out[inside] = low
        return out

    def _zero(self, k: np.ndarray) -> np.ndarray:
        return _select(self.high, self.zeros, k, ALL)

    def write(self, folder: str, name: str) -> None:
        np.save(os.path.join(folder, f"{name}.shape.npy"), np.array([self.size, self.bits]))
        for part in self.ARRAYS:
            np.save(os.path.join(folder, f"{name}.{part}.npy"), getattr(self, part))

    @classmethod
    def open(cls, folder: str, name: str) -> EliasFano:
        size, bits = np.load(os.path.join(folder, f"{name}.shape.npy")).tolist()
        return cls(size, bits, *(np.load(os.path.join(folder, f"{name}.{p}.npy"), mmap_mode="r") for p in cls.ARRAYS))


class Level:
    """One level of a trie: the followers of contexts, with a code for each.

    Contexts, the pointers to their followers and the followers themselves
    are Elias-Fano sequences. Followers of one context rise; adding one more
    than the last number of the context before makes the whole level rise. A
    follower is found by a successor search from that number on.
    """

    def __init__(self, context: EliasFano, pointer: EliasFano, follower: EliasFano, code: np.ndarray):
        self.context, self.pointer, self.follower, self.code = context, pointer, follower, code

    @classmethod
    def write(cls, folder: str, context: np.ndarray, first: np.ndarray, follower: np.ndarray, code: np.ndarray) -> None:
        """``first`` holds the place of each context's first follower, then the number of followers."""
        last = follower[first[1:] - 1] + 1 if len(context) else np.zeros(0, np.int64)
        base = np.cumsum(last) - last
        for name, values in (
            ("context", context),
            ("pointer", first),
            ("follower", follower + np.repeat(base, np.diff(first))),
        ):
            EliasFano.of(values).write(folder, name)
        np.save(os.path.join(folder, "code.npy"), code)

    @classmethod
    def open(cls, folder: str) -> Level:
        parts = (EliasFano.open(folder, name) for name in ("context", "pointer", "follower"))
        return cls(*parts, np.load(os.path.join(folder, "code.npy"), mmap_mode="r"))

    def ranges(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First follower of each context, and the place after its last; equal where it is not known."""
        if not self.context.size:
            return np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        at = self.context.successor(context)
        inside = np.minimum(at, self.context.size - 1)
        known = (at < self.context.size) & (self.context.at(inside) == context)
        first = np.where(known, self.pointer.at(inside), 0)
        return first, np.where(known, self.pointer.at(inside + 1), first)

    def find(self, first: np.ndarray, end: np.ndarray, times: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """Place of each follower, ``times`` of them for each range, or -1."""
        base = np.zeros(len(first), np.int64)
        inner = first > 0
        base[inner] = self.follower.at(first[inner] - 1) + 1
        base, end = np.repeat(base, times), np.repeat(end, times)
        want = follower + base
        at = self.follower.successor(want)
        out = np.full(len(want), -1, np.int64)
        inside = np.flatnonzero((at < end) & (end > np.repeat(first, times)))
        hit = inside[self.follower.at(at[inside]) == want[inside]]
        out[hit] = at[hit]
        return out
