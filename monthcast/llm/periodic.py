"""Periodic runs of words: internal pattern matching over a suffix array, by range successor in a wavelet tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthcast.llm.tables import bounded_batches
from monthcast.llm.words import Words, chunks, texts

#: A run has at least LEAST words and TIMES periods.
LEAST = 24
TIMES = 3
#: Words of the shortest blocks. A run of LEAST words holds an aligned one together with its copy a period later.
BLOCK = 8

RUN = "struct<start: long, length: long, period: long>"
OUTPUT = f"n_words long, runs array<{RUN}>, text string"


class WaveletTree:
    """The numbers of an array, below ``2 ** bits``, by their bits: one level a bit, highest first.

    Every level keeps, before each place, how many numbers so far have a zero
    there; numbers with a zero go before those with a one on the next level.
    """

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros = []
        for level in reversed(range(self.bits)):
            one = (values >> level) & 1 == 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the numbers in places low..high - 1 are smaller than the bound."""
        every, count = high - low, np.zeros(len(low), np.int64)
        for level, before in zip(reversed(range(self.bits)), self.zeros, strict=True):
            a, b = before[low], before[high]
            one = (bound >> level) & 1 == 1
            count += np.where(one, b - a, 0)
            low, high = np.where(one, before[-1] + low - a, a), np.where(one, before[-1] + high - b, b)
        return np.where(bound >> self.bits > 0, every, count)

    def smallest(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The number of the given rank, from 0, among those in places low..high - 1."""
        rank, value = rank.copy(), np.zeros(len(low), np.int64)
        for level, before in zip(reversed(range(self.bits)), self.zeros, strict=True):
            a, b = before[low], before[high]
            one = rank >= b - a
            rank -= np.where(one, b - a, 0)
            value |= one.astype(np.int64) << level
            low, high = np.where(one, before[-1] + low - a, a), np.where(one, before[-1] + high - b, b)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The smallest number in places low..high - 1 from the bound on, and below the limit; -1 where there is none."""
        out = np.full(len(low), -1)
        rank = self.below(low, high, bound)
        has = np.flatnonzero(rank < high - low)
        found = self.smallest(low[has], high[has], rank[has])
        out[has] = np.where(found < limit[has], found, -1)
        return out


@dataclass
class Suffixes:
    """Suffixes of a text of word numbers, sorted as far as repeated blocks reach.

    ``classes[k][i]`` is the first place, among all suffixes, of those that
    share their first 2 ** k words with suffix i. Doubling ends at the first
    length from BLOCK on of which no aligned block occurs twice: longer
    aligned blocks hold shorter ones, so none of them does either.
    """

    word: np.ndarray
    classes: list[np.ndarray] = field(default_factory=list)
    order: np.ndarray | None = None

    def __post_init__(self) -> None:
        n = len(self.word)
        self.order = np.argsort(self.word, kind="stable")
        self.classes.append(self._places(self.word[self.order]))
        while True:
            size = 1 << (len(self.classes) - 1)
            if size >= BLOCK and not self.repeated(size).any() or size >= n:
                return
            now = self.classes[-1]
            after = np.zeros(n, np.int64)
            after[: n - size] = now[size:].astype(np.int64) + 1
            key = now.astype(np.int64) * (n + 1) + after
            self.order = np.argsort(key, kind="stable")
            self.classes.append(self._places(key[self.order]))

    def _places(self, key: np.ndarray) -> np.ndarray:
        """The class of every suffix from the keys in suffix order."""
        first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        place = np.empty(len(key), np.int32)
        place[self.order] = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        return place

    def level(self, size: int) -> np.ndarray:
        return self.classes[size.bit_length() - 1]

    def repeated(self, size: int) -> np.ndarray:
        """For each aligned block of so many words, whether it occurs twice."""
        place = self.level(size)
        at = np.arange(0, len(place) - size + 1, size)
        count = np.bincount(place, minlength=len(place) + 1)
        return count[place[at]] > 1

    def common(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """Words that agree from i and j on, i < j, or before them. Exact: classes are compared, not hashes."""
        n, out = len(self.word), np.zeros(len(i), np.int64)
        top = len(self.classes) - 1
        for k in reversed(range(top + 1)):
            size, place = 1 << k, self.classes[k]
            live = np.arange(len(i))
            while len(live):  # the longest blocks may agree more than once
                a, b = (x[live] - out[live] - size if back else x[live] + out[live] for x in (i, j))
                inside = a >= 0 if back else b + size <= n
                live, a, b = live[inside], a[inside], b[inside]
                live = live[place[a] == place[b]]
                out[live] += size
                if k < top:
                    break
        return out


def runs(word: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs of at least ``least`` words and ``times`` periods.

    A run of period q below BLOCK holds an aligned block of BLOCK words and
    its next occurrence, q words on. A run of period q from size to
    2 * size - 1, for size a power of two from BLOCK on, holds an aligned
    block of size words and its copy q words on. All occurrences in that
    window are one arithmetic progression. If it has at most two members,
    both are candidates. If it has more, its difference p is a period of the
    block, and the copy of the run's part with period p lies q words on: so q
    is the distance of the starts or of the ends of the two stretches with
    period p around the block and around the progression. Candidates are
    extended both ways as far as they reach; of equal stretches the smallest
    period counts.
    """
    if least < 3 * BLOCK or times < 3:
        raise ValueError(f"runs are found from {3 * BLOCK} words and 3 periods on")
    suffixes, empty = Suffixes(word), np.zeros(0, np.int64)
    if len(word) < least or not suffixes.repeated(BLOCK).any():
        return empty, empty, empty
    tree, found = WaveletTree(suffixes.order), []
    size = BLOCK
    while size.bit_length() <= len(suffixes.classes) and size <= len(word):
        place = suffixes.level(size)
        count = np.bincount(place, minlength=len(place))
        s = np.flatnonzero(suffixes.repeated(size)) * size
        low = place[s].astype(np.int64)
        high = low + count[low]
        if size == BLOCK:
            first = tree.successor(low, high, s + 1, s + size)
            found.append((s[first >= 0], (first - s)[first >= 0]))
        end = s + 2 * size
        first = tree.successor(low, high, s + size, end)
        s, low, high, end, first = (x[first >= 0] for x in (s, low, high, end, first))
        second = tree.successor(low, high, first + 1, end)
        found.append((s, first - s))
        s, low, high, end, first, second = (x[second >= 0] for x in (s, low, high, end, first, second))
        third = tree.successor(low, high, second + 1, end)
        found.append((s[third < 0], (second - s)[third < 0]))
        s, first, step = s[third >= 0], first[third >= 0], (second - first)[third >= 0]
        left, right = (s - suffixes.common(s, s + step, True), first - suffixes.common(first, first + step, True)), (
            s + suffixes.common(s, s + step), first + suffixes.common(first, first + step))
        found += [(s, near[1] - near[0]) for near in (left, right)]
        size *= 2
    s, period = (np.concatenate(x) for x in zip(*found, strict=True))
    s, period = np.unique(np.stack([s, period])[:, (period > 0) & (s + period < len(word))], axis=1)
    start = s - suffixes.common(s, s + period, True)
    end = s + period + suffixes.common(s, s + period)
    long = end - start >= np.maximum(least, times * period)
    if not long.any():
        return empty, empty, empty
    start, period, end = np.unique(np.stack([start, period, end])[:, long], axis=1)  # by start, then period
    order = np.lexsort((period, end, start))
    new = np.r_[True, (np.diff(start[order]) != 0) | (np.diff(end[order]) != 0)]
    keep = np.sort(order[new])
    return start[keep], end[keep], period[keep]


def _numbers(words: Words) -> np.ndarray:
    """Equal numbers for equal words, by their bytes; every text starts with a number of its own."""
    data = words.data.tobytes()
    known: dict[bytes, int] = {}
    number = [known.setdefault(data[a:b], len(known)) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
    border = len(known) + np.arange(len(words.first) - 1)
    return np.insert(np.array(number, np.int64), words.first[:-1], border)


def _collapse(rows: list[bytes], least: int, times: int) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """Number of words, runs, and the words that stay, of each text."""
    words = Words.of(rows, lower=False)
    start, end, period = runs(_numbers(words), least, times)
    drop = np.zeros(len(words) + len(rows) + 1, np.int64)  # numbered with the borders
    np.add.at(drop, np.minimum(start + period, end), 1)
    np.add.at(drop, end, -1)
    drop = np.cumsum(drop) > 0
    edge = words.first + np.arange(len(rows) + 1)  # border of each text
    at = np.searchsorted(edge, start, "right") - 1
    data = words.data.tobytes()
    cut = np.searchsorted(at, np.arange(len(rows) + 1))
    for i, count in enumerate(words.counts().tolist()):
        here = slice(cut[i], cut[i + 1])
        own = zip((start[here] - edge[i] - 1).tolist(), (end - start)[here].tolist(), period[here].tolist(), strict=True)
        stay = words.first[i] + np.flatnonzero(~drop[edge[i] + 1 : edge[i] + 1 + count])
        kept = [data[a:b] for a, b in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]
        yield count, list(own), b" ".join(kept).decode()


def without_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES
) -> DataFrame:
    """id_col, n_words, runs (start, length, period; by start, then period) and text for every row of ``docs``.

    A run is a stretch of consecutive words with smallest period q, of at
    least ``least`` words and ``times`` * q, that cannot be extended keeping
    q. ``text`` holds the words that are in no run or among the first q words
    of every run that holds them, joined by one space.

    Texts are read in parts of about 1 MB; a part is one sequence in which
    every text starts with a number of its own, so nothing crosses texts.
    Nothing is shuffled. A longer text is a part by itself and held whole, at
    about 8 bytes a word and level of its repeated blocks, beside some 150
    bytes a word. Null and empty texts have no words and no runs. Repeated
    rows give equal rows, no rows none. Ids of any type pass through. Other
    columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
        for batch in batches:
            for first, part in chunks(texts(batch.column("text"))):
                n, found, text = zip(*_collapse(part, least, times), strict=True)
                found = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, len(part)), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(text)],
                    ["id", "n_words", "runs", "text"],
                )

    out = rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, {OUTPUT}")
    return out.withColumnRenamed("id", id_col)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the ids its words from some word on replaced by their first few, over and over.

    Fixed rule: h = crc32(decimal id), g = h // 10; if h % 10 = 0 and there
    are n > 0 words, word i >= a becomes word a + (i - a) % p, where a = g % n
    and p = 1 + (n - a) // (3 + g % 8). A null id leaves the text.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeat(w: Column) -> Column:
        g, n = F.floor(h / 10), F.size(w)
        a = (g % n).cast("int")
        p = F.lit(1) + F.floor((n - a) / (3 + g % 8)).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.element_at(w, a + (i - a) % p + 1))
        return F.array_join(F.concat(F.slice(w, 1, a), tail), " ")

    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, changed[0]).otherwise(text)


def digests(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result of ``without_runs`` as counts, the run of most periods, and digests of the runs and the text."""
    fields = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    kind = out.schema[id_col].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", *(f.split()[0] for f in fields.split(", "))]
        for batch in batches:
            rows = []
            for found, text in zip(batch.column("runs").to_pylist(), batch.column("text").to_pylist(), strict=True):
                each = [(r["start"], r["length"], r["period"]) for r in found]
                s, length, p = min(each, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
                lines = "".join(f"{a},{b},{c}\n" for a, b, c in each)
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, text)]
                rows.append((len(each), s, length, p, None if s is None else 1000 * length // p, *sha))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names)

    found = out.select(F.col(id_col).alias("id"), "runs", "text").mapInArrow(describe, f"id {kind}, {fields}")
    return found.withColumnRenamed("id", id_col)
