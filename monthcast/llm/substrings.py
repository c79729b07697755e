"""Removal of passages that occur earlier: repeated windows by level-wise doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from monthcast.llm.blocks import blocks, gather, pack, split, unpack
from monthcast.llm.tables import bounded_batches, partitions, stored, stored_by
from monthcast.llm.words import Words, chunks, windows

WINDOW = 20
SHARDS_PER_PARTITION = 4
LAST = np.iinfo(np.int64).max


def levels(window: int) -> list[int]:
    """Lengths below the window, each half the next, down to about five words."""
    out = []
    while window >= 10:
        window = (window + 1) // 2
        out.append(window)
    return out[::-1]


def argmin_runs(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest (the first of equals) of every ``width`` neighbours."""
    at, have = np.arange(len(h)), 1
    while have < width and len(at):
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        have += step
    return at


def _anchors(hashes: np.ndarray, start: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the run of ``length`` words in it with the smallest hash: its place and its hash.

    Equal windows have it at the same offset, so a window can only occur
    again if that run does; the other runs need not be sent.
    """
    h = windows(hashes, length)
    at = argmin_runs(h, window - length + 1)[start]
    return at, h[at]


def _key(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard above, 32 bits of the hash below. Two runs that share a key only pass a level needlessly."""
    return (h & np.uint64(0xFFFFFFFF)) % np.uint64(shards) << np.uint64(32) | h >> np.uint64(32)


def _starts(words: Words, window: int) -> np.ndarray:
    n = len(words) - window + 1
    return np.flatnonzero(words.doc[:n] == words.doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)


def _survivors(words: Words, hashes: np.ndarray, repeated: list[np.ndarray], window: int, shards: int) -> np.ndarray:
    """First words of the windows whose runs repeat at every level answered so far."""
    start = _starts(words, window)
    for length, known in zip(levels(window), repeated, strict=False):
        if not len(start):
            break
        key = _key(_anchors(hashes, start, length, window)[1], shards)
        at = np.searchsorted(known, key)
        start = start[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == key)] if len(known) else start[:0]
    return start


def _pieces(rows: list[bytes]) -> Iterator[tuple[int, Words]]:
    """First row and words of parts of a block, as much as fits in memory in wide form."""
    for first, part in chunks(pa.array(rows, pa.large_binary())):
        yield first, Words.of(part)


def _ask(rows: list[bytes], repeated: list[np.ndarray], window: int, shards: int) -> Iterator[tuple[int, bytes]]:
    """Messages of a block: the keys of its runs at the next level, and which it has twice."""
    length = levels(window)[len(repeated)]
    found = []
    for _, words in _pieces(rows):
        hashes = words.hashes()
        start = _survivors(words, hashes, repeated, window, shards)
        if len(start):
            at, h = _anchors(hashes, start, length, window)
            _, first = np.unique(at, return_index=True)
            found.append(_key(h[first], shards))
    key, times = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
    for shard, at in split((key >> np.uint64(32)).astype(np.int64), shards):
        yield shard, pack(key[at].astype(np.uint32), times[at] > 1)


def _answer_repeated(messages: pa.Table) -> pa.Table:
    """To each block those of its keys that occur at two places or more in all blocks."""
    sent = [unpack(m) for m in messages["data"].to_pylist()]
    every = np.concatenate([k for k, _ in sent])
    key, times = np.unique(every, return_counts=True)
    twice = np.unique(np.concatenate([k[t] for k, t in sent]))
    known = np.union1d(key[times > 1], twice)
    out = [pack(k[np.isin(k, known)]) for k, _ in sent]
    return pa.table({"block": messages["block"], "shard": messages["shard"], "data": pa.array(out, pa.binary())})


def _windows(
    rows: list[bytes], ids: np.ndarray, repeated: list[np.ndarray], window: int, shards: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The surviving windows of a block in order of (shard, hash, id, place): shard, hash, id, first word in the block."""
    shard, key, doc, place, base = [], [], [], [], 0
    for first, words in _pieces(rows):
        hashes = words.hashes()
        start = _survivors(words, hashes, repeated, window, shards)
        if len(start):
            other = windows(words.hashes(1), window, 1)[start]
            shard.append((other % np.uint64(shards)).astype(np.int64))
            key.append(windows(hashes, window)[start])
            doc.append(ids[first + words.doc[start]])
            place.append(base + start)
        base += len(words)
    if not key:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    shard, key, doc, place = map(np.concatenate, (shard, key, doc, place))
    order = np.lexsort((place, doc, key, shard))
    return shard[order], key[order], doc[order], place[order]


def _heads(shard: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a new window text begins."""
    if not len(key):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])])


def _answer_first(messages: pa.Table) -> pa.Table:
    """To each block, in the order of its keys, whether it holds the first of the equal windows."""
    block = messages["block"].to_numpy()
    sent = [unpack(m) for m in messages["data"].to_pylist()]
    size = [len(k) for k, _ in sent]
    key, doc = np.concatenate([k for k, _ in sent]), np.concatenate([d for _, d in sent])
    order = np.lexsort((np.repeat(block, size), doc, key))
    first = np.zeros(len(key), bool)
    first[order[_heads(key[order], key[order])]] = True
    out = [pack(f) for f in np.split(first, np.cumsum(size)[:-1])]
    return pa.table({"block": messages["block"], "shard": messages["shard"], "data": pa.array(out, pa.binary())})


def _ids(docs: pa.Table) -> np.ndarray:
    return docs["id"].cast(pa.int64()).fill_null(LAST).to_numpy()


def _known(answers: pa.Table, shards: int, count: int) -> list[np.ndarray]:
    """The sorted keys answered at each of the first ``count`` levels."""
    out = [[np.zeros(0, np.uint64)] for _ in range(count)]
    for level, shard, data in zip(*(answers[c].to_pylist() for c in ("level", "shard", "data")), strict=True):
        if level < count:
            out[level].append(unpack(data)[0].astype(np.uint64) | np.uint64(shard << 32))
    return [np.sort(np.concatenate(x)) for x in out]


def _kept(rows: list[bytes], removed: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Number of words, number removed, and the other words joined by one space, of each text."""
    base = 0
    for _, words in _pieces(rows):
        stay = ~removed[base : base + len(words)]
        size = words.end[stay] - words.start[stay] + 1
        out = gather(words.data, words.start[stay], size)
        end = np.cumsum(size)
        out[end - 1] = 32
        kept = np.bincount(words.doc[stay], minlength=len(words.first) - 1)
        bound = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(kept)])]
        raw = out.tobytes()
        for n, k, a, b in zip(words.counts().tolist(), kept.tolist(), bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            yield n, n - k, raw[a : max(a, b - 1)]
        base += len(words)


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed and text, the words that stay joined by one space.

    A word goes if a window of ``window`` words over it has the same words as
    a window that starts earlier: in a row with a smaller id, or earlier in
    the same text. Windows are judged on the texts as they come.

    Runs of a quarter of the window are counted first. Those that occur twice
    are extended to half the window, and what still occurs twice to the whole
    window; only there is the first occurrence found, over all rows. At the
    short lengths a window is represented by its run of smallest hash. Blocks
    ask shards (``blocks``); texts are written once, bucketed by block, and
    never shuffle. A run that every document has is one key a block.

    The last level compares 64 bits of one hash within a shard chosen by
    another, so texts that differ are taken as equal with a probability of
    about n^2 / 2^70 for n windows.

    Null and empty texts have no words. A null id counts as larger than any
    other. Of rows with the same id the one in the lower block counts as
    earlier. Texts shorter than the window keep all words. ``window`` is at
    least 10.
    """
    if window < 10:
        raise ValueError("the window needs ten words at least")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(rows.schema["id"].dataType)
    shards = SHARDS_PER_PARTITION * partitions(spark)
    steps = len(levels(window))
    message = "block long, shard int, data binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rest, texts in blocks(batches):
            asked = list(_ask(texts, [], window, shards))
            n, m = len(texts), len(asked)
            ids = rest["id"].chunk(0).cast(id_type)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["doc"] * n + ["run"] * m),
                    pa.array([block] * (n + m), pa.int64()),
                    pa.array([None] * n + [s for s, _ in asked], pa.int32()),
                    pa.concat_arrays([ids, pa.nulls(m, id_type)]),
                    pa.array(texts + [d for _, d in asked], pa.binary()),
                ],
                ["kind", "block", "shard", "id", "data"],
            )

    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        level = max(answers["level"].to_pylist(), default=-1) + 1
        known = _known(answers, shards, level)
        found = list(_ask(docs["data"].to_pylist(), known, window, shards)) if len(docs) and level else []
        return _messages(docs, found)

    def ask_last(docs: pa.Table, answers: pa.Table) -> pa.Table:
        known = _known(answers, shards, steps)
        shard, key, doc, _ = _windows(docs["data"].to_pylist(), _ids(docs), known, window, shards)
        head = _heads(shard, key)
        return _messages(docs, [(s, pack(key[head[at]], doc[head[at]])) for s, at in split(shard[head], shards)])

    def finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = docs["data"].to_pylist()
        known = _known(answers, shards, steps)
        shard, key, _, place = _windows(texts, _ids(docs), known, window, shards)
        head = _heads(shard, key)
        last = [
            (s, unpack(d)[0])
            for level, s, d in zip(*(answers[c].to_pylist() for c in ("level", "shard", "data")), strict=True)
            if level == steps
        ]
        first = np.concatenate([d for _, d in sorted(last, key=lambda x: x[0])]) if last else np.zeros(0, bool)
        gone = np.ones(len(key), bool)
        gone[head[first]] = False
        total = sum(len(w) for _, w in _pieces(texts))
        step = np.bincount(place[gone], minlength=total + 1) - np.bincount(place[gone] + window, minlength=total + 1)[: total + 1]
        out = list(_kept(texts, np.cumsum(step[:total]) > 0))
        return pa.table(
            {
                "id": docs["id"].cast(id_type),
                "n_words": pa.array([x[0] for x in out], pa.int64()),
                "n_removed": pa.array([x[1] for x in out], pa.int64()),
                "text": pa.array([x[2].decode() for x in out], pa.string()),
            }
        )

    staged = stored_by(rows.mapInArrow(read, f"kind string, block long, shard int, id {kind}, data binary"), "passages", "block", "kind")
    texts = staged.where("kind = 'doc'").select("block", "id", "data").groupBy("block")
    sent = staged.where("kind = 'run'").select("block", "shard", "data")
    answers = None
    for level in range(steps):
        got = sent.groupBy("shard").applyInArrow(_answer_repeated, message).withColumn("level", F.lit(level))
        got = stored(got, "repeated")
        answers = got if answers is None else answers.union(got)
        sent = texts.cogroup(answers.groupBy("block")).applyInArrow(ask_last if level == steps - 1 else ask, message)
    got = sent.groupBy("shard").applyInArrow(_answer_first, message).withColumn("level", F.lit(steps))
    out = texts.cogroup(answers.union(got).groupBy("block")).applyInArrow(
        finish, f"id {kind}, n_words long, n_removed long, text string"
    )
    return out.withColumnRenamed("id", id_col)


def _messages(docs: pa.Table, found: list[tuple[int, bytes]]) -> pa.Table:
    block = docs["block"][0].as_py() if len(docs) else None
    return pa.table(
        {
            "block": pa.array([block] * len(found), pa.int64()),
            "shard": pa.array([s for s, _ in found], pa.int32()),
            "data": pa.array([d for _, d in found], pa.binary()),
        }
    )
