"""Language-model scores from an n-gram trie in Elias-Fano form, spread over shards."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from monthcast.llm.blocks import blocks, pack, split, unpack
from monthcast.llm.elias_fano import Level
from monthcast.llm.tables import bounded_batches, partitions, shuffles_removed, stored, stored_by
from monthcast.llm.words import Words, chunks, mix
from monthcast.session import scratch_path

ORDER = 3
#: Taken off every count of an n-gram and given to the lower order.
DISCOUNT = 0.75
#: Steps of a quantised probability, 12 bits.
CODES = 4095
SHARDS_PER_PARTITION = 4
#: A block's tokens are held in some twenty arrays of 8 bytes each.
BLOCK_BYTES = 8 << 20
#: Text hashed at once: its arrays of 8 bytes a byte stay in a core's cache.
TOKEN_BYTES = 1 << 16
#: The hash that stands for the end of a text, and for what is before its first word.
END = np.uint64(0xFFFFFFFFFFFFFFFF)
UNKNOWN = np.uint32(0xFFFFFFFF)


def _tokens(rows: list[bytes]) -> np.ndarray:
    """Hashes of the lower-cased words of all texts, each text followed by ``END``."""
    out = []
    for _, part in chunks(pa.array(rows, pa.large_binary()), TOKEN_BYTES):
        words = Words.of(part, lower=True)
        own = np.full(len(words) + len(part), END, np.uint64)
        own[np.arange(len(words)) + words.doc] = words.hashes()
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them.

    Whole numbers that leave room for their own places in 64 bits are sorted
    together with them, in one go; of others only the distinct ones are sorted.
    """
    bits = len(values).bit_length()
    if values.dtype == np.int64 and len(values):
        low = int(values.min())
        if (int(values.max()) - low).bit_length() + bits < 64:
            mixed = np.sort((values - low) << bits | np.arange(len(values)))
            value = mixed >> bits
            head = np.empty(len(values), bool)
            head[0] = True
            np.not_equal(value[1:], value[:-1], out=head[1:])
            at = np.empty(len(values), np.int64)
            at[mixed & ((1 << bits) - 1)] = np.cumsum(head) - 1
            return value[head] + low, at
    at, found = pd.factorize(values)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[at]


def _small(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the narrowest type that holds them all, as they travel."""
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)


def _long(parts: list[np.ndarray]) -> np.ndarray:
    """Numbers that travelled, one after the other."""
    return np.concatenate(parts).astype(np.int64)


def _read(batches: Iterator[pa.RecordBatch], shards: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows 'doc', a text's tokens as ranks by frequency in the block, and 'word', the block's words and counts by shard.

    One more row 'doc' in shard -1 has the shard of every rank.
    """
    id_type = schema.field("id").type
    for block, rest, rows in blocks(batches, BLOCK_BYTES):
        n = len(rows)
        train = rest["train"].chunk(0)
        token = _tokens(rows)
        stop = np.flatnonzero(token == END) + 1
        size = np.diff(stop, prepend=0)
        word, at = _distinct(token)
        times = np.bincount(at, minlength=len(word))
        learnt = np.bincount(at, np.repeat(train.to_numpy(zero_copy_only=False).astype(float), size), len(word))
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(word), np.uint32)
        rank[order] = np.arange(len(word), dtype=np.uint32)
        word, learnt = word[order], learnt[order].astype(np.int64)
        shard = (word % np.uint64(shards)).astype(np.uint32)
        asked = [(s, pack(word[i], _small(learnt[i]))) for s, i in split(shard, shards)]
        docs = np.split(rank[at], stop[:-1])
        m = len(asked)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(["doc"] * (n + 1) + ["word"] * m),
                pa.array([block] * (n + 1 + m), pa.int64()),
                pa.array([None] * n + [-1] + [s for s, _ in asked], pa.int32()),
                pa.concat_arrays([rest["id"].chunk(0).cast(id_type), pa.nulls(1 + m, id_type)]),
                pa.concat_arrays([train, pa.nulls(1 + m, pa.bool_())]),
                pa.array(
                    [pack(_small(d)) for d in docs] + [pack(shard, np.flatnonzero(word == END).astype(np.uint32))] + [d for _, d in asked],
                    pa.binary(),
                ),
            ],
            schema=schema,
        )


def _count_words(messages: pa.Table) -> pa.Table:
    """Counts and numbers of a shard's words to each block, in the order asked; one row with the totals of the shard."""
    sent = [unpack(m) for m in messages["data"].to_pylist()]
    size = np.cumsum([len(w) for w, _ in sent])
    word, at = _distinct(np.concatenate([w for w, _ in sent]))
    count = np.bincount(at, np.concatenate([c for _, c in sent])).astype(np.int64)
    known = count > 0
    number = np.where(known, np.cumsum(known) - 1, UNKNOWN).astype(np.uint32)
    out = [pack(_small(count[i]), number[i]) for i in np.split(at, size[:-1])]
    shard = messages["shard"][0].as_py()
    return pa.table(
        {
            "block": pa.concat_arrays([messages["block"].combine_chunks(), pa.array([-1], pa.int64())]),
            "shard": pa.array([shard] * (len(out) + 1), pa.int32()),
            "total": pa.array([None] * len(out) + [int(count.sum())], pa.int64()),
            "kinds": pa.array([None] * len(out) + [int(known.sum())], pa.int64()),
            "data": pa.array([*out, None], pa.binary()),
        }
    )


def _code(times: np.ndarray, count: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Codes of n-grams that occur ``times`` after contexts that occur ``count`` times."""
    return np.rint((np.log10((times - DISCOUNT) / count) - scale[0]) / scale[1]).astype(np.int64) + 1


def _single(count: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Codes of a single occurrence, none below the least or above the greatest code."""
    return np.clip(_code(1, count, scale), 1, CODES)


def _build(folder: str, context: np.ndarray, count: np.ndarray, follower: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Write one level of the trie from sorted n-grams; returns the least logarithm and the step of its codes.

    An n-gram's smoothed share (times - DISCOUNT) / count of its context is
    kept as the nearest of ``CODES`` equal steps of its logarithm, from 1 on.
    """
    head = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, np.int64)
    share = np.log10((times - DISCOUNT) / count)
    low, high = (share.min(), share.max()) if len(share) else (0.0, 0.0)
    scale = np.array([low, max(high - low, 1e-9) / (CODES - 1)])
    Level.write(folder, context[head], np.append(head, len(context)), follower, _code(times, count, scale).astype(np.uint16))
    return scale


def _trie(messages: pa.Table, more: bool) -> pa.Table:
    """Build a shard's part of a level from the counts of all blocks, then answer each block from it.

    The level is written to files of the task, mapped into memory, and gone
    with the task. An answer holds, for each context, the number of distinct
    followers here, for each n-gram its code, 0 if it is not known, and, if
    there is a further level, its place and count, and the scale of the
    codes. A code travels as its distance from that of a single occurrence,
    mostly 1, and numbers that rise as their steps.
    """
    sent = [unpack(m) for m in messages["data"].to_pylist()]  # context, its count, number of followers, follower, times
    for m in sent:
        m[0] = np.cumsum(m[0], dtype=np.int64)
    context, at = _distinct(np.concatenate([m[0] for m in sent]))
    count = np.zeros(len(context), np.int64)
    count[at] = np.concatenate([m[1] for m in sent])
    follower, place = _distinct(_long([m[3] for m in sent]))
    bits = len(follower).bit_length()
    pair = np.repeat(at, _long([m[2] for m in sent])) << bits | place
    del place
    asked, which = _distinct(pair)
    times = np.bincount(which, np.concatenate([m[4] for m in sent]), len(asked)).astype(np.int64)
    pair, times = asked[times > 0], times[times > 0]
    with tempfile.TemporaryDirectory() as folder:
        of = pair >> bits
        scale = _build(folder, context[of], count[of], follower[pair & ((1 << bits) - 1)], times)
        of, word = asked >> bits, follower[asked & ((1 << bits) - 1)]
        level = Level.open(folder)
        first, end = level.ranges(context)
        found = level.find(first, end, np.bincount(of, minlength=len(context)), word)
        code, known = np.zeros(len(found), np.int16), found >= 0
        code[known] = level.code[found[known]] - _single(count[of[known]], scale) + 1
        kinds = end - first
        del level
    out, of, on = [], 0, 0
    for own, _, _, follow, _ in sent:
        mine, where = at[of : of + len(own)], which[on : on + len(follow)]
        of, on = of + len(own), on + len(follow)
        parts = [_small(kinds[mine]), code[where], scale]
        if more:
            hit = found[where[found[where] >= 0]]
            parts += [_small(np.diff(hit, prepend=0)), _small(times[hit])]
        out.append(pack(*parts))
    return pa.table({"block": messages["block"], "shard": messages["shard"], "data": pa.array(out, pa.binary())})


class _Block:
    """Tokens of a block and what is known of them so far.

    For every token: whether it is learnt from, p (its probability by the
    orders answered), and ``at``, the place of the n-gram before it, its
    context at the next level, among the distinct ones. Those lie in
    ``context`` by number, -1 where not known, with their counts in ``seen``.
    """

    def __init__(self, docs: pa.Table, answers: pa.Table, total: int, kinds: int, shards: int):
        shard = docs["shard"].to_pylist()
        mark = shard.index(-1)
        data = docs["data"].to_pylist()
        self.rows = [i for i in range(len(data)) if i != mark]
        self.shards = shards
        of_rank, end = unpack(data[mark])
        tokens = [unpack(data[i])[0] for i in self.rows]
        self.size = np.array([len(t) for t in tokens])
        self.word = _long(tokens)
        train = docs["train"].to_pylist()
        self.train = np.repeat([float(train[i]) for i in self.rows], self.size)
        self.place = np.arange(len(self.word)) - np.repeat(np.cumsum(self.size) - self.size, self.size)

        given: dict[int, dict[int, list[np.ndarray]]] = {}
        for level, s, d in zip(*(answers[c].to_pylist() for c in ("level", "shard", "data")), strict=True):
            given.setdefault(level, {})[s] = unpack(d)
        count, number = np.zeros(len(of_rank), np.int64), np.full(len(of_rank), -1, np.int64)
        for s, at in split(of_rank, shards):
            c, k = given[1][s]
            count[at] = c
            number[at] = np.where(k == UNKNOWN, -1, k.astype(np.int64) * shards + s)
        self.number, self.share = number, total / shards
        self.by_number = np.argsort(number, kind="stable")
        self.rank = np.empty(len(number), np.int64)
        self.rank[self.by_number] = np.arange(len(number))
        self.end = end[0] if len(end) else 0
        self.known = (number >= 0)[self.word]
        self.p = ((count + 1.0) / (total + kinds + 1.0))[self.word]
        self.base = self.p
        # A word stands before another or before the end, and the end before a first word: all words are contexts.
        self.context, self.seen = number[self.by_number], count[self.by_number]
        self.at = np.where(self.place > 0, np.roll(self.rank[self.word], 1), self.rank[self.end] if len(end) else 0)
        for level in range(2, max(given) + 1):
            self._add(level, given[level])

    def pairs(self) -> tuple:
        """Distinct contexts, their parts, and the part and follower of distinct n-grams, in the order in which shards get them.

        A context with more than an even share of all tokens is cut into
        parts by its followers, one shard each.
        """
        known = self.context >= 0
        cut = np.where(known, np.clip(np.ceil(self.seen / max(1.0, self.share)), 1, self.shards), 0).astype(np.int64)
        first = np.cumsum(cut) - cut
        owner = np.repeat(np.arange(len(cut)), cut)
        part = np.arange(len(owner)) - first[owner]
        shard = (mix(self.context[owner].astype(np.uint64)) % np.uint64(self.shards)).astype(np.int64)
        shard = (shard + part) % self.shards
        order = np.argsort(shard.astype(np.uint16 if self.shards <= 1 << 16 else np.uint32), kind="stable")
        rank = np.empty(len(owner), np.int64)
        rank[order] = np.arange(len(owner))
        asked = np.flatnonzero(known[self.at] & self.known)
        word, own = self.word[asked], self.at[asked]
        start = np.zeros(len(cut), np.int64)
        start[known] = rank[first[known]]
        entry = start[own]
        if len(owner) > np.count_nonzero(known):
            many = np.flatnonzero((cut > 1)[own])
            spread = mix(self.number[word[many]].astype(np.uint64)) % cut[own[many]].astype(np.uint64)
            entry[many] = rank[first[own[many]] + spread.astype(np.int64)]
        bits = len(self.number).bit_length()
        key, where = _distinct(entry << bits | self.rank[word])
        follower = self.by_number[key & ((1 << bits) - 1)]
        return owner[order], shard[order], asked, key >> bits, follower, where

    def ask(self) -> Iterator[tuple[int, bytes]]:
        """For each shard its contexts, their counts, numbers of followers, the followers, and their learnt times."""
        owner, shard, asked, entry, follower, where = self.pairs()
        follower = self.number[follower]
        times = np.bincount(where, self.train[asked], len(entry)).astype(np.int64)
        followers = np.bincount(entry, minlength=len(owner))
        edge = np.concatenate([[0], np.cumsum(followers)])
        for s, at in split(shard, self.shards):
            a, b = edge[at[0]], edge[at[-1] + 1]
            own = np.diff(self.context[owner[at]], prepend=0)
            yield s, pack(_small(own), _small(self.seen[owner[at]]), _small(followers[at]), _small(follower[a:b]), _small(times[a:b]))

    def _add(self, level: int, given: dict[int, list[np.ndarray]]) -> None:
        """Take in the answers of a level: p of that order, and the contexts of the next."""
        owner, shard, asked, entry, follower, where = self.pairs()
        distinct = np.zeros(len(self.context), np.int64)
        share = np.zeros(len(entry))
        number, times = np.full(len(entry), -1, np.int64), np.zeros(len(entry), np.int64)
        edge = np.concatenate([[0], np.cumsum(np.bincount(entry, minlength=len(owner)))])
        rest = []
        for s, own in split(shard, self.shards):
            kinds, code, scale, *rest = given[s]
            distinct[owner[own]] += kinds  # the parts of a context are in different shards
            a, b = edge[own[0]], edge[own[-1] + 1]
            hit = a + np.flatnonzero(code)
            full = code[hit - a] + _single(self.seen[owner[entry[hit]]], scale) - 1
            share[hit] = 10.0 ** (scale[0] + scale[1] * (full - 1.0))
            if rest:
                number[hit] = np.cumsum(rest[0].astype(np.int64)) * self.shards + s
                times[hit] = rest[1]
        has = (self.context >= 0) & (self.seen > 0)
        weight = np.where(has, DISCOUNT * distinct / np.maximum(1, self.seen), 1.0)
        self.p = self.p * weight[self.at]
        self.p[asked] += share[where]
        if not rest:
            return
        # Contexts of the next level: the n-grams found, but for those that end with their text; the first stands for all others.
        some = np.flatnonzero((number >= 0) & (follower != self.end))
        some = some[np.argsort(number[some])]
        self.context, self.seen = np.append(-1, number[some]), np.append(0, times[some])
        rank = np.zeros(len(entry), np.int64)
        rank[some] = np.arange(1, len(some) + 1)
        found = np.zeros(len(self.word), np.int64)
        found[asked] = rank[where]
        self.at = np.where(self.place >= level - 1, np.roll(found, 1), 0)


def scored(
    docs: DataFrame, train: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Scores of every row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the lower-cased (A-Z) words and one end a text. The model is
    learnt from the rows where ``train`` is true; null counts as true.
    base_score sums log10 of (c + 1) / (N + V + 1); score sums log10 of the
    probabilities of an n-gram model of ``order`` that takes ``DISCOUNT`` off
    every count and gives the rest to the next lower order, down to that of
    base_score. Before the first word stands the end.

    The trie's first level, counts and numbers of words, and each further
    one lie in shards by a hash of the context; a context with more than its
    share of all tokens is cut by its followers. Blocks send their distinct
    n-grams and learnt counts (``blocks``); a shard adds them up, writes its
    part of the level, and answers all blocks from it. Every level covers all
    learnt rows, and its size per shard is that of the input per shard. The
    tokens are written once, bucketed by block, and do not shuffle. A level's
    messages go when its answers are written, so the disk holds those of one
    level at a time.

    Words are told apart by 64 bits of hash. Null and empty texts have one
    token, the end. Null ids and repeated rows keep a row each. If no row is
    learnt from, all words are unknown, train_tokens is 0 and scores are 0.
    """
    if order < 1:
        raise ValueError("the order is at least 1")
    spark = docs.sparkSession
    bounded_batches(spark)
    learnt = F.coalesce(train, F.lit(True))
    rows = docs.select(F.col(id_col).alias("id"), learnt.alias("train"), F.col(text_col).alias("text"))
    kind, id_type = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    shards = SHARDS_PER_PARTITION * partitions(spark)
    schema = pa.schema(
        [("kind", pa.string()), ("block", pa.int64()), ("shard", pa.int32()), ("id", id_type), ("train", pa.bool_()), ("data", pa.binary())]
    )
    sent = rows.mapInArrow(
        lambda b: _read(b, shards, schema), f"kind string, block long, shard int, id {kind}, train boolean, data binary"
    )
    staged = stored_by(sent, "tokens", "block", "kind")
    texts = staged.where("kind = 'doc'").select("block", "shard", "id", "train", "data").groupBy("block")
    asked = staged.where("kind = 'word'").select("block", "shard", "data")
    counts = asked.groupBy("shard").applyInArrow(_count_words, "block long, shard int, total long, kinds long, data binary")
    with shuffles_removed(spark):
        counts = stored(counts, "counts")
        total, kinds = counts.where("block = -1").agg(F.sum("total"), F.sum("kinds")).first()
    total, kinds = total or 0, kinds or 0

    found, path = f"answers_{uuid.uuid4().hex}", scratch_path(spark, "answers")

    def kept(answers: DataFrame, level: int) -> DataFrame:
        """The answers of all levels so far: each is dealt to the buckets of the blocks once and not moved again."""
        own = answers.select("block", "shard", "data", F.lit(level).alias("level"))
        own = own.repartition(partitions(spark), "block")
        writer = own.write.mode("append").option("compression", "zstd").option("path", path)
        with shuffles_removed(spark):
            writer.partitionBy("level").bucketBy(partitions(spark), "block").saveAsTable(found)
        return spark.table(found)

    answers = kept(counts.where("block >= 0"), 1)

    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        found = list(_Block(docs, answers, total, kinds, shards).ask())
        return pa.table(
            {
                "block": pa.array([docs["block"][0].as_py()] * len(found), pa.int64()),
                "shard": pa.array([s for s, _ in found], pa.int32()),
                "data": pa.array([d for _, d in found], pa.binary()),
            }
        )

    def build(more: bool):
        return lambda messages: _trie(messages, more)

    for level in range(2, order + 1):
        asked = texts.cogroup(answers.groupBy("block")).applyInArrow(ask, "block long, shard int, data binary")
        got = asked.groupBy("shard").applyInArrow(build(level < order), "block long, shard int, data binary")
        answers = kept(got, level)

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(docs, answers, total, kinds, shards)
        row = np.repeat(np.arange(len(b.size)), b.size)
        sums = [np.bincount(row, x, len(b.size)) for x in (b.known, np.log10(b.base), np.log10(b.p))]
        return pa.table(
            {
                "id": docs["id"].take(pa.array(b.rows)).cast(id_type),
                "train": docs["train"].take(pa.array(b.rows)),
                "n": pa.array(b.size.astype(np.int64)),
                "known": pa.array(sums[0].astype(np.int64)),
                "base": pa.array(sums[1]),
                "score": pa.array(sums[2]),
            }
        )

    out = texts.cogroup(answers.groupBy("block")).applyInArrow(
        score, f"id {kind}, train boolean, n long, known long, base double, score double"
    )
    return out.select(
        F.col("id").alias(id_col),
        (~F.col("train")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )


def held_out(id_: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 7."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 7 == 2, F.lit(False))
