"""Byte-level BPE: every distinct pre-token is encoded once, ids go back by position."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from monthcast.llm.blocks import BLOCK_BYTES, blocks, gather, pack, split, unpack
from monthcast.llm.tables import bounded_batches, partitions, stored_by

SHARDS_PER_PARTITION = 4


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of a rank file: base64 text and number a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def _merges(path: str) -> tiktoken.Encoding:
    """Merges of one whole pre-token; the splitting is done before."""
    return tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> pa.Array:
    """The token-byte table, by id."""
    table = ranks(path)
    out = [None] * (max(table.values(), default=-1) + 1)
    for token, rank in table.items():
        out[rank] = token
    return pa.array(out, pa.large_binary())


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


STAGED = "kind string, block long, shard int, {id}, data binary"


def _pretokens(
    batches: Iterator[pa.RecordBatch], pattern: str, shards: int, schema: pa.Schema, most: int
) -> Iterator[pa.RecordBatch]:
    """Rows 'doc', the positions of a document's pre-tokens in the block's word list, and 'word', that list by shard."""
    find = regex.compile(pattern).findall
    for block, rest, rows in blocks(batches, most):
        numbers = _Numbers()
        docs = [np.fromiter(map(numbers.__getitem__, find(row.decode())), np.uint32) for row in rows]
        count = np.bincount(np.concatenate(docs), minlength=len(numbers))
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(numbers), np.uint32)
        rank[order] = np.arange(len(numbers), dtype=np.uint32)
        words = [w.encode() for w in numbers]
        shard = np.fromiter((xxhash.xxh32_intdigest(w) % shards for w in words), np.uint32, len(words))
        lists = []
        for part, at in split(shard, shards):
            at = at[np.argsort(rank[at])]
            own = [words[i] for i in at]
            size = np.fromiter(map(len, own), np.uint32, len(own))
            lists.append((part, pack(rank[at], size, np.frombuffer(b"".join(own), np.uint8))))
        ids = rest["id"].chunk(0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(["doc"] * len(rows) + ["word"] * len(lists)),
                pa.array([block] * (len(rows) + len(lists)), pa.int64()),
                pa.array([None] * len(rows) + [part for part, _ in lists], pa.int32()),
                pa.concat_arrays([ids.cast(schema.field("id").type), pa.nulls(len(lists), schema.field("id").type)]),
                pa.array([pack(rank[d]) for d in docs] + [data for _, data in lists], pa.binary()),
            ],
            schema=schema,
        )


def _encode_shard(messages: pa.Table, path: str) -> pa.Table:
    """Each distinct word of a shard encoded once, and the answer to every block that sent it."""
    encode, known, out = _merges(path).encode_ordinary, {}, []
    for data in messages["data"].to_pylist():
        rank, size, flat = unpack(data)
        flat, end = flat.tobytes(), np.cumsum(size)
        found = []
        for a, b in zip((end - size).tolist(), end.tolist(), strict=True):
            word = flat[a:b]
            ids = known.get(word)
            if ids is None:
                ids = known[word] = encode(word.decode())
            found.append(ids)
        length = np.fromiter(map(len, found), np.uint32, len(found))
        out.append(pack(rank, length, np.array([i for ids in found for i in ids], np.uint32)))
    return pa.table({"block": messages["block"], "data": pa.array(out, pa.binary())})


def _bytes_of(ids: np.ndarray, table: pa.Array) -> bytes:
    """The bytes of token ids, in order."""
    found = table.take(pa.array(ids))
    if found.null_count:
        raise ValueError("a token id without bytes")
    end = int(np.frombuffer(found.buffers()[1], np.int64)[len(found)]) if len(found) else 0
    return found.buffers()[2].to_pybytes()[:end] if end else b""


def _assemble(docs: pa.Table, answers: pa.Table, kind: pa.DataType, path: str | None) -> pa.Table:
    """The ids of a block's documents, by position; with a path also their bytes."""
    parts = [unpack(a) for a in answers["data"].to_pylist()]
    words = sum(len(p[0]) for p in parts)
    start, size = np.zeros(words, np.int64), np.zeros(words, np.int64)
    flat, base = [], 0
    for rank, length, ids in parts:
        size[rank] = length
        start[rank] = base + np.cumsum(length) - length
        flat.append(ids)
        base += len(ids)
    flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
    out, back = [], []
    for data in docs["data"].to_pylist():
        at = unpack(data)[0]
        ids = gather(flat, start[at], size[at]).astype("<u4")
        out.append(ids.tobytes())
        if path:
            back.append(_bytes_of(ids, _token_bytes(path)))
    table = {"id": docs["id"].cast(kind), "ids": pa.array(out, pa.binary())}
    if path:
        table["decoded"] = pa.array(back, pa.binary())
    return pa.table(table)


def encoded(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    decode: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """id_col and ids, the token ids as little-endian unsigned 32-bit numbers, one row per row of ``docs``.

    With ``decode`` there is a third column, decoded, as ``decoded`` makes it
    from the ids: in the task that has them, so that they need not move.

    Texts are split by ``pattern`` into pre-tokens, each merged by the ranks
    in ``path``, without special tokens. Pre-tokens stand as positions in
    their block's list of distinct ones; the lists go to shards by a hash of
    the word, where each distinct word is encoded once; the ids come back to
    the block and are put in the order of the positions. The positions are
    written once, bucketed by block, and do not shuffle.

    Null and empty texts have no ids. Null ids and repeated rows keep a row
    each, for no step joins on the id. No rows give no rows. Other columns
    are not looked at. A text is held as a whole in one task, together with
    no others if it is above the block size.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shards = SHARDS_PER_PARTITION * partitions(spark)
    id_type = to_arrow_type(rows.schema["id"].dataType)
    schema = pa.schema(
        [("kind", pa.string()), ("block", pa.int64()), ("shard", pa.int32()), ("id", id_type), ("data", pa.binary())]
    )
    sent = rows.mapInArrow(lambda batches: _pretokens(batches, pattern, shards, schema, block_bytes), STAGED.format(id=f"id {kind}"))
    staged = stored_by(sent, "pretokens", "block", "kind")
    words = staged.where("kind = 'word'").select("shard", "block", "data")
    answers = words.groupBy("shard").applyInArrow(lambda t: _encode_shard(t, path), "block long, data binary")
    positions = staged.where("kind = 'doc'").select("block", "id", "data")
    return (
        positions.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            lambda d, a: _assemble(d, a, id_type, path if decode else None),
            f"id {kind}, ids binary" + (", decoded binary" if decode else ""),
        )
        .withColumnRenamed("id", id_col)
    )


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, ids and decoded, the bytes of the ids in order by the token-byte table of ``path``.

    The table has one row a token, a size fixed by the vocabulary file. An id
    outside it is an error. Null ids columns give null.
    """
    kind = tokens.schema[id_col].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(path)
        for batch in batches:
            rows = batch.column("ids").to_pylist()
            out = [None if ids is None else _bytes_of(np.frombuffer(ids, "<u4"), table) for ids in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("ids"), pa.array(out, pa.binary())], ["id", "ids", "decoded"]
            )

    rows = tokens.select(F.col(id_col).alias("id"), "ids")
    return rows.mapInArrow(join, f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_col)


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Digests of the ids and of the bytes decoded from them: id_col, n_tokens, ids_sha256, decoded_sha256."""
    both = encoded(docs, path, pattern, id_col, text_col, True, block_bytes)
    return both.select(
        id_col,
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
