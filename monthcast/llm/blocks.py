"""Messages between blocks of documents and shards of a key space.

A block is a run of documents of a task, at most ``BLOCK_BYTES`` of text. Where a value per token has to be looked up, a block sends each shard
one row with the distinct keys it has there, and gets one row back; so a key
that a third of all tokens share travels once a block. Shards never hold more
than one copy of a key from each block, and their number follows the number
of shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

from monthcast.llm.words import chunks, texts

BLOCK_BYTES = 16 << 20
#: Made once a worker: a worker runs one task at a time.
_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in compressed form. Bytes of the same rank stand together, so small numbers cost little."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(f"{a.dtype.str}:{len(a)};".encode())
        out.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return _COMPRESSOR.compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = _DECOMPRESSOR.decompress(data), 0, []
    while at < len(raw):
        end = raw.index(b";", at)
        kind, count = raw[at:end].decode().split(":")
        kind, count, at = np.dtype(kind), int(count), end + 1
        size = kind.itemsize * count
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, count)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return out


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Table, list[bytes]]]:
    """Number of each block, the other columns of its rows, and its texts.

    Rows are gathered until their texts reach the block size. Numbers are
    unique in a job; a task that runs again makes the same numbers for the
    rows it then reads, and its rows replace those of the lost attempt
    together.
    """
    number = TaskContext.get().partitionId() << 32
    held, rows, size = [], [], 0
    for batch in batches:
        rest = pa.Table.from_batches([batch]).drop_columns(["text"])
        for first, part in chunks(texts(batch.column("text"))):
            more = sum(map(len, part))
            if rows and size + more > most:
                yield number, pa.concat_tables(held).combine_chunks(), rows
                number, held, rows, size = number + 1, [], [], 0
            held.append(rest.slice(first, len(part)))
            rows += part
            size += more
    if rows:
        yield number, pa.concat_tables(held).combine_chunks(), rows


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + size] one after the other."""
    total = int(size.sum())
    shift = start - (np.cumsum(size) - size)
    return flat[np.repeat(shift, size) + np.arange(total)]


def split(key: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number of each part that occurs in ``key`` and the places where it does, in order."""
    order = np.argsort(key, kind="stable")
    bound = np.searchsorted(key[order], np.arange(parts + 1))
    for part in range(parts):
        if bound[part] < bound[part + 1]:
            yield part, order[bound[part] : bound[part + 1]]
