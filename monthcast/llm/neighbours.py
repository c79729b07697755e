"""Nearest neighbours by cosine: randomly rotated one-bit codes, error bounds, reranking on the original vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthcast.llm.tables import bounded_batches, partitions, stored
from monthcast.llm.vectors import dimension, finite, matrix

#: Neighbours of a query.
NEAREST = 5
#: Standard deviations of an estimate that its error bound covers.
DEVIATIONS = 3.0
#: Bytes of single-precision components in a block of rows, and the fewest rows of a block.
BLOCK_BYTES = 32 << 20
LEAST_ROWS = 1024
#: Rows reranked for each query and block before bounds are used.
FIRST = 16
#: Queries estimated at once, and pairs reranked at once.
QUERIES = 64
PAIRS = 1 << 15
SEED = 11

MESSAGE = "block int, kind int, id long, vector binary, code binary, size double, aligned double, shift double"


@lru_cache(maxsize=2)
def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that no square overflows and no cosine changes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last, so that any engine can restate them."""
    return np.cumsum(a * b, axis=1)[:, -1]


def unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length 1."""
    v = scaled(v)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def encode(v: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bits and correction scalars of each vector: (bits, size, aligned, shift).

    The unit vector less the centre has length ``size``; its direction is
    rotated and keeps one bit a component. ``aligned`` is the inner product
    of the direction with the corner its bits name, ``shift`` that of the
    unit vector with the centre.
    """
    u = unit(v)
    rest = u - centre
    size = np.sqrt((rest * rest).sum(axis=1))
    turned = rest @ turn.T / np.where(size > 0, size, 1)[:, None]
    bits = turned > 0
    aligned = np.abs(turned).sum(axis=1) / np.sqrt(v.shape[1])
    return bits, size, np.where(size > 0, aligned, 1), u @ centre


def error(aligned: np.ndarray, dims: int, deviations: float) -> np.ndarray:
    """Bound of the error of an estimated inner product of two directions."""
    return deviations * np.sqrt(np.maximum(1 - aligned**2, 0) / aligned**2 / max(1, dims - 1))


class Block:
    """Rows of the index held by one task: codes, scalars and original vectors."""

    def __init__(self, rows: pa.Table, dims: int, deviations: float):
        rows = rows.combine_chunks()
        number = lambda k: rows[k].to_numpy().astype(np.float32)
        self.id = rows["id"].to_numpy()
        self.vector = scaled(_binary(rows["vector"], np.float64, dims))
        self.square = dots(self.vector, self.vector)
        bits = np.unpackbits(_binary(rows["code"], np.uint8, (dims + 7) // 8), axis=1, count=dims)
        self.sign = np.where(bits, np.float32(1), np.float32(-1))
        size, aligned = number("size"), rows["aligned"].to_numpy()
        self.scale = size / (aligned * np.sqrt(dims)).astype(np.float32)
        self.shift = number("shift")
        self.reach = size * error(aligned, dims, deviations).astype(np.float32) + np.float32(1e-5)

    def nearest(self, queries: pa.Table, centre: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Query id, and ids and cosines of the nearest rows of the block, nearest first."""
        dims = len(centre)
        ids = queries["id"].to_numpy()
        vector = scaled(_binary(queries["vector"], np.float64, dims))
        turned = _binary(queries["code"], np.float32, dims)
        size, shift = (queries[c].to_numpy().astype(np.float32) for c in ("size", "shift"))
        base = self.shift - np.float32(centre @ centre)
        for low in range(0, len(ids), QUERIES):
            at = slice(low, low + QUERIES)
            n = len(ids[at])
            likely = turned[at] @ self.sign.T * (size[at, None] * self.scale) + base + shift[at, None]
            likely[ids[at][:, None] == self.id] = -np.inf
            top = np.argpartition(-likely, min(FIRST + k, likely.shape[1]) - 1, axis=1)[:, : FIRST + k]
            q, r = np.repeat(np.arange(n), top.shape[1]), top.reshape(-1)
            exact = np.where(np.isfinite(likely[q, r]), self._exact(vector[at], q, r), -np.inf).reshape(n, -1)
            # No row whose upper bound lies below the k-th best cosine so far can be among the k nearest.
            least = -np.sort(-exact, axis=1)[:, k - 1] if exact.shape[1] >= k else np.full(n, -np.inf)
            may = likely + size[at, None] * self.reach >= least[:, None]
            np.put_along_axis(may, top, True, axis=1)
            q, r = np.nonzero(may & np.isfinite(likely))
            score = self._exact(vector[at], q, r)
            order = np.lexsort((self.id[r], -score, q))
            q, r, score = q[order], r[order], score[order]
            edge = np.searchsorted(q, np.arange(n + 1))
            for i in range(n):
                own = slice(edge[i], min(edge[i] + k, edge[i + 1]))
                yield int(ids[low + i]), self.id[r[own]], score[own]

    def _exact(self, vector: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Cosines of vectors q with rows r."""
        square, out = dots(vector, vector), np.zeros(len(q))
        for i in range(0, len(q), PAIRS):
            a, b = q[i : i + PAIRS], r[i : i + PAIRS]
            out[i : i + PAIRS] = dots(vector[a], self.vector[b]) / np.sqrt(square[a] * self.square[b])
        return out


def _binary(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def nearest(
    rows: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = NEAREST,
    deviations: float = DEVIATIONS,
    block_rows: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of largest cosine with each query row, ties to the smaller id.

    1. Every unit vector less the mean of all is rotated at random and keeps
       one bit a component, with three scalars that correct its estimates.
    2. Rows go to blocks by a hash of the id, at most BLOCK_BYTES each; a
       query goes to every block. A task reads one block, then the queries
       in batches, in order, so it never holds more than a block and a batch.
    3. In a block, inner products are estimated from the bits. The cosines
       of the best few give a bound; every row whose estimate plus its error
       bound reaches it is reranked on the original vectors, in double
       precision. The block returns k rows a query.
    4. The best k over all blocks.

    A row among the k nearest is missed only if its estimate errs by more
    than ``deviations`` standard deviations (0.13 % at 3). Codes, blocks
    and bounds are the same at every size; there is no list of cells to
    probe and no cap on what is reranked. Every query meets every row's code,
    in blocks: the work is queries times rows.

    Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, nor do rows with a null id or with another length than the
    most frequent one (of equally frequent ones the longest). A query is no
    candidate of itself, nor is any row with its id. Queries repeated with
    one id count once, by their smallest vector; repeated candidates count
    each. No queries or no candidates give no rows. Other columns are not
    looked at. A null ``is_query`` is false.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    vector = F.col(vector_col)
    used = rows.where(F.col(id_col).isNotNull() & finite(vector) & F.exists(vector, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("id"), vector.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    dims = dimension(used, "v")
    used = used.where(F.size("v") == dims)
    centre, count = _mean(used, dims)
    wanted = min(partitions(spark), -(-count // LEAST_ROWS))
    blocks = max(1, wanted, -(-count // (block_rows or max(1, BLOCK_BYTES // (4 * max(1, dims))))))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), dims)
            bits, *scalars = encode(v, centre, rotation(dims, seed))
            yield _message(batch, v, _bytes(np.packbits(bits, axis=1)), scalars, 0)

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), dims)
            turn = rotation(dims, seed)
            scalars = encode(v, centre, turn)[1:]
            rest = unit(v) - centre
            turned = rest @ turn.T / np.where(scalars[0] > 0, scalars[0], 1)[:, None]
            yield _message(batch, v, _bytes(turned.astype(np.float32)), scalars, 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, block = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            key = table["block"].to_numpy().astype(np.int64) * 2 + table["kind"].to_numpy()
            edge = np.flatnonzero(np.diff(key)) + 1
            for a, b in zip(np.r_[0, edge], np.r_[edge, len(key)], strict=True):
                if a == b:
                    continue
                part = table.slice(a, b - a)
                if key[a] >> 1 != number:
                    number, held, block = key[a] >> 1, [], None
                if not key[a] & 1:
                    held.append(part)
                    continue
                if held:
                    block, held = Block(pa.concat_tables(held), dims, deviations), []
                if block is None:
                    continue  # no row of the index came to this block
                found = list(block.nearest(part.combine_chunks(), centre, k))
                size = [len(f[1]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([f[0] for f in found], size).astype(np.int64)),
                        pa.array(np.concatenate([f[1] for f in found])),
                        pa.array(np.concatenate([f[2] for f in found])),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    asked = used.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    every = asked.mapInArrow(queries, MESSAGE).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = used.select("id", "v").mapInArrow(index, MESSAGE).withColumn("block", own).unionByName(every)
    each = both.repartitionById(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(scan, "query_id long, vec_id long, score double")
    each = stored(each, "neighbours")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _message(batch: pa.RecordBatch, v: np.ndarray, code: pa.Array, scalars: list[np.ndarray], kind: int) -> pa.RecordBatch:
    n = len(v)
    columns = [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, kind, np.int32)), batch.column("id"), _bytes(v), code]
    return pa.RecordBatch.from_arrays([*columns, *map(pa.array, scalars)], [f.split()[0] for f in MESSAGE.split(", ")])


def _mean(used: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """Mean of the unit vectors and their number. Every task sums its rows; the driver gets one row a dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims), 0
        for batch in batches:
            total, n = total + unit(matrix(batch.column("v"), dims)).sum(axis=0), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(total), pa.array(np.full(dims, n))], ["d", "s", "n"])

    found = used.select("v").mapInArrow(sums, "d long, s double, n long").groupBy("d").agg(F.sum("s"), F.sum("n")).collect()
    out, count = np.zeros(dims), 0
    for d, s, n in found:
        out[d], count = s / n, n
    return out, count
