"""Embedding whitening: covariance in one distributed pass, components by spectral divide and conquer with polar factors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthcast.llm.tables import bounded_batches
from monthcast.llm.vectors import dimension, finite, matrix

#: Components returned at most.
COMPONENTS = 32
#: Entry c becomes floor(SCALE * c) + OFFSET.
SCALE = 64
OFFSET = 1_000_000
#: Components with a smaller share of the largest eigenvalue are rounding noise.
NOISE = 1e-11

EPS = np.finfo(np.float64).eps
OUTPUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley iterations on QR factors.

    The weights follow a lower bound of the smallest singular value, which
    grows to 1 in six or seven steps even from 1e-16.
    """
    n = len(a)
    x = a / np.linalg.norm(a, 1)  # no singular value of a symmetric matrix is larger than its 1-norm
    try:
        low = max(1 / np.linalg.norm(np.linalg.inv(x), 1), EPS)
    except np.linalg.LinAlgError:
        low = EPS
    eye = np.eye(n)
    for _ in range(30):
        d = (4 * (1 - low**2) / low**4) ** (1 / 3) if low < 1 else 0.0
        s = np.sqrt(1 + d)
        p = s + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * s))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:  # a QR factor where the weights are large, else a Cholesky factor
            both = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))[0]
            step = (p - q / r) / np.sqrt(r) * both[:n] @ both[n:].T
        else:
            half = np.linalg.solve(np.linalg.cholesky(eye + r * x.T @ x), x.T)
            step = (p - q / r) * np.linalg.solve(np.linalg.cholesky(eye + r * x.T @ x).T, half).T
        after = q / r * x + step
        after = (after + after.T) / 2
        low = min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        done = np.linalg.norm(after - x) <= (4 * EPS) ** (1 / 3) and 1 - low < 1e-8
        x = after
        if done:
            break
    return x


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    The polar factor U of the shifted matrix gives the projector (U + I) / 2
    on the space of the eigenvalues above the shift. Bases of it and of its
    complement split the matrix into two smaller ones, and so on down to
    single components. One correction of the whole at the end restores the
    digits lost on the way.
    """
    a = (a + a.T) / 2
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    scale = np.linalg.norm(a)
    vectors = _split(a, scale, np.eye(len(a))) if scale > 0 else np.eye(len(a))
    for _ in range(2):
        vectors = np.linalg.qr(_sorted(a, _refined(a, vectors))[1])[0]  # from the largest eigenvalue on
    return _sorted(a, vectors)


def _sorted(a: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _split(a: np.ndarray, scale: float, basis: np.ndarray) -> np.ndarray:
    """Eigenvectors of basis^T A basis, as combinations of the columns of the basis."""
    n = len(a)
    rest = a - np.diag(np.diag(a))
    if n == 1 or np.linalg.norm(rest) <= n * EPS * scale:
        return basis
    # Shifts that leave about half of the eigenvalues on either side; all of one diagonal: by the size of the rest.
    centre = np.sort(np.diag(a))
    tries = [np.median(centre), centre.mean(), np.trace(a) / n]
    spread = np.linalg.norm(rest) / np.sqrt(n)
    tries += [tries[0] + f * spread for f in (0.5, -0.5, 0.1, -0.1, 0.9, -0.9, 0.02, -0.02)]
    for shift in tries:
        moved = a - shift * np.eye(n)
        if np.linalg.norm(moved) <= n * EPS * scale:
            continue
        projector = (polar(moved) + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n:
            continue
        # An orthogonal basis of the projector's range, and of what is left.
        q = np.linalg.qr(projector @ np.random.default_rng(n).standard_normal((n, n)))[0]
        q = np.linalg.qr(np.hstack([projector @ q[:, :rank], q[:, rank:] - projector @ q[:, rank:]]))[0]
        inner = q.T @ a @ q
        if np.linalg.norm(inner[:rank, rank:]) > 100 * n * EPS * scale:
            continue
        parts = [(inner[:rank, :rank], q[:, :rank]), (inner[rank:, rank:], q[:, rank:])]
        return np.hstack([_split((m + m.T) / 2, scale, basis @ own) for m, own in parts])
    return basis  # eigenvalues that cannot be told apart: any basis of their space


def _refined(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Eigenvectors with their first-order error taken off, where eigenvalues differ enough to tell it."""
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ a @ x
    values = np.diag(s) / (1 - np.diag(r))
    gap = values[None, :] - values[:, None]
    noise = 2 * np.linalg.norm(s - np.diag(values)) + 2 * EPS * np.linalg.norm(a)
    apart = np.abs(gap) > 10 * noise
    fix = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    np.fill_diagonal(fix, np.diag(r) / 2)
    return x + x @ fix


class Fit:
    """Sums of all x-vectors: their number, per-dimension sums, and the covariance of x."""

    def __init__(self, n: int, sums: list[int], products: np.ndarray):
        self.n = n
        self.sums = sums
        #: Whole number next to each mean; x less this is small, so products of it are exact.
        self.centre = [_centre(s, n) for s in sums]
        self.rest = [s - n * c for s, c in zip(sums, self.centre, strict=True)]  # at most n / 2
        off = np.array([r / n for r in self.rest]) if n else np.zeros(0)
        self.off = off
        self.covariance = products / n - np.outer(off, off) if n else products

    def weights(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns that whiten, and each component's share of the trace."""
        values, vectors = spectrum(self.covariance)
        keep = np.flatnonzero(values > NOISE * max(values.max(initial=0), 0))[:most]
        trace = np.trace(self.covariance)
        return vectors[:, keep] / np.sqrt(values[keep]), values[keep] / trace if len(keep) else np.zeros(0)


def _centre(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def _whole(v: np.ndarray) -> np.ndarray:
    """x of every entry, of entries beyond 2 ** 49 that bound."""
    return np.clip(np.floor(SCALE * v), -(2.0**49), 2.0**49).astype(np.int64) + OFFSET


def _summed(
    used: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray], name: str = "double"
) -> dict[tuple[int, int], float]:
    """Sums over all rows of the entries of ``of(x)``, a matrix for each batch of x-vectors, as {(row, column): sum}.

    Every task adds up its batches and sends one row an entry. Whole numbers
    are added by Spark, as decimals.
    """

    def rows(total: np.ndarray) -> pa.RecordBatch:
        i, j = (k.reshape(-1) for k in np.indices(total.shape))
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.reshape(-1))], ["i", "j", "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                more = of(_whole(matrix(batch.column("v"), dims)))
                if name == "long":
                    yield rows(more)
                else:
                    total = more if total is None else total + more
        if total is not None:
            yield rows(total)

    kind = "decimal(38,0)" if name == "long" else name
    found = used.select("v").mapInArrow(add, f"i long, j long, s {name}").groupBy("i", "j").agg(F.sum(F.col("s").cast(kind))).collect()
    return {(r[0], r[1]): r[2] for r in found}


def _dense(found: dict[tuple[int, int], float], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for (i, j), s in found.items():
        out[i, j] = s
    return out


def whitened(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """id_col, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    Entry c of a vector becomes x = floor(64 * c) + 1000000 (beyond 2 ** 49
    before the addition, that bound). Two passes over
    all rows: sums of x, then products of x less the whole number next to
    its mean. Those are small whole numbers, so their sums are exact in any
    order, and what the mean differs from that number is taken off in the
    end. Only sums reach the driver: one row for each pair of dimensions,
    whatever the number of rows. There, the covariance is split by polar
    factors into components; the weights, dimensions times ``components``
    numbers, go to all tasks with the function that applies them. A third
    pass measures the covariance of the result, a fourth returns it.

    ``deviation`` is the exact sum of (n * x - S) ** 2 over the dimensions,
    null where it does not fit in a long. ``identity_error`` is the largest
    absolute entry of the result's covariance less the identity. Components
    whose eigenvalue is below 1e-11 of the largest have no variance to scale
    and are not returned: fewer rows than dimensions or constant dimensions
    give fewer components, equal vectors none.

    Vectors that are null, empty, or hold null or non-finite entries are
    left out, and so are those of another length than the most frequent one
    (of equally frequent ones the longest). Null and repeated ids pass
    through; repeated rows count each. Zero vectors count. No rows give no
    rows. Other columns are not looked at. Dimensions are bounded by what a
    driver can decompose: some thousands.
    """
    bounded_batches(rows.sparkSession)
    vector = F.col(vector_col)
    used = rows.where(finite(vector)).select(F.col(id_col).alias("id"), vector.cast("array<double>").alias("v"))
    dims = dimension(used, "v")
    used = used.where(F.size("v") == dims)
    fit = fitted(used, dims)
    weights, share = fit.weights(components)
    n, width = fit.n, len(share)
    centre, off = np.array(fit.centre, np.int64), fit.off

    def apply(x: np.ndarray) -> np.ndarray:
        return ((x - centre).astype(np.float64) - off) @ weights

    def products(x: np.ndarray) -> np.ndarray:
        w = apply(x)
        return w.T @ w

    fault = np.abs(_dense(_summed(used, dims, products), width) / n - np.eye(width)).max() if width else 0.0
    deviations, key = _deviations(fit), rows.schema[id_col].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows if width else 0, 2048):
                part = batch.slice(low, 2048)
                x = _whole(matrix(part.column("v"), dims))
                count = len(x)
                again = pa.array(np.repeat(np.arange(count), width))
                columns = [
                    part.column("id").take(again),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * width, n)),
                    pa.array(deviations(x), pa.int64()).take(again),
                    pa.array(apply(x).reshape(-1)),
                    pa.array(np.tile(share, count)),
                    pa.array(np.full(count * width, fault)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", *(f.split()[0] for f in OUTPUT.split(", "))])

    return used.mapInArrow(project, f"id {key}, {OUTPUT}").withColumnRenamed("id", id_col)


def fitted(used: DataFrame, dims: int) -> Fit:
    """Sums and covariance of the vectors in column v."""

    def totals(x: np.ndarray) -> np.ndarray:
        return np.vstack([x.sum(axis=0), np.full(dims, len(x))])

    first = _summed(used, dims, totals, "long")
    n = int(first.get((1, 0), 0))
    sums = [int(first[0, d]) for d in range(dims)] if n else []
    centre = np.array([_centre(s, n) for s in sums], np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - centre).astype(np.float64)
        return y.T @ y

    return Fit(n, sums, _dense(_summed(used, dims, products), dims) if n else np.zeros((0, 0)))


def _deviations(fit: Fit) -> Callable[[np.ndarray], list[int | None]]:
    """For rows of x, the exact sum of (n * x - S) ** 2, or null beyond a long."""
    n, centre = fit.n, np.array(fit.centre, np.int64)
    rest, tail = np.array(fit.rest, np.int64), sum(r * r for r in fit.rest)

    def of(x: np.ndarray) -> list[int | None]:
        y = x - centre
        large = int(np.abs(y).max(initial=0))
        if large * max(large, n) * max(1, y.shape[1]) >= 1 << 62:
            y, own = y.astype(object), rest.astype(object)
        else:
            own = rest
        square, cross = (y * y).sum(axis=1).tolist(), (y * own).sum(axis=1).tolist()
        out = [n * n * int(a) - 2 * n * int(b) + tail for a, b in zip(square, cross, strict=True)]
        return [v if v < 1 << 63 else None for v in out]

    return of
