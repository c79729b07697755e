"""Nearest neighbours against all cosines; whitening against numpy's own decomposition."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthcast.llm import neighbours, whitening
from monthcast.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")
FIELDS = "vec_id long, embedding array<float>, label int, id string, v string, block int, rank int"


@pytest.fixture
def embeddings(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "x", "y", 2, 3) for r in rows], FIELDS)


def odd(dims):
    return [(1000, None), (1050, [None] * dims), (1100, [0.0] * dims), (1150, [NAN] + [1.0] * (dims - 1)),
            (1200, [INF] * dims), (1250, []), (1300, [1.0] * (dims + 1)), (1350, [-INF] + [0.0] * (dims - 1))]


def cosines(rows, dims):
    """{query: [(vec_id, score)]}, nearest first, over the usable rows."""
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == dims and None not in v]
    use = [(i, v) for i, v in use if np.isfinite(v).all() and v.any()]
    out = {}
    for i, v in use:
        if i % 50 == 0:
            near = [(j, float((v * w).sum() / np.sqrt((v * v).sum() * (w * w).sum()))) for j, w in use if j != i]
            out[i] = sorted(near, key=lambda x: (-x[1], x[0]))
    return out


def recall(got, want, k=5):
    """Share of the k nearest found; scores and order of what is returned are checked exactly."""
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {q for q, near in want.items() if near}
    hits = total = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        scores = dict(want[q])
        assert [r["rank"] for r in rows] == list(range(1, min(k, len(want[q])) + 1))
        assert [r.score for r in rows] == pytest.approx([scores[r.vec_id] for r in rows], abs=1e-14)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits += sum(r.score >= want[q][len(rows) - 1][1] - 1e-14 for r in rows)
        total += len(rows)
    return hits / max(1, total)


@pytest.mark.parametrize("dims", [1, 2, 3, 64])
def test_neighbours(embeddings, dims):
    dice = np.random.default_rng(dims)
    near = dice.standard_normal(dims)
    data = [(i, dice.standard_normal(dims).tolist()) for i in range(400)]
    data += [(i, (near + 0.01 * dice.standard_normal(dims)).tolist()) for i in range(400, 700)]  # one dense group
    data += [(i, [1e30] * dims) for i in range(700, 720)] + odd(dims)  # equal rows, large numbers
    got = neighbours.nearest(embeddings(data).repartition(5), F.col("vec_id") % 50 == 0, block_rows=90).collect()
    assert recall(got, cosines([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in data], dims)) >= 0.98
    if dims == 64:
        ties = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 700]
        assert ties == [701, 702, 703, 704, 705]


def test_bounds_decide_what_is_reranked():
    """Estimates err by about as much as their bounds say, and a bound of no width loses neighbours."""
    dice = np.random.default_rng(2)
    v, q = dice.standard_normal((3000, 64)), dice.standard_normal((50, 64))
    centre, turn = neighbours.unit(v).mean(axis=0), neighbours.rotation(64, 1)
    bits, size, aligned, shift = neighbours.encode(v, centre, turn)
    rest = neighbours.unit(q) - centre
    likely = (rest @ turn.T) @ np.where(bits, 1, -1).T / 8 * size / aligned + shift + (neighbours.unit(q) @ centre)[:, None] - centre @ centre
    true = neighbours.unit(q) @ neighbours.unit(v).T
    one = np.sqrt((rest**2).sum(axis=1))[:, None] * size * neighbours.error(aligned, 64, 1)
    off = np.abs(likely - true) / one
    assert 0.9 < np.sqrt((off**2).mean()) < 1.1
    assert (off > 2.5).mean() < 0.02


def test_few_and_repeated_rows(embeddings):
    ask = F.col("vec_id") % 50 == 0
    assert neighbours.nearest(embeddings([]), ask).count() == 0
    assert neighbours.nearest(embeddings([(0, [1.0, 2.0])]), ask).count() == 0
    got = neighbours.nearest(embeddings([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (3, [2.0, 4.0]), (3, [2.0, 4.0]), (None, [1.0, 2.0])]), ask)
    assert [(r.query_id, r["rank"], r.vec_id) for r in got.orderBy("rank").collect()] == [(0, 1, 3), (0, 2, 3)]


def test_neighbours_query(spark):
    sf = "/root/testdata/sf0.1"
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert recall(QUERIES["op11_nearest_neighbours"](spark, sf).collect(), cosines(data, 64)) >= 0.98


@pytest.mark.parametrize("kind", ["random", "graded", "equal", "rank one", "diagonal", "zero"])
def test_spectrum(kind):
    dice = np.random.default_rng(4)
    turn = np.linalg.qr(dice.standard_normal((30, 30)))[0]
    values = {
        "random": dice.random(30), "graded": 10.0 ** -np.linspace(0, 12, 30), "equal": np.r_[np.ones(12), np.full(18, 0.5)],
        "rank one": np.r_[1, np.zeros(29)], "diagonal": dice.random(30), "zero": np.zeros(30),
    }[kind]
    a = np.diag(values) if kind == "diagonal" else turn @ np.diag(values) @ turn.T
    got, x = whitening.spectrum(a)
    assert got == pytest.approx(np.sort(values)[::-1], abs=1e-13)
    assert np.abs(x.T @ x - np.eye(30)).max() < 1e-13 and np.abs((a + a.T) / 2 @ x - x * got).max() < 1e-13


def test_polar_factor():
    dice = np.random.default_rng(5)
    a = dice.standard_normal((20, 20))
    a = a + a.T
    values, x = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - x @ np.diag(np.sign(values)) @ x.T).max() < 1e-13


def check_whitened(got, data, dims, components):
    use = [(i, np.array(v, float)) for i, v in data if v is not None and len(v) == dims and None not in v]
    use = [(i, v) for i, v in use if np.isfinite(v).all()]
    x = np.array([np.floor(64 * v).astype(np.int64) + 1000000 for _, v in use])
    n, total = len(x), x.sum(axis=0)
    y = (x - total / n).astype(float)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    rows = {(r.vec_id, r.component): r for r in got}
    assert len(got) == n * components
    faults = {r.identity_error for r in got}
    assert len(faults) == 1 and faults.pop() < 1e-9
    for c in range(components):
        w = np.array([rows[i, c + 1].whitened for i, _ in use])
        want = y @ vectors[:, c] / np.sqrt(values[c])
        assert np.abs(w * np.sign(w @ want) - want).max() < 1e-8
        assert rows[use[0][0], c + 1].explained == pytest.approx(values[c] / values.sum(), rel=1e-10)
        assert [rows[i, c + 1].deviation for i, _ in use] == deviation
        assert {rows[i, c + 1].n for i, _ in use} == {n}


def test_whitened(embeddings):
    dice = np.random.default_rng(6)
    data = [(i, (dice.standard_normal(5) * [9, 5, 3, 2, 1] + 4).astype(np.float32).tolist()) for i in range(300)]
    data += odd(5)
    check_whitened(whitening.whitened(embeddings(data).repartition(4)).collect(), data, 5, 5)


def test_whitened_edge_rows(embeddings):
    assert whitening.whitened(embeddings([])).count() == 0
    assert whitening.whitened(embeddings([(1, [1.0, 2.0])] * 3)).count() == 0  # no variance
    line = whitening.whitened(embeddings([(None, [0.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])])).collect()  # one direction
    assert sorted((r.vec_id is None, r.component, round(abs(r.whitened), 6), r.deviation) for r in line) == [
        (False, 1, 0.707107, 8192), (False, 1, 0.707107, 8192), (True, 1, 1.414214, 32768)]
    far = whitening.whitened(embeddings([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [5.0, 2.0])])).collect()
    assert {r.deviation for r in far if r.vec_id < 3} == {None}


def test_exact_deviation():
    fit = whitening.Fit(3, [10**15 + 1, 7], np.eye(2))
    x = np.array([[2**49, 5], [3, 4]])
    want = [sum((3 * int(a) - s) ** 2 for a, s in zip(r, fit.sums, strict=True)) for r in x]
    assert whitening._deviations(fit)(x) == [w if w < 1 << 63 else None for w in want]
    assert fit.centre == [round(Fraction(s, 3)) for s in fit.sums]


def test_whitened_query(spark):
    sf = "/root/testdata/sf0.001"
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitened(QUERIES["op12_whitened_embeddings"](spark, sf).collect(), data, 64, 32)
