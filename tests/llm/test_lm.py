"""Scores against a dictionary of n-grams; the Elias-Fano sequences against plain arrays."""

import os
import re
import tempfile
import time
import zlib
from collections import Counter
from math import log10
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthcast.llm import elias_fano, lm
from monthcast.llm.elias_fano import EliasFano, Level
from monthcast.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")
END = None


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


def brute(rows, order):
    """rows: (id, text, learnt from). Base score, score, tokens and known tokens of each."""
    one, grams, after = Counter(), Counter(), {}
    for _, text, train in rows:
        t = tokens(text)
        if train:
            one.update(t)
            full = [END, *t]
            for n in range(2, order + 1):
                for i in range(len(full) - n + 1):
                    gram = tuple(full[i : i + n])
                    grams[n, gram] += 1
                    after.setdefault((n, gram[:-1]), set()).add(gram[-1])
    total, kinds = sum(one.values()), len(one)
    context = Counter()
    for (n, gram), c in grams.items():
        context[n, gram[:-1]] += c
    out = {}
    for key, text, _ in rows:
        t = tokens(text)
        full = [END, *t]
        base = score = 0.0
        for at, w in enumerate(t, 1):
            p = (one[w] + 1) / (total + kinds + 1)
            base += log10(p)
            for n in range(2, order + 1):
                if at < n - 1:
                    continue
                history = tuple(full[at - n + 1 : at])
                c = context[n, history]
                if c:
                    times = grams[n, (*history, w)]
                    p = max(times - lm.DISCOUNT, 0) / c + lm.DISCOUNT * len(after[n, history]) / c * p
            score += log10(p)
        out[key] = (len(t), sum(one[w] > 0 for w in t), total, base, score)
    return out


def same(got, want):
    assert {r.doc_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=0.002, abs=0.01)  # probabilities are quantised


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, documents, order):
    data = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    data += [(1000, None), (1001, ""), (1002, "unseen Words only"), (1003, "the " * 4000)]
    rows = [(i, t, i % 3 != 1) for i, t in data]
    frame = documents(data).repartition(3)
    same(lm.scored(frame, F.col("doc_id") % 3 != 1, order).collect(), brute(rows, order))


def test_query_and_held_out(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op1_lm_scores"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_query_is_a_trigram_model(spark):
    sf = "/root/testdata/sf0.001"
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [(i, t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t in data]
    three, two = brute(rows, 3), brute(rows, 2)
    got = QUERIES["op1_lm_scores"](spark, sf).collect()
    assert {r.doc_id for r in got} == set(three) and len(got) == len(three)
    for r in got:
        n, known, total, base, score = three[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base, rel=1e-9)
        assert abs(r.score - score) < 0.001 * n  # a step of the quantised logarithms is under 0.001
    assert sum(abs(r.score - two[r.doc_id][-1]) > 0.1 * r.n_tokens for r in got) > len(got) / 4


def test_edge_rows(documents):
    got = lm.scored(documents([(None, "a"), (1, "a"), (1, "a")]), F.lit(None).cast("boolean")).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1 and not any(r.held_out for r in got)
    got = lm.scored(documents([(1, "a b")]), F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)]
    assert lm.scored(documents([]), F.lit(True)).count() == 0


@pytest.mark.parametrize(("n", "most"), [(1, 1), (1, 10**9), (10, 5), (1000, 10**6), (20_000, 10**11), (5000, 100)])
def test_sequences(tmp_path, n, most):
    dice = np.random.default_rng(n)
    values = np.sort(dice.integers(0, most, n))
    EliasFano.of(values).write(str(tmp_path), "x")
    e = EliasFano.open(str(tmp_path), "x")
    assert (e.at(np.arange(n)) == values).all()
    x = np.concatenate([dice.integers(0, most + 3, 500), values[:500], values[:500] + 1])
    assert (e.successor(x) == np.searchsorted(values, x)).all()


def test_level(tmp_path):
    dice = np.random.default_rng(5)
    context = np.unique(dice.integers(0, 10**6, 300))
    size = dice.integers(1, 40, len(context))
    first = np.concatenate([[0], np.cumsum(size)])
    follower = np.concatenate([np.sort(dice.choice(50, k, replace=False)) for k in size])
    Level.write(str(tmp_path), context, first, follower, np.ones(len(follower), np.uint8))
    level = Level.open(str(tmp_path))
    a, b = level.ranges(context)
    assert (a == first[:-1]).all() and (b == first[1:]).all()
    assert (level.find(a, b, size, follower) == np.arange(len(follower))).all()
    own = [set(follower[x:y].tolist()) for x, y in zip(a, b, strict=True)]
    want = [int(f) + 1 in own[i] for i, (x, y) in enumerate(zip(a, b, strict=True)) for f in follower[x:y]]
    assert ((level.find(a, b, size, follower + 1) >= 0) == want).all()
    a, b = level.ranges(context + 1)
    assert ((b > a) == np.isin(context + 1, context)).all()


def test_answers_meet_the_tokens_of_their_blocks_where_they_lie(spark):
    docs = spark.createDataFrame([(i, f"a b c {i % 3} d") for i in range(20)], "doc_id long, text string")
    plan = lm.scored(docs, F.lit(True))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_codes_travel_where_all_shares_of_a_shard_are_equal(spark):
    docs = spark.createDataFrame([(i, "x y") for i in range(5)], "doc_id long, text string")
    got = {round(r.score, 4) for r in lm.scored(docs, F.lit(True)).collect()}
    p = (5 + 1) / (15 + 3 + 1)
    two = (5 - lm.DISCOUNT) / 5 + lm.DISCOUNT / 5 * p
    three = (5 - lm.DISCOUNT) / 5 + lm.DISCOUNT / 5 * two
    assert got == {round(log10(two) + 2 * log10(three), 4)}


def test_numbers_are_sorted_together_with_their_places(monkeypatch):
    rng = np.random.default_rng(8)
    few, wide = rng.integers(-50, 1 << 36, 5000) // 7, rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2)
    for values in (few, np.repeat(wide, 2), np.array([5, -1, 5]), np.zeros(0, np.int64), np.array([-(1 << 63), (1 << 63) - 1])):
        found, at = lm._distinct(values)
        assert found.tolist() == np.unique(values).tolist() and (found[at] == values).all()
    monkeypatch.setattr(lm.pd, "factorize", lambda values: pytest.fail("a hash table of all tokens"))
    assert (lm._distinct(few)[0] == np.unique(few)).all()


def test_messages_hold_narrow_numbers():
    for values in ([], [0, 255], [256], [1 << 32]):
        sent = lm._small(np.array(values, np.int64))
        assert sent.tolist() == values and sent.dtype.itemsize == {255: 1, 256: 2, 1 << 32: 8}.get(max(values, default=255))
    assert lm._long([np.array([200], np.uint8), np.array([1 << 40], np.uint64)]).tolist() == [200, 1 << 40]


def test_long_sequences_are_searched_in_pieces(monkeypatch):
    values = np.cumsum(np.random.default_rng(9).integers(0, 9, 1000))
    asked = np.random.default_rng(10).integers(0, values[-1] + 5, 333)
    monkeypatch.setattr(elias_fano, "PIECE", 16)
    made = elias_fano.EliasFano.of(values)
    assert (made.at(np.arange(1000)) == values).all()
    assert (made.successor(asked) == np.searchsorted(values, asked)).all()


def shuffle_files(spark):
    """Shuffle files that the session's executors hold."""
    root = Path(os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", tempfile.gettempdir()))
    return set(root.glob("**/blockmgr-*/*/shuffle_*.data"))


def test_messages_of_a_level_go_when_its_answers_are_written(spark, documents):
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(12))) for i in range(40)]
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    kept = spark.range(1000).repartition(3, "id").persist()
    assert kept.count() == 1000
    held = shuffle_files(spark)
    assert held
    out = lm.scored(documents(rows), ~lm.held_out(F.col("doc_id")))
    for _ in range(40):  # files are removed in the background
        if not (left := shuffle_files(spark) - held):
            break
        time.sleep(0.25)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
    assert out.count() == out.count() == 40
    kept.unpersist()
