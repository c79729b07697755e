"""Periodic runs against every period at every place; the wavelet tree against sorting."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from monthcast.llm import periodic
from monthcast.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words, least=24, times=3):
    """{(start, end): smallest period} by comparing all words some distance apart, distance after distance."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return out


def made(dice, kinds):
    out = []
    for _ in range(dice.randint(1, 5)):
        part = [dice.randrange(kinds) for _ in range(dice.choice([1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 31, 32, 33]))]
        out += (part * dice.randint(1, 9))[: dice.randint(1, 200)]
        out += [dice.randrange(kinds) for _ in range(dice.randint(0, 20))]
    return out


def test_runs():
    dice, found = random.Random(3), 0
    for _ in range(300):
        words = made(dice, dice.choice([1, 2, 3, 5, 50]))
        start, end, period = periodic.runs(np.array(words, np.int64))
        want = brute(words)
        assert dict(zip(zip(start.tolist(), end.tolist(), strict=True), period.tolist(), strict=True)) == want
        assert sorted(zip(start.tolist(), period.tolist(), strict=True)) == list(zip(start.tolist(), period.tolist(), strict=True))
        found += len(want)
    assert found > 300


@pytest.mark.parametrize("least,times", [(24, 4), (40, 3)])
def test_other_limits(least, times):
    dice = random.Random(5)
    for _ in range(60):
        words = made(dice, 2)
        start, end, _ = periodic.runs(np.array(words, np.int64), least, times)
        assert set(zip(start.tolist(), end.tolist(), strict=True)) == set(brute(words, least, times))
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(30, np.int64), 8, 2)


def test_range_successor():
    dice = np.random.default_rng(1)
    values = dice.permutation(300)
    tree = periodic.WaveletTree(values)
    low = dice.integers(0, 300, 500)
    high = np.minimum(300, low + dice.integers(1, 40, 500))
    bound, limit = dice.integers(0, 700, 500), dice.integers(0, 700, 500)
    want = [min((v for v in values[a:b] if c <= v < d), default=-1) for a, b, c, d in zip(low, high, bound, limit, strict=True)]
    assert tree.successor(low, high, bound, limit).tolist() == want


def test_common_words_pass_the_longest_class():
    words = np.array([7] * 100 + [8] + [7] * 100)
    suffixes = periodic.Suffixes(words)
    i, j = np.array([0, 0, 50]), np.array([1, 101, 151])
    assert suffixes.common(i, j).tolist() == [99, 100, 50]
    assert suffixes.common(i + 3, j + 3, True).tolist() == [3, 3, 53]


def expected(doc, text):
    words = WORD.findall(text or "")
    runs = sorted((s, q, e) for (s, e), q in brute(words).items())
    gone = {i for s, q, e in runs for i in range(s + q, e)}
    listed = [(s, e - s, q) for s, q, e in runs]
    return len(words), listed, " ".join(w for i, w in enumerate(words) if i not in gone)


def rows():
    dice = random.Random(8)
    words = ["the", "of", "Ça", "a", "ß"]
    say = lambda k: " ".join(words[w] for w in made(dice, k))
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "x " * 23), (5, "x\n" * 24), (6, "a b " * 12 + "\v" + "c a " * 12)]
    out += [(i, say(dice.choice([1, 2, 5]))) for i in range(10, 60)] + [(60, "long " * 30000), (None, "n " * 30), (61, out[6][1])]
    dice.shuffle(out)
    return out


def test_texts(documents):
    data = rows()
    got = periodic.without_runs(documents(data).repartition(3)).collect()
    assert len(got) == len(data)
    for r in got:
        if r.doc_id != 60:
            assert (r.n_words, [tuple(x) for x in r.runs], r.text) == expected(r.doc_id, dict(data)[r.doc_id])
    long = next(r for r in got if r.doc_id == 60)
    assert ([tuple(x) for x in long.runs], long.text) == ([(0, 30000, 1)], "long")


def test_repeated_rows_and_no_rows(documents):
    got = periodic.without_runs(documents([(1, "x " * 30)] * 2)).collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, "x")] * 2
    assert periodic.digests(periodic.without_runs(documents([]))).count() == 0


def replaced(doc, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if h % 10 or not n:
        return text
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    data = {r.doc_id: replaced(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_periodic_runs"](spark, sf).collect()
    assert len(got) == len(data) and any(r.n_runs for r in got)
    for r in got:
        if len(data[r.doc_id] or "") > 40000:
            continue  # the plain comparison takes the square of the words
        _, runs, text = expected(r.doc_id, data[r.doc_id])
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, text)]
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == (len(runs), *top, *sha)
