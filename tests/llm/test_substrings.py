"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
import re

import pytest

from monthcast.llm import substrings
from monthcast.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window=20):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out[doc] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def rows():
    dice = random.Random(4)
    vocabulary = ["the", "of", "Ça", "a", "b"] + [f"w{i}" for i in range(300)]
    draw = lambda n: " ".join(dice.choices(vocabulary, k=n))
    passage, short = draw(25), draw(19)
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "x " * 60), (5, short), (6, short + " " + short), (7, "x\n" * 45)]
    out += [(i, f"{draw(dice.randint(0, 60))}  {passage}\n{draw(dice.randint(0, 60))}") for i in range(10, 60)]
    out += [(i, out[20][1]) for i in range(60, 75)] + [(80, passage), (81, draw(4000)), (None, passage + " end")]
    dice.shuffle(out)
    return out


@pytest.mark.parametrize("window", [10, 20, 21])
def test_against_brute_force(documents, window):
    data = rows()
    got = substrings.without_repeats(documents(data).repartition(3), window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == brute(data, window)


def test_repeated_rows_and_no_rows(documents):
    text = " ".join(f"w{i}" for i in range(30))
    got = substrings.without_repeats(documents([(1, text), (1, text)])).collect()
    assert sorted(r.n_removed for r in got) == [0, 30]
    assert substrings.without_repeats(documents([])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for k, (n, m, t) in brute(data).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op8_substring_dedup"](spark, sf).collect()}
    assert got == want
