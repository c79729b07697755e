"""Near-duplicates against all pairs, and the sketch against the similarity it estimates."""

import random
import re

import numpy as np
import pytest

from monthcast.llm import near_dedup
from monthcast.llm.queries import QUERIES
from monthcast.llm.tables import connected

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, length=2):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < length:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(length)), strict=False))


def brute(rows, length=2):
    sets = {i: shingle_set(t, length) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def family(dice, size, words, most):
    """Copies of one text, each with up to ``most`` of its words replaced."""
    base = [f"b{i}" for i in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for at in dice.sample(range(words), dice.randint(0, most)):
            own[at] = f"x{dice.random()}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("chunk", [192, 8])
def test_against_all_pairs(documents, chunk):
    """With chunks of eight the large family is settled by first chunks and strays."""
    dice = random.Random(2)
    texts = family(dice, 90, 60, 9) + family(dice, 5, 400, 20) + ["", None, "One", "one", "one two", "ONE  two", "two one"]
    texts += [" ".join(dice.choices(["a", "b", "c", "d"] + [f"w{i}" for i in range(500)], k=80)) for _ in range(60)]
    texts += ["É été", "é été", "a " * 3000, "A a a"]
    dice.shuffle(texts)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    assert result(near_dedup.near_duplicates(documents(rows), chunk=chunk)) == brute(rows)


def slotted(dice, singles, pairs, slots=20, choices=5):
    """Texts of one template with filled slots, few of them linked; then pairs that differ in four slots."""

    def text(fill):
        return " ".join(f"t{2 * i} t{2 * i + 1} t{2 * i + 2}x s{i}v{v}" for i, v in enumerate(fill))

    out = [text([dice.randrange(choices) for _ in range(slots)]) for _ in range(singles)]
    for _ in range(pairs):
        fill = [dice.randrange(choices) for _ in range(slots)]
        out.append(text(fill))
        for at in dice.sample(range(slots), 4):
            fill[at] = (fill[at] + 1) % choices
        out.append(text(fill))
    return out


@pytest.mark.parametrize("chunk, band_chunk", [(192, 1024), (64, 100)])
def test_a_third_text_hides_no_link(documents, monkeypatch, chunk, band_chunk):
    """Every band that two linked texts share has a smaller text of about half their similarity."""
    monkeypatch.setattr(near_dedup, "BAND_CHUNK", band_chunk)
    rows = list(enumerate(slotted(random.Random(5), 1000, 40)))
    want = brute(rows)
    assert sum(not kept for _, _, kept in want.values()) >= 40
    assert result(near_dedup.near_duplicates(documents(rows), chunk=chunk)) == want


def test_unlinked_families_cost_rows_in_proportion(documents, monkeypatch):
    """A family of about 0.75 similarity without links: rows compared on full sets grow with its texts, not their square."""
    counts, linked, keep = {}, {}, near_dedup.stored

    def stored(frame, name):
        out = keep(frame, name)
        if name == "units":
            counts[size] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "stored", stored)
    dice = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    for size in (600, 1200):
        rows = []
        for i in range(size):
            own = list(base)
            for at in dice.sample(range(150), 6):
                own[at] = f"x{dice.random()}"
            rows.append((i, " ".join(own)))
        linked[size] = near_dedup.near_duplicates(documents(rows)).where("not kept").count()
    assert linked[1200] < 300, linked  # a few have their words replaced in the same places
    assert 0 < counts[1200] <= 4 * counts[600] and counts[1200] <= 1200 * near_dedup.BANDS, counts


def test_edge_rows(documents):
    got = near_dedup.near_duplicates(documents([(None, "a b"), (3, "a b"), (3, "a b"), (None, "c d"), (None, None)])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == [
        ("3", 1, "3", True), ("3", 1, "3", True), ("None", 0, "None", True), ("None", 1, "3", False), ("None", 1, "None", True),
    ]
    assert near_dedup.near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("n", [1, 3, 40, 3000])
def test_sketch_fills_and_estimates(n):
    dice = np.random.default_rng(n)
    h = dice.integers(0, 1 << 63, 2 * n).astype(np.uint64)
    a, b = h[: n + n // 2], h[n // 2 :]
    doc = np.repeat([0, 1], [len(a), len(b)])
    s = near_dedup.sketches(doc, np.concatenate([a, b]), 3, 240)
    assert (s[:2] != near_dedup.EMPTY).all() and (s[2] == near_dedup.EMPTY).all()
    want = len(set(a.tolist()) & set(b.tolist())) / len(set(h.tolist()))
    assert abs((s[0] == s[1]).mean() - want) < 0.12


def test_components(spark):
    dice = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)]
    edges += [(dice.randint(1000, 1100), dice.randint(1000, 1100)) for _ in range(60)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in parent}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(QUERIES["op7_near_dedup"](spark, sf)) == brute(rows)
