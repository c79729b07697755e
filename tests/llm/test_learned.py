"""Language ID and quality classifier: held-out accuracy and edge rows."""

import zlib

import numpy as np
import pytest

from monthcast.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, "12 34"), (4, "x" * 200_000), (None, "The thing"), (5, "The thing"), (5, "The thing")]


@pytest.fixture(scope="module")
def labelled(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return docs, labels


def test_language_of_held_out_documents(spark, labelled):
    docs, _ = labelled
    got = queries.QUERIES["op2_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_rows(spark, documents):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = langid.predicted(documents(EDGES), model).collect()
    assert len(got) == len(EDGES)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3}
    assert {r.score for r in got if r.lang_pred == "und"} == {0.0}
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id in (None, 5)}) == 1


def test_language_without_training_rows(documents):
    docs = documents([(1, "The thing")])
    model = langid.fit(docs)
    assert [(r.lang_pred, r.score) for r in langid.predicted(docs, model).collect()] == [("und", 0.0)]
    assert langid.predicted(documents([]), model).count() == 0


def _restated(texts, train, langs):
    """TF-IDF, centroids and cosines of documents by id, in plain dictionaries and double precision."""

    def grams(text):
        folded = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
        folded = [32, *folded, 32, 32]
        found = {}
        for k, (width, places) in enumerate(((2, _PLACES[0]), (3, _PLACES[1]))):
            for i in range(len(folded) - 2):
                run = folded[i : i + width]
                blanks = [x == 32 for x in run]
                if (k == 0 and all(blanks)) or (k == 1 and blanks[1] and (blanks[0] or blanks[2])):
                    continue
                key = int(places[int.from_bytes(bytes(run))])
                found[key] = found.get(key, 0) + 1
        return found

    counted = {i: grams(t) for i, t in texts.items()}
    seen = np.zeros(langid.DIMS)
    for i in train:
        seen[list(counted[i])] += 1
    idf = np.log((1 + len(train)) / (1 + seen)) + 0.05

    def vector(found):
        v = np.zeros(langid.DIMS)
        for place, n in found.items():
            v[place] = np.log1p(n) * idf[place]
        length = np.sqrt((v * v).sum())
        return v / length if length else v

    v = {i: vector(c) for i, c in counted.items()}
    centers = []
    for lang in sorted({langs[i] for i in train}):
        # The operator takes a language's documents by their packed counts; the order decides ties alone.
        group = [v[i] for i in train if langs[i] == lang]
        middle = np.mean(group, axis=0)
        chosen = [max(group, key=lambda x: x @ middle)]
        while len(chosen) < min(langid.CENTROIDS, len(group)):
            chosen.append(min(group, key=lambda x: max(x @ c for c in chosen)))
        for _ in range(langid.ROUNDS):
            near = [int(np.argmax([x @ c for c in chosen])) for x in group]
            for k in range(len(chosen)):
                mine = [x for x, n in zip(group, near, strict=True) if n == k]
                if mine:
                    chosen[k] = np.mean(mine, axis=0)
            chosen = [c / np.sqrt((c * c).sum()) for c in chosen]
        centers += [(lang, c) for c in chosen]
    return {i: max((x @ c, lang) for lang, c in centers) for i, x in v.items()}


_PLACES = (langid.hashed_places(16, langid.BYTE_BASE[0], langid.DIMS), langid.hashed_places(24, langid.BYTE_BASE[1], langid.DIMS))


def test_language_by_restatement(spark):
    """Every cosine, language and rejection of the smallest table, against the method in plain loops."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in table.select("doc_id", "text", "lang").collect() if r.text is not None and any(c.isalpha() for c in r.text)]
    texts, langs = {r.doc_id: r.text for r in rows}, {r.doc_id: r.lang for r in rows}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 3 != 1 and langs[i] is not None]
    want = _restated(texts, train, langs)
    learn = table.where(table.doc_id.isin(train))
    got = {r.doc_id: r for r in langid.predicted(table, langid.fit(learn), least=0.6).collect()}
    for i, (score, lang) in want.items():
        assert got[i].score == pytest.approx(min(score, 1), abs=2e-4), i
        assert got[i].lang_pred == lang, i
        assert got[i].rejected == (score < 0.6) or abs(score - 0.6) < 2e-4
    assert 0 < sum(got[i].rejected for i in want) < len(want)


def test_counts_do_not_depend_on_the_texts_beside():
    rows = [b"one", b"", b"two words", b"x", "\u00e4".encode(), b"last one"]
    together = langid.counts(rows)
    for i, row in enumerate(rows):
        assert (together[i] == langid.counts([row])[0]).all(), row
    assert (langid.counts(rows[::-1])[::-1] == together).all() and together[1].sum() == 0


def test_text_far_from_every_language_is_rejected(spark, documents):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = langid.predicted(documents([(1, "\u4e2d\u6587\u5b57\u7b26" * 30), (2, "zqxj wvkq jxqz")]), model).collect()
    assert [r.rejected for r in sorted(got)] == [True, True] and all(r.score < langid.LEAST for r in got)


@pytest.mark.parametrize("passed", [1, 8])
def test_more_languages_than_a_block_holds(spark, monkeypatch, passed):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = sorted(langid.predicted(table, langid.fit(table)).collect())
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    monkeypatch.setattr(langid, "PASSED", passed)
    model = langid.fit(table)
    assert model.blocks > 2
    many = sorted(langid.predicted(table, model).collect())
    assert [r.doc_id for r in one] == [r.doc_id for r in many]
    assert [r.lang_pred for r in one] == [r.lang_pred for r in many]
    assert [r.score for r in one] == pytest.approx([r.score for r in many], abs=1e-5)


def test_language_of_tables_with_clashing_names(spark):
    docs = spark.createDataFrame(
        [(1, "the thing and the thing", "en", 1, "a", 2, 0.5), (2, "der die das und der", "de", 1, "b", 2, 0.5)],
        "doc_id long, text string, lang string, _lang int, _rows string, size int, dice double",
    )
    got = {r.doc_id: r.lang_pred for r in langid.predicted(docs, langid.fit(docs)).collect()}
    assert got == {1: "en", 2: "de"}


def test_quality_against_labels(spark, labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in queries.QUERIES["op4_quality_classifier"](spark, SF).collect()}
    assert set(got) == set(docs)
    good = [got[i].kept for i, x in labels.items() if x.quality == 1]
    poor = [got[i].kept for i, x in labels.items() if x.quality == 0]
    assert np.mean(good) > 0.98
    assert np.mean(poor) < 0.15


def test_quality_edge_rows(documents):
    docs = documents(EDGES)
    weights = quality.fit(docs)
    got = quality.scored(docs, weights).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(documents([]), quality.fit(documents([]))).count() == 0


def test_em_recovers_labellers_that_miss():
    """Labellers that seldom call good text low, and see their own kind of poor text but few of the others."""
    rng = np.random.default_rng(1)
    m, n = len(quality.LABELLERS), 20_000
    kind = np.where(rng.random(n) < 0.8, 0, rng.integers(1, m + 1, n))
    low = rng.random((n, m)) < np.where(kind == 0, 0.005, 0.1)[:, None]
    low |= (np.arange(1, m + 1) == kind[:, None]) & (rng.random((n, m)) < 0.95)
    pattern = np.where(low, quality.LOW, quality.GOOD) @ 3 ** np.arange(m)
    keys, counts = np.unique(pattern, return_counts=True)
    posterior, table, share = quality.estimate(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    found = np.array([posterior[k] for k in pattern.tolist()]) > 0.5
    assert (found == (kind == 0)).mean() > 0.95
    assert abs(share[0] - 0.8) < 0.05
    assert np.allclose(share.sum(), 1) and np.allclose(table.sum(axis=2), 1)


def _em_in_loops(patterns, rounds):
    """The same model, one pattern, class and labeller at a time."""
    m = len(quality.LABELLERS)
    votes = {p: [p // 3**k % 3 for k in range(m)] for p in patterns}
    post = {}
    for p, v in votes.items():
        low = [x == quality.LOW for x in v]
        post[p] = [float(not any(low)), *[x / max(1, sum(low)) for x in low]]
    for _ in range(rounds):
        total = sum(patterns.values())
        weight = {p: [patterns[p] * x for x in post[p]] for p in patterns}
        share = [(sum(weight[p][c] for p in patterns) + 0.1) / (total + 0.1 * (m + 1)) for c in range(m + 1)]
        table = {}
        for c in range(m + 1):
            for k in range(m):
                seen = [0.1 + sum(weight[p][c] for p in patterns if votes[p][k] == x) for x in range(3)]
                table[c, k] = [s / sum(seen) for s in seen]
        for p in patterns:
            like = [share[c] * np.prod([table[c, k][votes[p][k]] for k in range(m)]) for c in range(m + 1)]
            post[p] = [x / sum(like) for x in like]
    return post, table, share


@pytest.mark.parametrize("rounds", [1, 7])
def test_em_by_restatement(rounds):
    rng = np.random.default_rng(4)
    m = len(quality.LABELLERS)
    patterns = {int(p): int(n) for p, n in zip(rng.integers(0, 3**m, 60), rng.integers(1, 500, 60), strict=True)}
    patterns.pop(int((np.full(m, quality.ABSTAIN) * 3 ** np.arange(m)).sum()), None)
    got, table, share = quality.estimate(patterns, rounds)
    post, want, shares = _em_in_loops(patterns, rounds)
    assert all(got[p] == pytest.approx(post[p][0], abs=1e-9) for p in patterns)
    assert share.tolist() == pytest.approx(shares)
    assert all(table[c, k].tolist() == pytest.approx(want[c, k]) for c, k in want)


def test_accuracies_are_the_planted_ones():
    """Labellers of different keenness that overlap: what EM finds of each is what its votes were drawn from."""
    rng = np.random.default_rng(8)
    m, n = len(quality.LABELLERS), 60_000
    keen = np.linspace(0.75, 0.98, m)
    alarm = np.linspace(0.002, 0.02, m)
    kind = np.where(rng.random(n) < 0.7, 0, rng.integers(1, m + 1, n))
    chance = np.where(kind[:, None] == 0, alarm, 0.35)
    own = np.arange(1, m + 1) == kind[:, None]
    low = rng.random((n, m)) < np.where(own, keen, chance)
    pattern = np.where(low, quality.LOW, quality.GOOD) @ 3 ** np.arange(m)
    keys, counts = np.unique(pattern, return_counts=True)
    _, table, share = quality.estimate(dict(zip(keys.tolist(), counts.tolist(), strict=True)), 2000)
    for k, (poor, good, right) in enumerate(quality.accuracies(table, share)):
        assert poor == pytest.approx(low[kind > 0, k].mean(), abs=0.05), k
        assert good == pytest.approx(alarm[k], abs=0.012), k
        assert right == pytest.approx((low[:, k] == (kind > 0)).mean(), abs=0.04), k


def test_labeller_accuracies_of_a_table(spark, documents):
    rows = quality.labeller_accuracies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert [r.labeller for r in rows] == list(range(len(quality.LABELLERS)))
    assert all(0 <= x <= 1 for r in rows for x in r[1:])
    assert all(r.low_on_poor > r.low_on_good for r in rows)
    assert quality.labeller_accuracies(documents(EDGES)).count() == len(quality.LABELLERS)
    assert quality.labeller_accuracies(documents([])).count() == len(quality.LABELLERS)


def test_scorer_is_at_its_least_loss():
    rng = np.random.default_rng(6)
    x = np.hstack([rng.random((300, 5)), np.ones((300, 1))])
    y = 1 / (1 + np.exp(-(x @ [3, -2, 0, 1, -4, 0.5])))

    def loss(w, penalty=1e-2):
        z = x @ w
        return np.mean(np.logaddexp(0, z) - y * z) + penalty / 2 * w @ w

    w = quality.regress(x, y, penalty=1e-2)
    for i in range(6):
        for step in (-0.02, 0.02):
            moved = w.copy()
            moved[i] += step
            assert loss(moved) > loss(w)
