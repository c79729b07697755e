"""Each stage of the pipeline against a plain restatement on what its predecessor kept."""

from collections import Counter, defaultdict
from math import floor

import numpy as np
import pytest
from test_bpe import expected
from test_near_dedup import brute

import corpus_pipeline
from monthcast.llm import mixing, quality

SF = "/root/testdata/sf0.001"
WORDS = mixing.words_of


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_columns(kept):
    assert all(f.columns == kept[0].columns for f in kept[:5])
    assert kept[5].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_quality(kept):
    weights = quality.fit(kept[0])
    want = [tuple(r) for r in kept[0].collect() if 1 / (1 + np.exp(-(quality.features([r.text.encode()]) @ weights)[0])) >= 0.4]
    assert rows(kept[1]) == sorted(want, key=str)
    assert len(want) > 0.8 * kept[0].count()


def test_exact(kept):
    last = {}
    for r in sorted(kept[1].collect(), key=lambda r: r.doc_id):
        last[r.text] = tuple(r)
    assert rows(kept[2]) == sorted(last.values(), key=str)


def test_near(kept):
    data = kept[2].collect()
    stay = {i for i, (_, _, kept_) in brute([(r.doc_id, r.text) for r in data], 5).items() if kept_}
    assert rows(kept[3]) == sorted((tuple(r) for r in data if r.doc_id in stay), key=str)


def test_mix(kept):
    size, source = defaultdict(int), {}
    for r in kept[3].collect():
        size[r.source] += len(r.text.split())
        source[r.doc_id] = r
    target = shares(size)
    taken, times = Counter(), Counter()
    for r in kept[4].collect():
        whole = source[r.doc_id]
        taken[r.source] += len(r.text.split())
        times[r.doc_id] += 1
        assert r.text == whole.text or whole.text.split()[: len(r.text.split())] == r.text.split()
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (whole.lang, whole.source)
    assert max(times.values()) <= 3
    assert all(taken[s] == floor(target[s] + 1e-9) for s in size)


def shares(size):
    """Targets by sharing the excess again until none is above three times its source's size."""
    order = sorted(size)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * size[s] if s in capped else rest * weight[s] / free for s in order}
        above = {s for s in order if s not in capped and target[s] > 3 * size[s]}
        if not above:
            return target
        capped |= above


def test_encoding(kept):
    import hashlib

    want = []
    for r in kept[4].collect():
        ids = np.array(expected(r.text), "<u4").tobytes()
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert rows(kept[5]) == sorted(want, key=str)


def test_run_is_the_stages(spark, kept):
    assert rows(corpus_pipeline.run(spark, SF)) == rows(kept[5])


NULLS = [(1, None), (2, ""), (None, "a b c d e f"), (None, None), (3, "a b c d e f"), (3, "a b c d e f"), (4, "x " * 50_000)]


@pytest.mark.parametrize("data", [NULLS, []])
def test_edge_rows_pass_every_stage(spark, documents, data):
    """Null ids and texts, repeated rows, a long text, no rows, and columns with the operators' own names."""
    for _, stage in corpus_pipeline.STAGES:
        docs = documents(data)
        out = stage(spark, docs, SF)
        assert out.count() <= 3 * max(1, len(data))
        assert out.columns == docs.columns or stage is corpus_pipeline.byte_bpe
