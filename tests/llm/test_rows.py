"""Exact dedup, archive, mixing and fingerprints on edge rows; the pieces SQL does not show."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthcast.llm import archive, exact_dedup, merkle, mixing

LONG = "wort " * 60_000
EDGES = [(1, None, "de", "a"), (2, "", None, None), (3, LONG, "en", "a"), (3, LONG, "en", "a"), (None, "x", "en", "b"),
         (None, None, None, None), (5, LONG, "en", "b"), (6, "x", "en", "a")]


# --- exact dedup ---------------------------------------------------------------


def test_groups_of_edge_rows(documents):
    got = exact_dedup.duplicate_groups(documents(EDGES)).collect()
    digest = {t: hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in EDGES}
    want = [
        (1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 5, 3, False), (3, 5, 3, False), (5, 5, 3, True),
        (None, 6, 2, False), (6, 6, 2, True),
    ]
    assert sorted(map(str, [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got])) == sorted(map(str, want))
    assert {r.text_sha256 for r in got} == set(digest.values())
    assert exact_dedup.duplicate_groups(documents([])).count() == 0


def test_each_text_once(documents):
    got = exact_dedup.without_copies(documents([*EDGES, (5, LONG, "en", "b")]))
    assert sorted((r.doc_id, r.text, r.kept, r.id, r.block) for r in got.collect()) == [
        (2, "", "x", "y", 1), (5, LONG, "x", "y", 1), (6, "x", "x", "y", 1),
    ]


def test_a_crowded_filter_loses_nothing(documents, monkeypatch):
    """With a filter far too small nearly every row may have a copy, and the result is the same."""
    monkeypatch.setattr(exact_dedup, "MOST_BITS", exact_dedup.SEGMENT)
    rows = [(i, f"t{i % 4000}") for i in range(0, 10_000, 3)] + [(20_000 + i, f"u{i}") for i in range(9000)]
    last, size = {}, {}
    for i, t in rows:
        last[t], size[t] = max(i, last.get(t, -1)), size.get(t, 0) + 1
    got = exact_dedup.duplicate_groups(documents(rows)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, last[t], size[t]) for i, t in rows}


def test_filter_finds_every_repeated_key(spark):
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    both = np.concatenate([keys, keys[:700]])
    bits = exact_dedup.filter_bits(len(both))
    seen = exact_dedup.repeated_bits(spark.createDataFrame([(int(k),) for k in both], "key long"), bits)
    at = spark.createDataFrame([(int(k),) for k in keys], "key long")
    at = np.array(at.select("key", *[p.alias(f"p{i}") for i, p in enumerate(exact_dedup.places(F.col("key"), bits))]).collect())
    hit = ((seen[at[:, 1:] >> 3] >> (at[:, 1:] & 7)) & 1 == 1).all(axis=1)
    repeated = np.isin(at[:, 0], keys[:700])
    assert hit[repeated].all() and hit[~repeated].mean() < 0.05


# --- archive -----------------------------------------------------------------------


@pytest.fixture
def pages(spark):
    def build(rows):
        return spark.createDataFrame([(*r, "x", b"y") for r in rows], "page_id long, url string, html string, digest string, payload binary")

    return build


def test_records_come_back(spark, pages, tmp_path):
    big = "<p>é</p>" * 50
    rows = [(4, "u4", big), (2, "u\r\n2", big), (9, None, big), (1, "u1", "small"), (3, "u3", "small"), (5, "u5", None),
            (6, "u6", ""), (2, "again", big), (None, "none", big), (7, "u7", LONG)]
    payloads = archive.write_archive(pages(rows), str(tmp_path / "a"))
    got = archive.read_records(spark, str(tmp_path / "a")).collect()
    columns = ["page_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "verified", "record"]
    rebuilt = archive.rebuilt_records(spark, str(tmp_path / "a"), payloads)
    assert sorted(str([r[c] for c in columns]) for r in got) == sorted(str([r[c] for c in columns]) for r in rebuilt.collect())
    assert len(got) == len(rows) and all(r.verified for r in got)
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    by_uri = {r.uri: r for r in got}
    assert {u: (r.record_type, r.refers_to) for u, r in by_uri.items()} == {
        "u4": ("revisit", 2), "u 2": ("response", None), None: ("revisit", 2), "u1": ("response", None),
        "u3": ("response", None), "u5": ("response", None), "u6": ("response", None), "again": ("response", None),
        "none": ("revisit", 2), "u7": ("response", None),
    }
    assert bytes(by_uri["none"].payload).decode() == big and by_uri["none"].page_id is None
    record = bytes(by_uri["u1"].record)
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith(b"\r\n\r\nsmall\r\n\r\n")
    assert b"Content-Length: 5\r\n" in record
    assert bytes(by_uri["u4"].record).endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")


def test_changed_bytes_are_not_verified(spark, pages, tmp_path):
    headers, payloads = archive.records(pages([(1, "u", "a" * 200), (2, "v", "a" * 200)]))
    headers.write.parquet(str(tmp_path / "a/headers"))
    payloads.withColumn("payload", F.lit(b"other")).write.parquet(str(tmp_path / "a/payloads"))
    assert [r.verified for r in archive.read_records(spark, str(tmp_path / "a")).collect()] == [False, False]


def test_no_pages(spark, pages, tmp_path):
    archive.write_archive(pages([]), str(tmp_path / "a"))
    assert archive.read_records(spark, str(tmp_path / "a")).count() == 0


def test_long_payloads_stay_where_they_are(spark, pages, tmp_path):
    """The payload table takes part in the join of long responses without an exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        payloads = archive.write_archive(pages([(i, f"u{i}", f"{i} " * 2000) for i in range(9)]), str(tmp_path / "a"))
        frame = archive.rebuilt_records(spark, str(tmp_path / "a"), payloads)
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3
    assert frame.where("length(record) > 2000 and verified").count() == 9


# --- mixing ------------------------------------------------------------------------


def test_mix_of_edge_rows(documents):
    got = mixing.mixed(documents(EDGES)).collect()
    assert len(got) == len(EDGES)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r)
    assert sum(r.size for r in got) == 180_002
    assert all(sum(r.taken for r in rows) == int(t) for (_, t), rows in by.items())
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(documents(EDGES[::-1])).collect()))
    assert mixing.mixed(documents([])).count() == 0
    assert mixing.mixed(documents([(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


def test_weights_come_first(documents):
    """Within a source, documents of large weight are mostly taken before the others."""
    rows = [(i, "w " * 10, None, "ab"[i >= 1000]) for i in range(2000)]
    weight = F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0)
    got = [r for r in mixing.mixed(documents(rows), weight).collect() if r.doc_id < 1000]
    share = [np.mean([r.taken > 0 for r in got if r.doc_id % 2 == k]) for k in (0, 1)]
    assert share[0] > 0.9 > 0.5 > share[1]


def test_excess_is_shared_again(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 400)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got == {"b": 30.0, "c": 30.0, "a": 680.0, None: 680.0}


# --- fingerprints --------------------------------------------------------------------


def test_fingerprints_of_edge_rows(documents):
    rows = [(9, "one\ntwo"), (7, None), (5, "é" * 7), (5, "é" * 7), (3, LONG), (None, "last"), (None, "more")]
    got = merkle.edited_fingerprints(documents(rows)).collect()
    order = [("one\ntwo", 9), ("", 7), ("é" * 7, 5), ("é" * 7, 5), (LONG, 3), ("last", None), ("more", None)]
    want = []
    for k, (text, id_) in enumerate(order):
        after, half = order[(k + 1) % len(order)][0], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((str(id_), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id == 5}) == 1
    assert merkle.edited_fingerprints(documents([])).count() == 0


def test_one_row_follows_itself(documents):
    (r,) = merkle.edited_fingerprints(documents([(1, "abcd")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0


def test_branches_locate_an_edit(documents):
    lines = [f"line {i}" for i in range(100)]
    other = [*lines[:50], "changed", *lines[51:]]
    a, b = merkle.fingerprints(documents([(1, "\n".join(lines)), (2, "\n".join(other))])).orderBy("doc_id").collect()
    assert a.fingerprint != b.fingerprint
    new = [i for i, x in enumerate(b.sections) if x not in a.sections]
    assert 1 <= len(new) <= 2 and len(b.sections) > 3
    frame = documents([(1, "")]).select(F.lit(",".join(a.sections)).alias("a"), F.lit(",".join(b.sections)).alias("b"))
    frame = frame.select(F.split("a", ",").alias("a"), F.split("b", ",").alias("b"))
    found = merkle.differing_sections(F.col("b"), F.array_except("b", "a"))
    assert frame.select(found).first()[0] == new


def test_an_insertion_moves_no_other_cut(documents):
    """One character put into a long line changes the sections around it, wherever it stands."""
    words = " ".join(f"word{i} the other{i * 7} lines" for i in range(600))
    texts = [words] + [words[:k] + "x" + words[k:] for k in range(1, len(words), 397)]
    first, *rest = merkle.fingerprints(documents(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert len(first.sections) > 20
    assert max(len(set(r.sections) - set(first.sections)) for r in rest) <= 2
    assert min(len(set(r.leaves) & set(first.leaves)) for r in rest) >= len(set(first.leaves)) - 2


def test_pieces_lose_no_character(documents):
    """Texts that differ anywhere have other fingerprints: long stretches without a cut, line ends, other scripts."""
    texts = ["x" * 1000, "x" * 1001, "x" * 999 + "y", "\n" * 50, "\n" * 51, "文" * 500, "文" * 499 + "字", "a b\n", "a b", "a b\r\n", "", " "]
    got = merkle.fingerprints(documents(list(enumerate(texts)))).collect()
    assert len({r.fingerprint for r in got}) == len(texts)


def test_next_text_across_ranges(documents):
    rows = [(i * 3, f"t{i}") for i in range(500)]
    got = {r.id: r.next_text for r in merkle.with_next(documents(rows).repartition(5)).collect()}
    assert got == {i * 3: f"t{i - 1 if i else 499}" for i in range(500)}


def taken_words(frame):
    return {r.source: r.n for r in frame.groupBy("source").agg(F.sum(mixing.words_of(F.col("text"))).alias("n")).collect()}


def test_the_mix_meets_every_target_with_null_ids(documents):
    """Null ids in several sources, equal rows on a border, a source without words: each source gets its target."""
    rows = [(None, f"w{i} x y z", None, "A") for i in range(40)] + [(None, f"w{i} x y z", None, "B") for i in range(10)]
    got = [taken_words(mixing.repeated(documents(rows).repartition(n))) for n in (1, 3, 7)]
    assert got == [{"A": 80, "B": 120}] * 3
    rows = [(None, "one two three", None, "A")] * 50 + [(7, "a b c d e", None, "B")] * 30 + [(i, "q " * i, None, None) for i in range(20)]
    rows += [(900, None, None, "C"), (901, "", None, "C"), (902, "w " * 40, None, "D")]
    frame = documents(rows).repartition(4)
    sizes = {s: sum(len((t or "").split()) for _, t, _, x in rows if x == s) for s in {r[3] for r in rows}}
    targets = {r.source: int(r.target) for r in mixing.source_targets(
        frame.sparkSession.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    first = mixing.repeated(frame)
    assert {k: v for k, v in taken_words(first).items() if v} == {k: v for k, v in targets.items() if v}
    again = mixing.repeated(documents(rows[::-1]).repartition(2))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


def test_the_mix_takes_what_mixed_says(documents):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 13)), None, "ABC"[i % 3]) for i in range(200)]
    want = {r.doc_id: r.taken for r in mixing.mixed(documents(rows)).collect()}
    got = {}
    for r in mixing.repeated(documents(rows)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {k: v for k, v in want.items() if k in got} and all(not v for k, v in want.items() if k not in got)


def test_the_mix_moves_no_texts(documents):
    """The only shuffle of the last job is that of rows equal to a border document."""
    plan = mixing.repeated(documents([(i, "a b c", None, "AB"[i % 2]) for i in range(50)]))
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Exchange hashpartitioning") <= 1 and "Window" not in shown and "SortMergeJoin" not in shown
