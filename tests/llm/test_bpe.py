"""Byte-level BPE against the tiktoken library."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from monthcast.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TEXTS = [
    "The cat's  hat,\n\n it'll   do!",
    "",
    None,
    "Ça été — naïve façade; 12345 ½ Ⅷ  x y\t\t",
    " ",
    "   \n ",
    "日本語のテキスト 😀😀 <|endoftext|>",
    "word " * 5000,
    "x" * 3000,
]


def expected(text):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})
    return own.encode_ordinary(text or "")


def test_ids_equal_the_library_and_decode(documents):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "no id")]
    got = bpe.decoded(bpe.encoded(documents(rows), PATH, PATTERN), PATH).collect()
    assert sorted(map(str, [r.doc_id for r in got])) == sorted(str(i) for i, _ in rows)
    text = dict(rows)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == expected(text[r.doc_id])
        assert r.decoded.decode() == (text[r.doc_id] or "")


def test_digests_of_the_supplied_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = np.array(expected(r.text), "<u4").tobytes()
        want[r.doc_id] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH, PATTERN).collect()}
    assert got == want


def test_no_rows(documents):
    assert bpe.round_trip(documents([]), PATH, PATTERN).count() == 0
