"""Quality classifier: EM over heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthcast.llm.blocks import pack, unpack
from monthcast.llm.tables import bounded_batches, stored
from monthcast.llm.words import BYTE_BASE, Words, chunks, hashed_places, mix, texts, windows

#: Votes of a labeller.
LOW, GOOD, ABSTAIN = 0, 1, 2
#: (name, low from, good up to): votes on a measure that is large in poor text; in between it abstains.
LABELLERS = (
    ("signs for each word", 0.8, 0.35),
    ("exclamation and hash signs for each word", 0.15, 0.03),
    ("capitals among letters", 0.4, 0.2),
    ("words without a letter", 0.2, 0.08),
    ("four-word runs that repeat", 0.3, 0.1),
    ("long words for each short one", 10.0, 3.5),
    ("words for each sentence end", 100.0, 30.0),
)
#: Fewer words than this make the labellers of rates abstain.
LEAST_WORDS = 4
DIMS = 2048
SHORT = 40
#: Documents the scorer is fitted on, on average, chosen by a hash.
SAMPLE = 6000
#: Least score of a document that is kept: only what is rather sure to be poor goes.
LEAST = 0.4

LETTER, UPPER, DIGIT, HIGH = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = True
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
DIGIT[48:58] = True
HIGH[128:] = True
SIGN = np.zeros(256, bool)
SIGN[33:127] = True
SIGN &= ~(LETTER | DIGIT)
LOUD = np.zeros(256, bool)
LOUD[[33, 35]] = True
STOP = np.zeros(256, bool)
STOP[[46, 63, 33]] = True
#: Classes of bytes for the scorer: letters by case, digits, bytes above ASCII; white space and signs stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("0")
SHAPE[128:] = ord("a")


def _sums(flags: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[begin])


def measures(rows: list[bytes], words: Words) -> np.ndarray:
    """The measure of each labeller for each text; nan where there is nothing to measure."""
    begin = np.cumsum([0] + [len(r) + 1 for r in rows])
    n = words.counts().astype(float)
    letters = _sums(LETTER[words.data] & ~HIGH[words.data], begin)
    bare = _sums(LETTER[words.data], np.stack([words.start, words.end], 1).reshape(-1))[::2] == 0 if len(words) else np.zeros(0, bool)
    long = words.end - words.start > 3
    runs = windows(words.hashes(), 4)
    doc = words.doc[: len(runs)]
    inside = doc == words.doc[3:] if len(runs) else np.zeros(0, bool)
    key, doc = mix(runs[inside] + doc[inside].astype(np.uint64) * np.uint64(BYTE_BASE[0])), doc[inside]
    _, first = np.unique(key, return_index=True)
    distinct = np.bincount(doc[first], minlength=len(rows))
    every = np.bincount(doc, minlength=len(rows))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.stack(
            [
                _sums(SIGN[words.data], begin) / n,
                _sums(LOUD[words.data], begin) / n,
                np.where(letters > 0, _sums(UPPER[words.data], begin) / letters, np.nan),
                _sums(bare, words.first) / n,
                1 - distinct / every,
                _sums(long, words.first) / np.maximum(1, _sums(~long, words.first)),
                n / np.maximum(1, _sums(STOP[words.data[words.end - 1]], words.first)) if len(words) else n,
            ],
            axis=1,
        )
    out[n < LEAST_WORDS] = np.nan
    return out


def votes(measure: np.ndarray) -> np.ndarray:
    out = np.full(measure.shape, ABSTAIN, np.int64)
    for k, (_, low, good) in enumerate(LABELLERS):
        out[measure[:, k] >= low, k] = LOW
        out[measure[:, k] <= good, k] = GOOD
    return out


def features(rows: list[bytes]) -> np.ndarray:
    """Roots of hashed shares of runs of three byte classes, and a constant.

    Shares are shrunk as if the text had ``SHORT`` more runs, so that a very
    short text says little and gets about the score of a text unseen.
    """
    data = SHAPE[np.frombuffer(b"   ".join(rows) + b"   ", np.uint8)].astype(np.uint32)
    begin = np.cumsum([0] + [len(r) + 3 for r in rows])
    doc = np.repeat(np.arange(len(rows)), np.diff(begin))[:-2]
    place = hashed_places(24, BYTE_BASE[0], DIMS)[data[:-2] << 16 | data[1:-1] << 8 | data[2:]].astype(np.int64) + doc * DIMS
    out = np.sqrt(np.bincount(place, minlength=len(rows) * DIMS).reshape(len(rows), DIMS).astype(np.float32))
    out /= np.sqrt(np.diff(begin) + SHORT).astype(np.float32)[:, None]
    return np.hstack([out, np.ones((len(rows), 1), np.float32)])


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    return chunks(texts(column), 1 << 20, 256)


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The votes of each document as one number; features of those chosen for the fit."""
    base = 3 ** np.arange(len(LABELLERS))
    for batch in batches:
        chosen = batch.column("chosen").to_pylist()
        for first, rows in _pieces(batch.column("text")):
            pattern = votes(measures(rows, Words.of(rows))) @ base
            at = [i for i in range(len(rows)) if chosen[first + i]]
            data = [None] * len(rows)
            for i, x in zip(at, features([rows[i] for i in at]) if at else [], strict=True):
                used = np.flatnonzero(x)
                data[i] = pack(used.astype(np.uint16), x[used])
            yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int32()), pa.array(data, pa.binary())], ["pattern", "data"])


def estimate(patterns: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray, np.ndarray]:
    """EM for labellers that err independently given what kind of text it is.

    The hidden classes are good text and, for each labeller, the kind of poor
    text it was made for, since one kind rarely shows in every measure.
    ``patterns`` counts the documents of each combination of votes, so every
    document takes part and the work does not grow with them. Returns the
    posterior of good text for each pattern, the estimated table (class,
    labeller, vote) of probabilities, and the shares of the classes, good
    first. Starts from good where nobody votes low and from the labellers
    that do elsewhere. Documents on which all abstain get the overall share.
    """
    m = len(LABELLERS)
    silent = int((np.full(m, ABSTAIN) * 3 ** np.arange(m)).sum())
    keys = np.array(sorted(k for k in patterns if k != silent), dtype=np.int64)
    n = np.array([patterns[k] for k in keys.tolist()], float)
    vote = keys[:, None] // 3 ** np.arange(m) % 3
    hot = np.stack([vote == v for v in (LOW, GOOD, ABSTAIN)], axis=2).astype(float)
    low = hot[:, :, LOW]
    post = np.hstack([low.sum(axis=1, keepdims=True) == 0, low / np.maximum(1, low.sum(axis=1, keepdims=True))])
    table = share = None
    for _ in range(rounds):
        weight = (post * n[:, None]).T
        share = (weight.sum(axis=1) + 0.1) / (n.sum() + 0.1 * (m + 1))
        table = np.einsum("cp,plv->clv", weight, hot) + 0.1
        table /= table.sum(axis=2, keepdims=True)
        like = np.einsum("plv,clv->pc", hot, np.log(table)) + np.log(share)
        like = np.exp(like - like.max(axis=1, keepdims=True)) if len(like) else like
        now = like / like.sum(axis=1, keepdims=True) if len(like) else post
        moved, post = np.abs(now - post).max(initial=0.0), now
        if moved < 1e-7:
            break
    out = dict(zip(keys.tolist(), post[:, 0].tolist(), strict=True))
    if silent in patterns:
        out[silent] = float((post[:, 0] * n).sum() / n.sum()) if len(n) else 0.5
    return out, table, share


def accuracies(table: np.ndarray, share: np.ndarray) -> list[tuple[float, float, float]]:
    """What EM learned of each labeller, in their order: how often it votes low on poor text of any kind, how often on
    good text, and how often a vote of its (low or good) is right over all text.

    Poor text on which one labeller alone votes low looks like good text on which it errs, so these are close only
    where labellers overlap; single kinds of poor text are not told apart well enough to report. A labeller that always abstains is right with probability 0.5, as nothing is known of it.
    """
    out = []
    for k in range(len(LABELLERS)):
        low, good = share * table[:, k, LOW], share * table[:, k, GOOD]
        voted = low.sum() + good.sum()
        right = (low[1:].sum() + good[0]) / voted if voted > 0 else 0.5
        out.append((float(low[1:].sum() / share[1:].sum()), float(table[0, k, LOW]), float(right)))
    return out


def labeller_accuracies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row a labeller: ``labeller`` (its place), ``low_on_poor``, ``low_on_good``, ``right``, from all documents.

    Null text counts as empty, repeated rows vote each time, and ids are not
    looked at. No rows give the start values of no knowledge.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.lit(False).alias("chosen"))
    voted = rows.mapInArrow(_label, "pattern int, data binary").groupBy("pattern").agg(F.count("*").alias("n"))
    _, table, share = estimate({r.pattern: r.n for r in voted.collect()})  # at most 3 to the number of labellers
    found = [(k, *row) for k, row in enumerate(accuracies(table, share))]
    return docs.sparkSession.createDataFrame(found, "labeller int, low_on_poor double, low_on_good double, right double")


def regress(x: np.ndarray, y: np.ndarray, penalty: float = 1e-5, rounds: int = 400, poor: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps; poor text weighs ``poor`` times as much."""
    weight = np.where(y > 0.5, 1.0, poor)
    weight, y = (weight / max(1.0, weight.sum())).astype(x.dtype), y.astype(x.dtype)
    w = ahead = np.zeros(x.shape[1], x.dtype)
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    w[-1] = np.log(mean / (1 - mean))  # the constant
    step, t = x.dtype.type(2.0), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ ahead)))
        grad = (weight * (p - y)) @ x + x.dtype.type(penalty) * ahead
        after = ahead - step * grad
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = after + x.dtype.type((t - 1) / later) * (after - w), after, later
    return w


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> np.ndarray:
    """Weights of the scorer. All documents vote; about ``sample`` of them, chosen by a hash of id and text, fit it.

    The driver receives the counts of vote patterns (at most 3 to the number
    of labellers) and the sample. Null text counts as empty. No rows, or only
    one class among the sample's labels, give a scorer by the prior alone.
    """
    bounded_batches(docs.sparkSession)
    count = max(1, docs.count())
    dice = F.pmod(F.xxhash64(F.lit(5), F.col(id_col), F.xxhash64(text_col)), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.select(F.col(text_col).alias("text"), (dice < sample / count).alias("chosen"))
    labelled = stored(rows.mapInArrow(_label, "pattern int, data binary"), "labels")
    patterns = {r.pattern: r.n for r in labelled.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    if not patterns:
        return np.zeros(DIMS + 1)
    posterior = estimate(patterns)[0]
    found = sorted((bytes(r.data), r.pattern) for r in labelled.where("data is not null").collect())
    x = np.zeros((len(found), DIMS + 1), np.float32)
    for i, (data, _) in enumerate(found):
        place, value = unpack(data)
        x[i, place] = value
    y = np.array([posterior[p] for _, p in found])
    if len(set(y > 0.5)) < 2:
        prior = sum(n * posterior[p] for p, n in patterns.items()) / sum(patterns.values())
        w = np.zeros(DIMS + 1)
        w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return w
    return regress(x, y)


def score_of(text: Column, weights: np.ndarray) -> Column:
    """Score of a text, 0 to 1, high is good. Null counts as empty, which has no features but the constant."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out = [1 / (1 + np.exp(-(features(rows) @ weights))) for _, rows in _pieces(column)]
        return pa.array(np.concatenate(out).astype(float) if out else np.zeros(0))

    return score(F.coalesce(text, F.lit("")))


def scored(
    docs: DataFrame, weights: np.ndarray, text_col: str = "text", id_col: str = "doc_id", least: float = LEAST
) -> DataFrame:
    """id_col, score and kept (a score of at least ``least``) of every row; other columns are not looked at."""
    out = docs.select(F.col(id_col), score_of(F.col(text_col), weights).alias("score"))
    return out.withColumn("kept", F.col("score") >= least)


def without_rejected(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = LEAST, **options
) -> DataFrame:
    """The rows of ``docs`` that a scorer fitted on them keeps, all columns as they are, under any names."""
    return docs.where(score_of(F.col(text_col), fit(docs, text_col, id_col, **options)) >= least)
