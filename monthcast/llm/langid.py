"""Language identification: the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from monthcast.functions.skew import salted_lookup
from monthcast.llm.blocks import pack, unpack
from monthcast.llm.tables import bounded_batches, stored
from monthcast.llm.words import BYTE_BASE, chunks, hashed_places, texts

#: Length of the hashed vectors.
DIMS = 4096
#: Documents of a language from which its centroids are fitted, on average; all
#: training documents enter the document frequencies.
SAMPLE = 1500
CENTROIDS = 4
#: Languages whose centroids a task holds at once; with more, texts pass by blocks of them.
MOST_LANGUAGES = 1000
#: Blocks that texts pass in one go before they are written.
PASSED = 8
ROUNDS = 12
#: Below this cosine a document is marked as rejected.
LEAST = 0.15

IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[~IS_LETTER] = 32
FOLD[65:91] += 32


def counts(rows: list[bytes]) -> np.ndarray:
    """Counts of hashed runs of two and three bytes in each text, letters folded, all other ASCII taken as one space.

    A text counts with a space on either side, so that no run reaches into the next one.
    """
    data = FOLD[np.frombuffer(b"".join(b" %b " % r for r in rows) + b"  ", np.uint8)]
    begin = np.cumsum([0] + [len(r) + 2 for r in rows])
    doc = np.repeat(np.arange(len(rows)), np.diff(begin))
    blank = data == 32
    a, b, c = data[:-2].astype(np.uint32), data[1:-1].astype(np.uint32), data[2:].astype(np.uint32)
    place = np.empty((2, len(a)), np.int64)
    place[0] = hashed_places(16, BYTE_BASE[0], DIMS)[a << 8 | b]
    place[1] = hashed_places(24, BYTE_BASE[1], DIMS)[(a << 16) | (b << 8) | c]
    place += doc * DIMS
    used = np.stack([~(blank[:-2] & blank[1:-1]), ~(blank[1:-1] & (blank[:-2] | blank[2:]))])
    return np.bincount(place[used], minlength=len(rows) * DIMS).reshape(len(rows), DIMS)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1 (or 0 where nothing is counted)."""
    out = np.log1p(count).astype(np.float32) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    return chunks(texts(column), 1 << 20, 256)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with a task's document frequencies, and a row for each sampled document."""
    frequency, total = np.zeros(DIMS, np.int64), 0
    schema = pa.schema([("lang", pa.string()), ("data", pa.binary())])
    for batch in batches:
        lang, chosen = batch.column("lang"), batch.column("chosen").to_pylist()
        for first, rows in _pieces(batch.column("text")):
            count = counts(rows)
            frequency += (count > 0).sum(axis=0)
            total += len(rows)
            at = [i for i in range(len(rows)) if chosen[first + i]]
            data = [pack(np.flatnonzero(count[i]).astype(np.uint16), count[i][count[i] > 0].astype(np.uint32)) for i in at]
            yield pa.RecordBatch.from_arrays([lang.take(pa.array([first + i for i in at], pa.int64())), pa.array(data, pa.binary())], schema=schema)
    if total:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([pack(np.append(frequency, total))], pa.binary())], schema=schema)


def _centroids(sample: pa.Table, idf: np.ndarray, centroids: int, rounds: int) -> pa.Table:
    """Centroids of one language by k-means on the unit sphere, started from spread-out documents."""
    lang = sample["lang"][0].as_py()
    count = np.zeros((len(sample), DIMS), np.float32)
    for i, data in enumerate(sorted(sample["data"].to_pylist())):
        place, times = unpack(data)
        count[i, place] = times
    v = vectors(count, idf)
    middle = v.mean(axis=0)
    at = [int(np.argmax(v @ middle))]
    while len(at) < min(centroids, len(v)):
        at.append(int(np.argmin((v @ v[at].T).max(axis=1))))
    center = v[at]
    for _ in range(rounds):
        nearest = (v @ center.T).argmax(axis=1)
        for k in range(len(center)):
            if (nearest == k).any():
                center[k] = v[nearest == k].mean(axis=0)
        center /= np.maximum(np.linalg.norm(center, axis=1, keepdims=True), 1e-12)
    data = [pack(c.astype(np.float32)) for c in center]
    return pa.table({"lang": pa.array([lang] * len(data), pa.string()), "data": pa.array(data, pa.binary())})


class Model:
    """Inverse document frequencies, and a written table of centroids: block, lang, data."""

    def __init__(self, idf: np.ndarray, table: DataFrame, blocks: int):
        self.idf, self.table, self.blocks = idf, table, blocks

    def block(self, number: int) -> tuple[list[str], np.ndarray]:
        """Languages and vectors of one block, by language; the driver holds one block at a time."""
        found = sorted((r.lang, bytes(r.data)) for r in self.table.where(F.col("block") == number).collect())
        center = np.stack([unpack(d)[0] for _, d in found]) if found else np.zeros((0, DIMS), np.float32)
        return [lang for lang, _ in found], center


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    sample: int = SAMPLE, centroids: int = CENTROIDS, rounds: int = ROUNDS,
) -> Model:
    """Learn from the rows whose language and text are not null; other columns may have any names.

    Document frequencies cover all rows. Centroids are fitted per language on
    a sample of about ``sample`` rows chosen by a hash of id and text; all rows
    of a language with fewer. The driver receives one vector of fixed length
    here; centroids stay in a table, in blocks of about ``MOST_LANGUAGES``
    languages at most. No rows give a model without languages.
    """
    bounded_batches(docs.sparkSession)
    dice = F.pmod(F.xxhash64(F.lit(3), F.col(id_col), F.xxhash64(text_col)), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), dice.alias("dice"))
    rows = rows.where("text is not null and lang is not null")
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("size")), "languages")
    languages = sizes.count()
    if languages <= MOST_LANGUAGES:  # a language may hold most texts, which stay where they are
        sized = rows.join(F.broadcast(sizes), "lang")
    else:
        sized = salted_lookup(rows, sizes, ["lang"], ["dice"], how="inner")
    rows = sized.select("lang", "text", (F.col("dice") < sample / F.col("size")).alias("chosen"))
    learnt = stored(rows.mapInArrow(_learn, "lang string, data binary"), "langid")
    # A row of DIMS numbers from each task: summed by place, DIMS rows reach the driver.
    sums = learnt.where("lang is null").mapInArrow(_add_up, "place int, total long")
    total = np.zeros(DIMS + 1, np.int64)
    for row in sums.groupBy("place").agg(F.sum("total").alias("total")).toLocalIterator():
        total[row.place] = row.total
    idf = (np.log((1 + total[-1]) / (1 + total[:-1])) + 0.05).astype(np.float32)
    found = (
        learnt.where("lang is not null")
        .groupBy("lang")
        .applyInArrow(lambda t: _centroids(t, idf, centroids, rounds), "lang string, data binary")
    )
    # By hash, so half full on average: no order over all languages is needed.
    blocks = -(-languages // MOST_LANGUAGES) if languages <= MOST_LANGUAGES else -(-2 * languages // MOST_LANGUAGES)
    block = F.pmod(F.xxhash64("lang"), F.lit(max(1, blocks))).cast("int")
    return Model(idf, stored(found.withColumn("block", block), "centroids"), blocks)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMS + 1, np.int64)
    for batch in batches:
        for data in batch.column("data").to_pylist():
            total += unpack(data)[0]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1), pa.int32()), pa.array(total)], ["place", "total"])


def predicted(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", least: float = LEAST) -> DataFrame:
    """id_col, lang_pred, score, rejected of every row, from its text alone.

    ``lang_pred`` is the language of the centroid with the largest cosine,
    the smaller name on a tie, and ``score`` that cosine. A text that is null
    or has no letter gets ``und`` and 0, as does every text if the model has
    no language. ``rejected`` is true below ``least``, when no centroid is
    near. Repeated rows and null ids keep a row each.

    A text passes the blocks of centroids one after the other and keeps the
    best so far; after every ``PASSED`` blocks the texts are written with it.
    """
    spark = docs.sparkSession
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    lettered = F.when(text.rlike(r"\p{L}"), text)  # null where there is nothing to tell from
    none = (F.lit(None).cast("string").alias("lang"), F.lit(-1.0).alias("score"))
    rows = docs.select(F.col(id_col).alias("id"), lettered.alias("text"))
    out = rows.where("text is not null").select("id", "text", *none)
    for number in range(model.blocks):
        # Vectors of fixed length for about MOST_LANGUAGES languages at most.
        shared = spark.sparkContext.broadcast((model.idf, *model.block(number)))
        last = number == model.blocks - 1
        columns = f"id {kind}, lang string, score double" + ("" if last else ", text string")
        out = out.mapInArrow(_nearest(shared, id_type, not last), columns)
        if not last and (number + 1) % PASSED == 0:
            out = stored(out, "langid-best")
    rest = rows.where("text is null").select("id", *none)
    out = out.select("id", "lang", "score").union(rest)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("lang", F.lit("und")).alias("lang_pred"),
        score.alias("score"),
        (score < least).alias("rejected"),
    )


def _nearest(
    shared: Broadcast, id_type: pa.DataType, with_text: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text's best of what it had and the centroids of one block."""
    fields = [("id", id_type), ("lang", pa.string()), ("score", pa.float64()), *([("text", pa.string())] if with_text else [])]

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, langs, center = shared.value
        for batch in batches:
            for first, rows in _pieces(batch.column("text")):
                part = batch.slice(first, len(rows))
                lang, score = part.column("lang").to_pylist(), part.column("score").to_numpy().copy()
                if langs:
                    cosine = vectors(counts(rows), idf) @ center.T
                    at = cosine.argmax(axis=1)
                    now = cosine[np.arange(len(rows)), at].astype(float)
                    for i in np.flatnonzero(now >= score):
                        if now[i] > score[i] or langs[at[i]] < lang[i]:
                            lang[i], score[i] = langs[at[i]], now[i]
                arrays = [part.column("id").cast(id_type), pa.array(lang, pa.string()), pa.array(score)]
                if with_text:
                    arrays.append(part.column("text").cast(pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

    return best_of


def held_out(id_: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out, then predict all of them."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predicted(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )
