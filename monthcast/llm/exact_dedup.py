"""Exact deduplication: two passes around a Bloom filter of repeated hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthcast.llm.tables import stored

HASHES = 4
BITS_PER_ROW = 16
#: The filter never takes more than 32 MB; beyond 16 million rows it only
#: lets more rows shuffle that have no copy, and the result stays the same.
MOST_BITS = 1 << 28
#: Spark's bitmap functions keep this many bits in one row.
SEGMENT = 32768


def filter_bits(rows: int) -> int:
    wanted = max(SEGMENT, BITS_PER_ROW * rows)
    return min(MOST_BITS, 1 << (wanted - 1).bit_length())


def places(key: Column, bits: int) -> list[Column]:
    """The filter positions of a 64-bit key."""
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits).cast("long")) for i in range(HASHES)]


def repeated_bits(keys: DataFrame, bits: int) -> np.ndarray:
    """First pass: the positions that two or more rows hit, as a bit array of ``bits`` / 8 bytes.

    ``keys`` has one long column, key. Positions are counted with a partial
    count in every task, so no position is hot.
    """
    hit = keys.select(F.explode(F.array(*places(F.col("key"), bits))).alias("at"))
    twice = hit.groupBy("at").count().where("count > 1")
    number = F.col("at") + 1  # the bitmap functions count from 1
    segments = twice.groupBy(F.bitmap_bucket_number(number).alias("segment")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    )
    out = np.zeros(bits // 8 + SEGMENT // 8, np.uint8)
    for row in segments.toLocalIterator():  # at most bits / SEGMENT rows of 4 KB
        out[(row.segment - 1) * SEGMENT // 8 :][: SEGMENT // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def _perhaps(text: Column, docs: DataFrame) -> Column:
    """Second pass: whether a row's text may have a copy."""
    bits = filter_bits(docs.count())
    key = F.xxhash64(text)
    seen = docs.sparkSession.sparkContext.broadcast(repeated_bits(docs.select(key.alias("key")), bits))

    @F.pandas_udf("boolean")
    def look(*at: pd.Series) -> pd.Series:
        found = np.ones(len(at[0]), bool)
        for place in at:
            i = place.to_numpy()
            found &= (seen.value[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(found)

    return look(*places(key, bits))


def _groups(shared: DataFrame) -> DataFrame:
    """Largest id and size of each group of equal digests.

    Written, so that a join has a plain shuffle on either side and Spark can
    split a large group.
    """
    return stored(shared.groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("size")), "groups")


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalised: Column | None = None
) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when ``normalised`` (by default the text itself) has the
    same bytes; the SHA-256 digest decides, the filter only selects. Of equal
    texts the row with the largest id stays. Rows the filter proves to be
    alone never shuffle.

    Null text counts as empty. A null id is smaller than any other; in a
    group of null ids only, keep_id is null and kept is true. Rows repeated
    with the same id all count in group_size, and all of them are kept if
    their id stays. No rows give no rows. Other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col) if normalised is None else normalised, F.lit(""))
    marked = docs.select(
        F.col(id_col).alias("id"), F.sha2(text, 256).alias("digest"), _perhaps(text, docs).alias("perhaps")
    )
    marked = stored(marked, "digests")
    alone = marked.where(~F.col("perhaps")).select("id", "digest", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"))
    shared = marked.where("perhaps").drop("perhaps")
    every = alone.union(shared.join(_groups(shared), "digest").select("id", "digest", "keep", "size"))
    return every.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with every text once, all columns as they are.

    Of equal texts the row with the largest id stays, and one of rows
    repeated with that id. Null counts as empty, a null id as the smallest.
    Rows the filter proves to be alone pass without a shuffle. Columns may
    have any names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("id"),
        F.sha2(text, 256).alias("digest"),
        _perhaps(text, docs).alias("perhaps"),
    )
    shared = row.where("perhaps")
    keep = _groups(shared.select("id", "digest"))
    shared = shared.join(keep, "digest").where(F.col("id").eqNullSafe(F.col("keep")))
    first = Window.partitionBy("digest").orderBy("id")
    shared = shared.withColumn("n", F.row_number().over(first)).where("n = 1")
    return row.where(~F.col("perhaps")).select("row.*").union(shared.select("row.*"))
