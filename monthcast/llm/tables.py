"""Input tables, intermediate tables and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthcast.session import scratch_path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder, compressed, and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, *parts: str) -> DataFrame:
    """The same, bucketed by ``key``: later joins on it leave these rows where they are.

    There are as many buckets as shuffle partitions, so the other side of a
    join meets them without a new shuffle of this one.
    """
    return by_key(df, name, key, *parts, path=scratch_path(df.sparkSession, name))


def by_key(df: DataFrame, name: str, key: str, *parts: str, path: str) -> DataFrame:
    """``stored_by`` in a folder that the caller names."""
    spark = df.sparkSession
    found = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").option("path", path)
    if parts:
        writer = writer.partitionBy(*parts)
    writer.bucketBy(partitions(spark), key).saveAsTable(found)
    return spark.table(found)


def bounded_batches(spark: SparkSession) -> None:
    """From now on batches for Python tasks end at 4 MB, however long their rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table written here go as soon as it is written.

    Otherwise they stay until the driver's next garbage collection, so a job
    of several steps may hold those of all steps at once. For frames that are
    run once: one that is run again makes its shuffles again.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def words_of(text: Column) -> Column:
    """Number of words, runs of anything but the six ASCII white-space characters; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def connected(edges: DataFrame) -> DataFrame:
    """Component of every node of an undirected graph: (node, component), the smallest node.

    ``edges`` has the long columns u and v; nodes without an edge do not
    appear. Alternating large-star and small-star steps shrink the graph to
    stars in a number of rounds logarithmic in its diameter. What a step
    joins is written to the shared folder first; the driver sees two sums a
    round. A hub is a hot key of the joins only: both sides are shuffled
    there, so Spark can split it at run time.
    """
    pair = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = stored(pair.distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "lowest")
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = stored(large.where(F.col("u") != F.col("v")).distinct(), "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("low")), "lowest")
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
        now = stored(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.union(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum that changes with any of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
