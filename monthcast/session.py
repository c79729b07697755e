"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "monthcast", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and skew handling on, in UTC.

    Call sites are not recorded for every column expression: that takes most
    of the time it takes to build a wide plan.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster shares for intermediate tables, from ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The table written to the shared folder and read back.

    For tables that several later steps read: it cuts the lineage, survives
    lost executors, and lets every reader prune columns and partitions.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clustered(df: DataFrame, name: str, key: str) -> DataFrame:
    """The table written to the shared folder in as many buckets of ``key`` as there are shuffle partitions.

    Windows, sums and joins on the key then leave its rows where they are.
    """
    spark = df.sparkSession
    found = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").option("path", scratch_path(spark, name))
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(found)
    return spark.table(found)


#: Rows of a keyed table that one task sorts.
ROWS_A_TASK = 250_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The table written, and dealt by ``keys`` into tasks whose number grows with its rows.

    For steps that sort all rows of their keys several times over: the number
    of shuffle partitions is fixed, so with it a task's memory would grow
    with the input. A table that these partitions hold in small tasks is left
    to adaptive execution.
    """
    return spread(materialize(df, "dealt"), *keys)


def dealt_to_buckets(df: DataFrame, *keys: str) -> DataFrame:
    """``dealt`` for rows that are ``clustered`` by the same key after: each task's rows lie in one bucket, one file."""
    return spread(materialize(df, "dealt"), *keys, buckets=True)


def spread(rows: DataFrame, *keys: str, buckets: bool = False) -> DataFrame:
    """``dealt`` for a table that is written already; for ``buckets`` their number divides that of the tasks."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = -(-rows.count() // ROWS_A_TASK)
    if tasks <= least:
        return rows
    return rows.repartition(-(-tasks // least) * least if buckets else tasks, *keys)
