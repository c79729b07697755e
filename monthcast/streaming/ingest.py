"""Ingest of arriving sales files as a stream of additive micro-batches, each file exactly once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from monthcast import settings as S
from monthcast.operators.cleaning import combine_parts, sales_parts
from monthcast.session import materialize
from monthcast.sources.files import children, exists, remove

RUN = "run"
BATCH = "batch"
FILE = "source_file"
DIGEST = "digest"


def sales_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = S.SALES_RAW,
    file_format: str = "csv",
    files_per_batch: int | None = None,
    **options,
) -> DataFrame:
    """Files below ``path`` as a stream, with each row's file as its path below ``path``; each file is read once.

    A stream needs its columns beforehand: ``schema`` lists them in the order
    of the files, and a header in another order is an error.
    """
    reader = spark.readStream.format(file_format).schema(schema)
    if file_format == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    reader = reader.options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    root = path.split(":", 1)[-1].strip("/") + "/"
    found = F.col("_metadata.file_path")
    below = F.substring_index(found, root, -1) if "*" not in root else found
    return reader.load(path).withColumn(FILE, below)


class KeyedTable:
    """A growing monthly table of sums that add up, one folder per micro-batch, and a ledger of the files taken.

    A batch stores, for each key and month it holds, the sum and count of its
    quantities and prices; reading adds the parts of a key up, so how files
    fall into batches does not matter, and a late month is taken at any age.

    A batch is named by its run, the stream with its checkpoint, and its
    number. Its parts are written first; its row in the ledger, written
    after them as one file, makes them count. A batch that dies in between is
    not read, and one that runs again overwrites its own folders. The ledger
    holds name and content digest of every file taken, under any run: such a
    file is skipped, so a fresh checkpoint, or files read again from an
    archive with the same layout, change nothing. A file of the same name
    with other lines is a new delivery.

    ``compact`` folds all parts so far into one folder and ``expire`` removes
    what it has replaced; reading costs what the table holds and what came
    since, not the number of batches.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("product_id",)):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def _read(self, path: str, schema: str) -> DataFrame:
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    @property
    def _part_schema(self) -> str:
        return ", ".join(f"`{k}` string" for k in self.keys) + ", MONAT date, units double, price_sum double, price_rows long"

    def _compaction(self) -> str | None:
        """Folder of the newest finished compaction."""
        done = [c for c in children(self.spark, f"{self.path}/compacted") if exists(self.spark, f"{c}/done")]
        return max(done, default=None)

    def _ledger(self) -> tuple[DataFrame, DataFrame]:
        """Rows of batches already folded, and of those since: run, batch, file, digest."""
        schema = f"{FILE} string, {DIGEST} string, {RUN} string, {BATCH} long"
        folder = self._compaction()
        folded = self._read(f"{folder}/ledger", schema) if folder else self.spark.createDataFrame([], schema)
        return folded, self._read(f"{self.path}/ledger", schema).join(folded.select(RUN, BATCH).distinct(), [RUN, BATCH], "left_anti")

    def parts(self) -> DataFrame:
        """The sums of every batch that counts, folded or not."""
        folder, (_, since) = self._compaction(), self._ledger()
        live = self._read(f"{self.path}/parts", f"{self._part_schema}, {RUN} string, {BATCH} long")
        live = live.join(since.select(RUN, BATCH).distinct(), [RUN, BATCH], "left_semi").drop(RUN, BATCH)
        return live.unionByName(self._read(f"{folder}/parts", self._part_schema)) if folder else live

    def read(self) -> DataFrame:
        """The monthly fact: quantity total and plain mean price per key and month."""
        return combine_parts(self.parts(), [*self.keys, "MONAT"])

    def add(
        self, lines: DataFrame, batch_id: int, date_formats: tuple[str, ...] = S.DATE_FORMATS, run: str = "once"
    ) -> None:
        """Store the parts of raw lines; files the ledger knows from another batch are left out.

        Lines without a file column are not checked: only the run and number
        of their batch tell them apart.
        """
        place = f"{RUN}=run-{run}/{BATCH}={int(batch_id)}"
        mark = self.spark.createDataFrame([(None, None)], f"{FILE} string, {DIGEST} string")
        if FILE in lines.columns:
            folded, since = self._ledger()
            other = ~((F.col(RUN) == f"run-{run}") & (F.col(BATCH) == int(batch_id)))
            known = folded.unionByName(since.where(other)).where(F.col(FILE).isNotNull()).select(FILE, DIGEST)
            new = materialize(file_digests(lines).join(known, [FILE, DIGEST], "left_anti"), "arrived")
            lines, mark = lines.join(new, FILE, "left_semi"), mark.unionByName(new)
        parts = sales_parts(lines, self.keys, date_formats=date_formats)
        parts.write.mode("overwrite").parquet(f"{self.path}/parts/{place}")
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/{place}")

    def compact(self) -> None:
        """Fold the batches in the ledger so far into one folder of sums, which counts with its last file.

        Batches that arrive meanwhile stay as they are. A compaction that
        dies is not read; the next one starts anew.
        """
        folded, since = self._ledger()
        last = self._compaction()
        target = f"{self.path}/compacted/{int(last.rsplit('/', 1)[-1]) + 1 if last else 1:08d}"
        folded.unionByName(since).write.mode("overwrite").parquet(f"{target}/ledger")
        batches = self.spark.read.parquet(f"{target}/ledger").select(RUN, BATCH).distinct()
        live = self._read(f"{self.path}/parts", f"{self._part_schema}, {RUN} string, {BATCH} long")
        live = live.join(batches, [RUN, BATCH], "left_semi")
        if last:
            live = live.join(folded.select(RUN, BATCH).distinct(), [RUN, BATCH], "left_anti").drop(RUN, BATCH)
            live = live.unionByName(self._read(f"{last}/parts", self._part_schema))
        sums = [F.sum(c).alias(c) for c in ("units", "price_sum", "price_rows")]
        live.groupBy(*self.keys, "MONAT").agg(*sums).write.mode("overwrite").parquet(f"{target}/parts")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{target}/done")

    def expire(self) -> int:
        """Remove the folders that the newest compaction has replaced, and compactions before it; how many.

        Readers that started before it must have ended. A batch that was
        folded and runs again finds its files in the folded ledger.
        """
        folder = self._compaction()
        if not folder:
            return 0
        gone = [c for c in children(self.spark, f"{self.path}/compacted") if c < folder]
        batches = self.spark.read.parquet(f"{folder}/ledger").select(RUN, BATCH).distinct()
        for r in batches.toLocalIterator():  # names only, one batch after the other
            gone += [f"{self.path}/{kind}/{RUN}={r[RUN]}/{BATCH}={r[BATCH]}" for kind in ("ledger", "parts")]
        return sum(remove(self.spark, path) for path in gone)


def file_digests(lines: DataFrame) -> DataFrame:
    """A digest of the lines of each file, in any order: (file, digest).

    Two sums of 64-bit hashes and the number of lines, so that no task holds
    a file and no order matters.
    """
    values = [F.col(f"`{c}`") for c in sorted(lines.columns) if c != FILE]
    row = [F.xxhash64(F.lit(i), *[F.struct(v.isNull(), v) for v in values]).cast("decimal(38,0)") for i in (1, 2)]
    found = lines.groupBy(FILE).agg(F.count("*").alias("n"), *[F.sum(r).alias(f"s{i}") for i, r in enumerate(row)])
    return found.select(FILE, F.sha2(F.concat_ws(":", "n", "s0", "s1"), 256).alias(DIGEST))


def ingest(
    stream: DataFrame,
    table: KeyedTable,
    checkpoint: str,
    date_formats: tuple[str, ...] = S.DATE_FORMATS,
) -> StreamingQuery:
    """Add everything that has arrived since the last run, then stop.

    The run is named by the id that Spark keeps in the checkpoint, so a fresh
    checkpoint, at whatever path, is a run of its own.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.read.json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]
        table.add(batch, batch_id, date_formats, run)

    return (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
