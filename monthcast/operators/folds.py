"""Time-ordered cross-validation folds at product, category and global level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthcast import settings as S
from monthcast.functions.skew import salted_lookup
from monthcast.session import clustered, materialize

FOLDS = 3
LEVELS = ("global", "category", "product")
BUCKET_DIGITS = 2


def with_level_keys(rows: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """One copy of each row per level; rows without a category skip that level."""
    keys = {
        "global": F.lit("all"),
        "category": F.col("product_category_id"),
        "product": F.col("product_id"),
    }
    pairs = F.array(*[F.struct(F.lit(lv).alias("level"), keys[lv].alias("key")) for lv in levels])
    return (
        rows.withColumn("_lk", F.explode(pairs))
        .select("*", "_lk.level", "_lk.key")
        .drop("_lk")
        .where(F.col("key").isNotNull())
    )


def with_product_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_md5", F.md5(F.col("product_id").cast("binary")))


def time_rank(rows: DataFrame) -> DataFrame:
    """Position ``r`` (from 0) of each row within its level and key, and their size ``n``.

    Rows are ordered by month, and within a month by the md5 of the product
    id. A category or the whole table is never sorted in one task: its rows
    are ranked inside (month, leading md5 digits) cells, and running counts
    over the cells, at most 256 per month, give each cell its start. A
    product, with one row per month, is a single cell.
    """
    cell = ["level", "key", "_month", "_cell"]
    whole = F.col("level") == "product"
    hashed = (
        (rows if "_md5" in rows.columns else with_product_hash(rows))
        .withColumn("_cell", F.when(whole, "").otherwise(F.substring("_md5", 1, BUCKET_DIGITS)))
        .withColumn("_month", F.when(whole, F.lit("1900-01-01").cast("date")).otherwise(F.col("MONAT")))
    )
    sizes = hashed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_size"))
    model = Window.partitionBy("level", "key")
    starts = sizes.select(
        *cell,
        (F.sum("_size").over(model.orderBy("_month", "_cell")) - F.col("_size")).alias("_start"),
        F.sum("_size").over(model).alias("n"),
    )
    inside = Window.partitionBy(*cell).orderBy("MONAT", "_md5", "product_id")
    return (
        hashed.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(starts, cell)
        .withColumn("r", F.col("_start") + F.col("_inside"))
        .drop("_md5", "_cell", "_month", "_inside", "_start")
    )


def product_rank(rows: DataFrame) -> DataFrame:
    """``time_rank`` for keys with one row per month, which one window ranks and counts."""
    key = Window.partitionBy("level", "key")
    return rows.withColumns(
        {
            "r": F.row_number().over(key.orderBy("MONAT", "_md5", "product_id")) - 1,
            "n": F.count(F.lit(1)).over(key),
        }
    ).drop("_md5")


def fold_of(r: Column, n: Column, folds: int = FOLDS) -> Column:
    """Fold a row is tested in: 1..folds, or 0 for rows that only train.

    Each fold tests n div (folds+1) rows and trains on all rows before them;
    shorter groups than folds+1 rows have no folds (null).
    """
    size = F.floor(n / (folds + 1))
    first = n - folds * size
    return F.when(size < 1, None).when(r < first, 0).otherwise(1 + F.floor((r - first) / size)).cast("int")


def with_folds(
    rows: DataFrame,
    levels: Sequence[str] = LEVELS,
    min_rows: int = S.MIN_HISTORY_MONTHS,
    folds: int = FOLDS,
) -> DataFrame:
    """Rows per level and key with their ``fold``.

    Category and product keys need ``min_rows`` rows, and every key enough
    rows to be split; other keys have no model of their own.
    """
    hashed = with_product_hash(rows)
    parts = [product_rank(with_level_keys(hashed, ["product"]))] if "product" in levels else []
    wide = [level for level in levels if level != "product"]
    if wide:
        parts.append(time_rank(with_level_keys(hashed, wide)))
    ranked = reduce(DataFrame.unionByName, parts)
    enough = (F.col("level") == "global") | (F.col("n") >= min_rows)
    return ranked.where(enough).withColumn("fold", fold_of(F.col("r"), F.col("n"), folds)).where(
        F.col("fold").isNotNull()
    )


def fold_columns(
    rows: DataFrame,
    levels: Sequence[str] = LEVELS,
    min_rows: int = S.MIN_HISTORY_MONTHS,
    folds: int = FOLDS,
) -> DataFrame:
    """The folds of ``with_folds`` as one column ``fold_<level>`` a level; null where the key has no model.

    The rows are written once, clustered by product, in whose partitions a
    product is ranked. Category and whole need no rank of every row: a row's
    fold follows from its place before or after the first row of each fold,
    three rows a key, so the rows themselves do not move.
    """
    key = Window.partitionBy("product_id")
    r, n = F.row_number().over(key.orderBy("MONAT")) - 1, F.count(F.lit(1)).over(key)
    ranked = rows.withColumn("_r", r)
    if "product" in levels:
        enough = F.col("product_id").isNotNull() & (F.col("_n") >= min_rows)
        fold = F.when(enough, fold_of(F.col("_r"), F.col("_n"), folds))
        ranked = ranked.withColumn("_n", n).withColumn("fold_product", fold).drop("_n")
    table = clustered(ranked, "folds", "product_id")
    wide = [level for level in levels if level != "product"]
    if not wide:
        return table.drop("_r")
    placed = table.withColumn("_place", _place())
    bounds = materialize(_first_rows(table, wide, min_rows, folds), "bounds")
    names = [f"_first_{f}" for f in range(1, folds + 1)]
    passed = sum((F.col(f"_first.{name}") <= F.col("_place")).cast("int") for name in names)
    for level in wide:
        own = bounds.where(F.col("level") == level)
        if level == "global":
            placed = placed.withColumn("_first", own.select(F.struct(*names)).scalar())
        else:
            own = own.select(F.col("key").alias("product_category_id"), F.struct(*names).alias("_first"))
            placed = salted_lookup(placed, own, ["product_category_id"], ["product_id"])
        known = F.col("_first").isNotNull() & F.col("product_id").isNotNull() & F.col("MONAT").isNotNull()
        placed = placed.withColumn(f"fold_{level}", F.when(known, passed)).drop("_first")
    return placed.drop("_r", "_place")


def _place() -> Column:
    """What orders rows within a category or the whole; nulls come first."""
    return F.struct(
        F.coalesce("MONAT", F.lit("0001-01-01").cast("date")).alias("month"),
        F.coalesce(F.md5(F.col("product_id").cast("binary")), F.lit("")).alias("md5"),
        F.coalesce("product_id", F.lit("")).alias("product_id"),
        F.col("_r").alias("r"),
    )


def _first_rows(table: DataFrame, levels: Sequence[str], min_rows: int, folds: int) -> DataFrame:
    """The place of the first row of each fold, for every category and the whole that has folds.

    Counts of (month, leading md5 digits) cells tell which cell it lies in;
    only the rows of these cells, at most ``folds`` of a key, are ranked.
    """
    cell = ["level", "key", "_month", "_cell"]
    rows = with_level_keys(table.select("product_id", "product_category_id", "MONAT", "_r"), levels)
    rows = rows.select("level", "key", _place().alias("_place")).withColumns(
        {"_month": F.col("_place.month"), "_cell": F.substring("_place.md5", 1, BUCKET_DIGITS)}
    )
    model = Window.partitionBy("level", "key")
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_size")).withColumns(
        {
            "_start": F.sum("_size").over(model.orderBy("_month", "_cell")) - F.col("_size"),
            "_n": F.sum("_size").over(model),
        }
    )
    share = F.floor(F.col("_n") / (folds + 1))
    enough = (share >= 1) & ((F.col("level") == "global") | (F.col("_n") >= min_rows))
    fold = F.explode(F.sequence(F.lit(1), F.lit(folds)))
    at = F.col("_n") - (folds + 1 - F.col("fold")) * share - F.col("_start")
    sought = cells.where(enough).withColumn("fold", fold).withColumn("_at", at)
    sought = materialize(sought.where(F.col("_at").between(0, F.col("_size") - 1)).select(*cell, "fold", "_at"), "cells")
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("_place")) - 1
    ranked = rows.join(sought.select(*cell).distinct(), cell, "left_semi").withColumn("_inside", inside)
    found = ranked.join(sought, cell).where(F.col("_inside") == F.col("_at"))
    return found.groupBy("level", "key").agg(
        *[F.max(F.when(F.col("fold") == f, F.col("_place"))).alias(f"_first_{f}") for f in range(1, folds + 1)]
    )


def level_rows(table: DataFrame, levels: Sequence[str] = LEVELS, **values: Mapping[str, Column]) -> DataFrame:
    """Rows of ``fold_columns`` per level and key with ``fold``; ``values`` name further columns that differ by level."""
    keys = {"global": F.lit("all"), "category": F.col("product_category_id"), "product": F.col("product_id")}

    def own(level):
        more = [of[level].alias(name) for name, of in values.items()]
        return [F.lit(level).alias("level"), keys[level].alias("key"), F.col(f"fold_{level}").alias("fold"), *more]

    rest = [c for c in table.columns if c not in [f"fold_{level}" for level in LEVELS]]
    if len(levels) == 1:  # without copies rows stay clustered by their key
        return table.select(*rest, *own(levels[0])).where(F.col("fold").isNotNull())
    copies = F.inline(F.array(*[F.struct(*own(level)) for level in levels]))
    return table.select(*rest, copies).where(F.col("fold").isNotNull())


def fold_ranges(folded: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Per fold: training and test row counts and the test months.

    Training counts are running totals over the (at most folds+1) fold sizes
    of a key, so no row is repeated per fold.
    """
    sizes = folded.groupBy("level", "key", "fold").agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.min("MONAT").alias("test_from"),
        F.max("MONAT").alias("test_to"),
    )
    upto = Window.partitionBy("level", "key").orderBy("fold")
    return sizes.withColumn("train_rows", F.sum("test_rows").over(upto) - F.col("test_rows")).where(
        F.col("fold") > 0
    )
