"""Outlier filters with exact quantiles that never gather a column in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthcast.functions.skew import salted_lookup
from monthcast.session import materialize

SKETCH_ACCURACY = 10_000
SKETCH_SLACK = 5.0 / SKETCH_ACCURACY
# Equal parts of a bracket, whose counts are added up before any value is ranked.
CELLS = 4096
SALTS = 16


def _attach(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], spread_by: str, salts: int = SALTS
) -> DataFrame:
    """Column ``_s``: the key's row of ``stats``, or its only row without keys."""
    fields = F.struct(*[c for c in stats.columns if c not in keys]).alias("_s")
    stats = stats.select(*keys, fields)
    if keys:
        return salted_lookup(df, stats, keys, [spread_by], salts)
    return df.withColumn("_s", stats.scalar())


def exact_quantiles(
    df: DataFrame, column: str, probs: Sequence[float], keys: Sequence[str] = (), salts: int = SALTS
) -> DataFrame:
    """Linearly interpolated quantiles ``q0, q1, ...`` per key (one row without keys).

    A mergeable sketch brackets every quantile between two values. What lies
    below a bracket is only counted. The bracket is cut into ``CELLS`` equal
    parts, whose running counts tell the cell of a rank, and only the distinct
    values of that cell are ranked. So no task holds a column or a bracket,
    and a value with many copies is one row. A rank next to a bracket, as in
    short columns, is the largest value below or the least above it.
    """
    keys = list(keys)
    known = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_x"))
    sketch = lambda ps: F.percentile_approx("_x", ps, SKETCH_ACCURACY)
    brackets = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        sketch([max(p - SKETCH_SLACK, 0.0) for p in probs]).alias("lo"),
        sketch([min(p + SKETCH_SLACK, 1.0) for p in probs]).alias("hi"),
    )
    # Written: brackets and values are read for the counts below and for the values inside.
    brackets = materialize(brackets, "brackets")
    copies = materialize(known.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_copies")), "copies")
    values = _attach(copies, brackets, keys, "_x", salts)

    def around(i):
        low, high = F.col("_s.lo")[i], F.col("_s.hi")[i]
        rank = F.lit(float(probs[i])) * (F.max("_s.n") - 1)
        return F.struct(
            F.lit(i).alias("p"),
            rank.alias("rank"),
            F.coalesce(F.sum(F.when(F.col("_x") < low, F.col("_copies"))), F.lit(0)).alias("below"),
            F.max(F.when(F.col("_x") < low, F.col("_x"))).alias("previous"),
            F.min(F.when(F.col("_x") > high, F.col("_x"))).alias("following"),
        ).alias(f"_t{i}")

    targets = values.groupBy(*keys).agg(*[around(i) for i in range(len(probs))])
    targets = targets.select(*keys, F.inline(F.array(*[f"_t{i}" for i in range(len(probs))])))
    targets = materialize(targets, "ranks")

    which = F.array(*[F.struct(F.lit(i).alias("p"), F.col("_s.lo")[i].alias("lo"), F.col("_s.hi")[i].alias("hi")) for i in range(len(probs))])
    inside = values.select(*keys, "_x", "_copies", F.explode(which).alias("_t")).where(
        F.col("_x").between(F.col("_t.lo"), F.col("_t.hi"))
    )
    part = F.coalesce(F.try_divide(F.col("_x") - F.col("_t.lo"), F.col("_t.hi") - F.col("_t.lo")), F.lit(0.0))
    cell = F.least(F.floor(part * CELLS), F.lit(CELLS - 1)).cast("int")
    inside = inside.select(*keys, F.col("_t.p").alias("p"), cell.alias("_cell"), "_x", "_copies")
    sizes = inside.groupBy(*keys, "p", "_cell").agg(F.sum("_copies").alias("_size"))
    upto = F.sum("_size").over(Window.partitionBy(*keys, "p").orderBy("_cell"))
    sizes = sizes.withColumn("_start", upto - F.col("_size")).join(targets, [*keys, "p"])
    sizes = sizes.withColumn("_start", F.col("_start") + F.col("below"))
    end = F.col("_start") + F.col("_size")
    holds = (F.ceil("rank") >= F.col("_start")) & (F.floor("rank") < end)
    hit = sizes.where(holds).select(*keys, "p", "_cell", "_start", "rank")
    ranked = inside.join(hit, [*keys, "p", "_cell"])
    order = Window.partitionBy(*keys, "p", "_cell").orderBy("_x")
    ranked = ranked.withColumn("_upto", F.col("_start") + F.sum("_copies").over(order))

    def value_at(rank):
        here = (F.col("_upto") - F.col("_copies") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(here, F.col("_x")))

    found = ranked.groupBy(*keys, "p").agg(
        value_at(F.floor("rank")).alias("_a"), value_at(F.ceil("rank")).alias("_b")
    )
    joined = targets.join(found, [*keys, "p"], "left")
    lost = F.raise_error(F.lit("quantile outside its bracket")).cast("double")
    low = F.coalesce("_a", F.when(F.floor("rank") < F.col("below"), F.col("previous")), lost)
    high = F.coalesce("_b", F.when(F.ceil("rank") < F.col("below"), F.col("previous")).otherwise(F.col("following")), lost)
    quantiles = joined.withColumn("_q", low + (high - low) * (F.col("rank") - F.floor("rank")))
    return quantiles.groupBy(*keys).agg(
        *[F.max(F.when(F.col("p") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(probs))]
    )


def filter_outliers(
    df: DataFrame,
    column: str,
    method: str = "iqr",
    factor: float = 1.5,
    keys: Sequence[str] = (),
    salts: int = SALTS,
) -> DataFrame:
    """Rows whose value is no outlier, over the table or per key.

    ``salts`` spreads the rows of large keys; 1 suits many small keys.

    ``iqr`` keeps [Q1 - f*IQR, Q3 + f*IQR]; ``zscore`` keeps at most ``f``
    sample standard deviations from the mean. Nulls are dropped, and a column
    without spread keeps nothing under ``zscore``.
    """
    value = F.col(column)
    if method == "iqr":
        stats = materialize(exact_quantiles(df, column, (0.25, 0.75), keys, salts), "quantiles")
        spread = F.col("_s.q1") - F.col("_s.q0")
        kept = (value >= F.col("_s.q0") - factor * spread) & (value <= F.col("_s.q1") + factor * spread)
    elif method == "zscore":
        stats = df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
        kept = F.abs(F.try_divide(value - F.col("_s.mean"), F.col("_s.std"))) <= factor
    else:
        raise ValueError("method must be 'iqr' or 'zscore'")
    return _attach(df, stats, list(keys), column, salts).where(kept).drop("_s")
