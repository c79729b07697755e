"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_lookup(
    facts: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    salts: int = 16,
    how: str = "left",
    hot: Column | None = None,
) -> DataFrame:
    """Attach ``table`` (one row per key, much smaller than ``facts``).

    The rows of each key are spread over ``salts`` join keys by a hash of
    ``spread_by``, which is stable when a lost task runs again; the table is
    repeated once per salt. With ``hot``, a condition on the keys, only those
    keys are spread and repeated. Spark still broadcasts a table it sees to
    be small.
    """
    zero, last = F.lit(0).cast("long"), F.lit(salts - 1).cast("long")
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
    if hot is not None:
        spread, last = F.when(hot, spread).otherwise(zero), F.when(hot, last).otherwise(zero)
    repeated = table.withColumn("_salt", F.explode(F.sequence(zero, last)))
    return facts.withColumn("_salt", spread).join(repeated, [*keys, "_salt"], how).drop("_salt")
