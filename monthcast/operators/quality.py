"""Data-quality checks and profiles, each returned as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthcast.functions.scalars import lenient_date


def missing_share(df: DataFrame) -> DataFrame:
    """Percentage of nulls per column, two decimals; null for an empty table."""
    size = F.count(F.lit(1))
    shares = df.agg(
        *[
            F.bround(F.try_divide(F.count_if(F.col(c).isNull()), size) * 100, 2).alias(c)
            for c in df.columns
        ]
    )
    return shares.unpivot([], df.columns, "column_name", "missing_pct")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier identical row (nulls are equal)."""
    copies = df.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return copies.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_rows"))


def date_range(df: DataFrame) -> DataFrame:
    """First and last date, and the span in 30-day months.

    Looks at the first column with "date" or "monat" in its name; without one,
    or without a readable date in it, there is no row.
    """
    names = [c for c in df.columns if "date" in c.lower() or "monat" in c.lower()]
    if not names:
        return df.sparkSession.createDataFrame([], "start date, end date, span_months bigint")
    return (
        df.select(lenient_date(names[0]).alias("d"))
        .agg(F.min("d").alias("start"), F.max("d").alias("end"))
        .where(F.col("start").isNotNull())
        .withColumn("span_months", F.floor(F.datediff("end", "start") / 30))
    )


def quality_report(
    df: DataFrame, required: Sequence[str] = (), expected: Mapping[str, str] | None = None
) -> DataFrame:
    """All measures of one table in one pass: rows of (measure, column_name, value as text).

    ``total_rows``, ``duplicate_rows`` (rows that repeat an earlier identical
    one), per column ``missing_pct`` (two decimals, null for an empty table)
    and ``data_type``, ``start``, ``end`` and ``span_months`` of the first
    column with "date" or "monat" in its name that has a readable date,
    ``missing_column`` for each required column the table lacks, and
    ``wrong_type`` (value: the type found) for each column whose type is not
    the expected one. Identical rows are counted once by the map side, so
    copies cost nothing further.
    """
    n = F.col("_n")
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    dates = [c for c in df.columns if "date" in c.lower() or "monat" in c.lower()][:1]
    total = F.coalesce(F.sum(n), F.lit(0).cast("long"))
    missing = {
        c: F.bround(F.try_divide(F.sum(F.when(F.col(c).isNull(), n).otherwise(0)), F.sum(n)) * 100, 2)
        for c in df.columns
    }
    out = [("total_rows", None, total), ("duplicate_rows", None, F.coalesce(F.sum(n - 1), F.lit(0).cast("long")))]
    out += [("missing_pct", c, share) for c, share in missing.items()]
    for c in dates:
        first, last = F.min(lenient_date(c)), F.max(lenient_date(c))
        out += [("start", c, first), ("end", c, last)]
        out += [("span_months", c, F.floor(F.datediff(last, first) / 30))]
    types = dict(df.dtypes)
    out += [("data_type", c, F.lit(t)) for c, t in types.items()]
    out += [("missing_column", c, F.lit(None)) for c in required if c not in types]
    out += [("wrong_type", c, F.lit(types[c])) for c, t in (expected or {}).items() if types.get(c, t) != t]
    values = copies.agg(*[v.cast("string").alias(f"v{i}") for i, (_, _, v) in enumerate(out)])
    lines = [
        F.struct(F.lit(m).alias("measure"), F.lit(c).cast("string").alias("column_name"), F.col(f"v{i}").alias("value"))
        for i, (m, c, _) in enumerate(out)
    ]
    lines = values.select(F.inline(F.array(*lines)))
    return lines.where(F.col("value").isNotNull() | ~F.col("measure").isin("start", "end", "span_months"))


def duplicate_months(df: DataFrame) -> DataFrame:
    """Months that occur in several rows of one product."""
    return (
        df.groupBy("product_id", "MONAT")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
    )


def dataset_profile(df: DataFrame) -> DataFrame:
    """Products, rows, first and last month of a sales table."""
    per_product = df.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("MONAT").alias("a"), F.max("MONAT").alias("b")
    )
    return per_product.agg(
        F.count("product_id").alias("num_products"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_records"),
        F.min("a").alias("start"),
        F.max("b").alias("end"),
    )


HASH_BUCKET_DIGITS = 3
LANES = 4
LANE_DIGITS = 7


def _lane(digest: Column, i: int) -> Column:
    start = HASH_BUCKET_DIGITS + 1 + i * LANE_DIGITS
    return F.conv(F.substring(digest, start, LANE_DIGITS), 16, 10).cast("bigint")


def _marked(text: Column) -> Column:
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


SUMS = ("n", *[f"s{i}" for i in range(LANES)])


def fingerprint_sums(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """At most 4096 rows (bucket, n, s0..): the rows' hashes summed by their leading digits.

    Sums of two tables add up to those of both (``added_sums``), so what
    arrives is hashed alone. Seven digits a lane leave room for 10^14 rows.
    Every value stands after its length, and null has a mark of its own, so
    values cannot run into each other.
    """
    columns = list(columns or df.columns)
    digest = F.md5(F.concat(*[_marked(F.col(c).cast("string")) for c in columns]).cast("binary"))
    return (
        df.select(digest.alias("h"))
        .groupBy(F.substring("h", 1, HASH_BUCKET_DIGITS).alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(_lane(F.col("h"), i)).alias(f"s{i}") for i in range(LANES)],
        )
    )


def added_sums(sums: DataFrame) -> DataFrame:
    """Sums of several tables, one below the other, as those of all their rows."""
    return sums.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in SUMS])


def fingerprint_of(sums: DataFrame) -> DataFrame:
    """The md5 of the at most 4096 sums, which is all that leaves the executors."""
    line = F.concat_ws(":", "bucket", *SUMS)
    return sums.agg(
        F.md5(F.array_join(F.sort_array(F.collect_list(line)), ",").cast("binary")).alias("fingerprint")
    )


def content_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One md5 that is equal exactly when two tables hold the same rows.

    Every row is hashed; the hashes are summed (``fingerprint_sums``), which
    ignores row order but not copies, and the sums are hashed together.
    """
    return fingerprint_of(fingerprint_sums(df, columns))
