"""Monthly series: calendar gap fill, positions and year-over-year change."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthcast.functions.scalars import month_number, month_start, signed_percent
from monthcast.session import dealt

ONE_MONTH = "interval 1 month"


def month_calendar(df: DataFrame) -> DataFrame:
    """Every calendar month from a product's first to its last row."""
    return (
        df.groupBy("product_id")
        .agg(F.min("MONAT").alias("_a"), F.max("MONAT").alias("_b"))
        .select(
            "product_id",
            F.explode(F.expr(f"sequence(_a, _b, {ONE_MONTH})")).alias("MONAT"),
        )
    )


def join_calendar(df: DataFrame) -> DataFrame:
    """The calendar with the observed rows joined on; missing months are null."""
    return month_calendar(df).join(df, ["product_id", "MONAT"], "left")


def fill_month_gaps(
    df: DataFrame, value: str = "anz_produkt", carry: Sequence[str] = (), deal: Callable[..., DataFrame] = dealt
) -> DataFrame:
    """One row per calendar month, with positions ``t`` (from 0) and length ``n``.

    A month without a row repeats the last known value, leading unknowns take
    the first known one, and a series that knows none is 0. Rows that are no
    month start drop out, except for a single-row product, which stays as is.

    Each row covers the months up to the next row, so the calendar needs no
    join: one shuffle by product, into tasks of bounded size (``dealt``), then
    windows and an explode. With ``spread`` to ``deal`` them, rows of a table
    that is written already are not written again for that.
    """
    by_product = Window.partitionBy("product_id")
    ordered = by_product.orderBy("MONAT")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)

    start = month_start("MONAT")
    is_start = F.col("MONAT") == start
    next_start = F.when(is_start, start).otherwise(F.add_months(start, 1))
    marked = deal(df.select("product_id", "MONAT", value, *carry), "product_id").select(
        "*",
        F.count(F.lit(1)).over(whole).alias("_rows"),
        F.min(next_start).over(whole).alias("_from"),
        F.max(start).over(whole).alias("_to"),
        F.sum(is_start.cast("int")).over(whole).alias("_starts"),
        F.row_number().over(ordered).alias("_pos"),
    )
    single = F.col("_rows") == 1
    stand_in = (F.col("_starts") == 0) & (F.col("_pos") == 1)
    kept = marked.where(single | ((F.col("_from") <= F.col("_to")) & (is_start | stand_in))).withColumn(
        value, F.when(single | is_start, F.col(value))
    )
    spans = kept.select(
        "product_id",
        *carry,
        "_from",
        "_to",
        F.coalesce(
            F.last(value, ignorenulls=True).over(upto),
            F.first(value, ignorenulls=True).over(whole),
            F.lit(0.0),
        ).alias(value),
        F.when(single, F.col("MONAT"))
        .when(F.row_number().over(ordered) == 1, F.col("_from"))
        .otherwise(F.col("MONAT"))
        .alias("_begin"),
        F.when(single, F.col("MONAT"))
        .otherwise(F.coalesce(F.add_months(F.lead("MONAT").over(ordered), -1), F.col("_to")))
        .alias("_end"),
        single.alias("_single"),
    )
    months = spans.select(
        "*", F.explode(F.expr(f"sequence(_begin, _end, {ONE_MONTH})")).alias("MONAT")
    )
    position = month_number("MONAT") - month_number("_from")
    length = month_number("_to") - month_number("_from") + 1
    return months.select(
        "product_id",
        "MONAT",
        value,
        *carry,
        F.when(F.col("_single"), 0).otherwise(position).alias("t"),
        F.when(F.col("_single"), 1).otherwise(length).alias("n"),
    )


def year_over_year(filled: DataFrame, value: str = "anz_produkt") -> DataFrame:
    """Change against the same month one year earlier, in percent.

    0 where last year sold nothing; without that month ``has_comparison`` is
    false. On a gap-free series the row twelve back is that month.
    """
    ordered = Window.partitionBy("product_id").orderBy("MONAT")
    last = F.col("last_year_sales")
    change = F.when(last > 0, (F.col(value) - last) / last * 100).when(last.isNotNull(), 0.0)
    return (
        filled.withColumn("last_year_sales", F.lag(value, 12).over(ordered))
        .withColumn("has_comparison", last.isNotNull())
        .withColumn("change_pct", change)
    )


def year_over_year_join(df: DataFrame, value: str = "anz_produkt") -> DataFrame:
    """The same pairing on a series with gaps, as a keyed self join."""
    before = df.select(
        "product_id",
        F.add_months("MONAT", 12).alias("MONAT"),
        F.col(value).alias("last_year_sales"),
    )
    return df.join(before, ["product_id", "MONAT"], "left")


def year_over_year_text(compared: DataFrame, value: str = "anz_produkt") -> DataFrame:
    """Display forms: month name, units with thousands marks, signed percent."""

    def units(c):
        return F.concat(F.format_number(c, 0), F.lit(" units"))

    seen = F.col("has_comparison")
    return compared.select(
        "product_id",
        "MONAT",
        F.date_format("MONAT", "MMMM yyyy").alias("date"),
        units(value).alias("sales"),
        "has_comparison",
        F.when(seen, units("last_year_sales")).alias("last_year"),
        F.when(seen, signed_percent("change_pct")).alias("sales_change"),
    )
