"""Cleaning of sales tables: ids, flags, categories, monthly aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from monthcast import settings as S
from monthcast.functions.scalars import as_column, flag, lenient_date, month_start, strip


def normalize_product_id(df: DataFrame, column: str = "product_id") -> DataFrame:
    """Ids as stripped text; a table without the column is returned as is."""
    return df.withColumn(column, strip(column)) if column in df.columns else df


def covid_flag(
    date: Column | str, start: str = S.COVID_PERIOD[0], end: str = S.COVID_PERIOD[1]
) -> Column:
    """Whether a date lies in the inclusive period; null counts as no."""
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    return flag(as_column(date).between(first, last))


def covid_normalized(
    sales: Column | str, is_covid: Column | str, factor: float = S.COVID_FACTOR
) -> Column:
    """Sales scaled up by 1/factor inside the flagged period."""
    sales = as_column(sales)
    return F.when(as_column(is_covid), sales / factor).otherwise(sales)


def detect_stock_outs(
    df: DataFrame,
    sales: str = "anz_produkt",
    stock: str | None = None,
    threshold: float = S.STOCK_OUT_THRESHOLD,
    key: Sequence[str] = ("product_id",),
    order: str = "MONAT",
    output: str = "stock_out",
) -> DataFrame:
    """Flag months without stock.

    With a stock column: stock <= 0. Otherwise a zero month whose centred
    three-month mean still exceeds ``threshold`` times the series mean.
    """
    if stock is not None:
        return df.withColumn(output, flag(F.col(stock) <= 0))
    series = Window.partitionBy(*key)
    around = series.orderBy(order).rowsBetween(-1, 1)
    centred = F.when(F.count(sales).over(around) == 3, F.avg(sales).over(around))
    return df.withColumn(
        output,
        flag((F.col(sales) == 0) & (centred > F.avg(sales).over(series) * threshold)),
    )


def detect_price_changes(
    df: DataFrame,
    price: str = "unit_preis",
    threshold: float = S.PRICE_CHANGE_THRESHOLD,
    key: Sequence[str] = ("product_id",),
    order: str = "MONAT",
    output: str = "price_change",
) -> DataFrame:
    """Flag rows whose price moved by more than ``threshold`` since the last one.

    Missing prices repeat the last known price; a rise from zero is a change.
    """
    series = Window.partitionBy(*key).orderBy(order)
    upto_here = series.rowsBetween(Window.unboundedPreceding, 0)
    upto_previous = series.rowsBetween(Window.unboundedPreceding, -1)
    current = F.last(price, ignorenulls=True).over(upto_here)
    previous = F.last(price, ignorenulls=True).over(upto_previous)
    moved = F.when(previous == 0, current != 0).otherwise(
        F.abs(F.try_divide(current, previous) - 1) > threshold
    )
    return df.withColumn(output, flag(moved))


def clean_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper-case stripped text, with the spellings of "missing" set to null."""
    for name in columns:
        if name in df.columns:
            text = F.upper(strip(name))
            df = df.withColumn(name, F.when(~text.isin(*S.NULL_WORDS), text))
    return df


def _by_month(
    df: DataFrame, group_cols: Sequence[str], date: str, date_formats: tuple[str, ...]
) -> GroupedData:
    """Rows with all keys known, an unreadable date included, grouped by them and the month."""
    keys = [*group_cols, date]
    known = df.withColumn(date, month_start(lenient_date(date, date_formats)))
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    return known.groupBy(*keys)


def aggregate_sales(
    df: DataFrame,
    group_cols: Sequence[str],
    date: str = "MONAT",
    sales: str = "MENGE",
    price: str = "PREIS",
    date_formats: tuple[str, ...] = S.DATE_FORMATS,
    least: Sequence[str] = (),
) -> DataFrame:
    """Quantity total and plain mean price per group and month, and the least value of other columns.

    Rows with a null key, an unreadable date included, are dropped
    (``unreadable_dates`` counts those). The aggregation combines on the map
    side, so a product with a large share of the lines costs no more than any
    other.
    """
    return _by_month(df, group_cols, date, date_formats).agg(
        F.coalesce(F.sum(sales), F.lit(0.0)).alias("anz_produkt"),
        F.avg(price).alias("unit_preis"),
        *[F.min(c).alias(c) for c in least],
    )


def sales_parts(
    df: DataFrame,
    group_cols: Sequence[str],
    date: str = "MONAT",
    sales: str = "MENGE",
    price: str = "PREIS",
    date_formats: tuple[str, ...] = S.DATE_FORMATS,
) -> DataFrame:
    """What ``aggregate_sales`` needs of a part of the lines, in a form that adds up."""
    return _by_month(df, group_cols, date, date_formats).agg(
        F.sum(sales).cast("double").alias("units"),
        F.sum(price).cast("double").alias("price_sum"),
        F.count(price).alias("price_rows"),
    )


def combine_parts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The monthly fact of all parts together."""
    return parts.groupBy(*keys).agg(
        F.coalesce(F.sum("units"), F.lit(0.0)).alias("anz_produkt"),
        F.try_divide(F.sum("price_sum"), F.sum("price_rows")).alias("unit_preis"),
    )


def unreadable_dates(
    df: DataFrame, date: str = "MONAT", date_formats: tuple[str, ...] = S.DATE_FORMATS
) -> DataFrame:
    """One row: how many rows there are, how many have no date, and how many one that cannot be read."""
    read = lenient_date(date, date_formats)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(date).isNull()).alias("without_date"),
        F.count_if(F.col(date).isNotNull() & read.isNull()).alias("unreadable"),
    )


def collapse_months(df: DataFrame) -> DataFrame:
    """One row per product and month: quantity total, first category."""
    extra = [F.min("product_category_id").alias("product_category_id")]
    if "product_category_id" not in df.columns:
        extra = []
    return df.groupBy("product_id", "MONAT").agg(
        F.coalesce(F.sum("anz_produkt"), F.lit(0.0)).alias("anz_produkt"), *extra
    )
