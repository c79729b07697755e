"""Feature table: lags, rolling statistics, trends, calendar and category features.

Every frame ends at the previous month, so no feature sees its own target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthcast import settings as S
from monthcast.functions.scalars import ratio
from monthcast.functions.skew import salted_lookup
from monthcast.operators.cleaning import covid_flag, covid_normalized


def _ordered():
    return Window.partitionBy("product_id").orderBy("MONAT")


def _previous(months: int):
    return _ordered().rowsBetween(-months, -1)


def with_normalized_sales(
    fact: DataFrame, covid: tuple[str, str] = S.COVID_PERIOD, factor: float = S.COVID_FACTOR
) -> DataFrame:
    return fact.withColumn("is_covid", covid_flag("MONAT", *covid)).withColumn(
        "anz_produkt_normalized", covid_normalized("anz_produkt", "is_covid", factor)
    )


def lag_features(df: DataFrame, lags: Sequence[int] = S.LAGS) -> DataFrame:
    """``sales_lag_k`` and, where the table has it, ``sales_norm_lag_k``."""
    cols = {f"sales_lag_{k}": F.lag("anz_produkt", k).over(_ordered()) for k in lags}
    if "anz_produkt_normalized" in df.columns:
        cols |= {f"sales_norm_lag_{k}": F.lag("anz_produkt_normalized", k).over(_ordered()) for k in lags}
    return df.withColumns(cols)


def rolling_features(df: DataFrame, windows: Sequence[int] = S.ROLLING_WINDOWS) -> DataFrame:
    """Mean, maximum, deviation and coefficient of variation of past months."""
    cols = {}
    for k in windows:
        frame = _previous(k)
        cols[f"sales_rolling_mean_{k}"] = F.avg("anz_produkt").over(frame)
        cols[f"sales_rolling_max_{k}"] = F.max("anz_produkt").over(frame)
        cols[f"sales_rolling_std_{k}"] = F.stddev_samp("anz_produkt").over(frame)
    df = df.withColumns(cols)
    return df.withColumns(
        {f"sales_cv_{k}": ratio(f"sales_rolling_std_{k}", f"sales_rolling_mean_{k}") for k in windows}
    )


def price_features(df: DataFrame, months: int = 3) -> DataFrame:
    return df.withColumn(f"price_rolling_mean_{months}", F.avg("unit_preis").over(_previous(months)))


def trend_features(df: DataFrame, months: int = 6, back: int = 3) -> DataFrame:
    """Slope of the past ``months`` rows, and its change over ``back`` rows."""
    slope = f"trend_{months}"
    return (
        df.withColumn("_t", F.row_number().over(_ordered()))
        .withColumn(slope, F.regr_slope("anz_produkt", "_t").over(_previous(months)))
        .withColumn("trend_acceleration", F.col(slope) - F.lag(slope, back).over(_ordered()))
        .drop("_t")
    )


def calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"month": F.month("MONAT"), "quarter": F.quarter("MONAT"), "year": F.year("MONAT")}
    )


def category_months(fact: DataFrame, train_until: str | None = None) -> DataFrame:
    """Per category and month: mean sales of the last three months and seasonal index.

    The index is the category's mean in that calendar month over its overall
    mean, taken from months up to ``train_until`` when given. Sums and counts
    combine on the map side; what follows works on one row per category-month.
    """
    months = fact.where(F.col("product_category_id").isNotNull()).groupBy("product_category_id", "MONAT").agg(
        F.sum("anz_produkt").alias("_sum"), F.count("anz_produkt").alias("_n")
    )
    category = Window.partitionBy("product_category_id")
    same_month = Window.partitionBy("product_category_id", F.month("MONAT"))
    known = F.lit(True) if train_until is None else F.col("MONAT") <= F.lit(train_until).cast("date")

    def mean(window):
        return F.try_divide(
            F.sum(F.when(known, F.col("_sum"))).over(window), F.sum(F.when(known, F.col("_n"))).over(window)
        )

    recent = category.orderBy("MONAT").rowsBetween(-3, -1)
    return months.select(
        "product_category_id",
        "MONAT",
        F.try_divide("_sum", "_n").alias("category_mean"),
        F.avg(F.try_divide("_sum", "_n")).over(recent).alias("category_rolling_mean_3"),
        F.try_divide(mean(same_month), mean(category)).alias("category_seasonal_index"),
    )


def category_features(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Attach the seasonal index and the product's standing within its category."""
    table = categories.select(
        "product_category_id", "MONAT", "category_rolling_mean_3", "category_seasonal_index"
    )
    return salted_lookup(df, table, ["product_category_id", "MONAT"], ["product_id"]).withColumn(
        "sales_vs_category_3", ratio("sales_rolling_mean_3", "category_rolling_mean_3")
    )


def product_features(
    fact: DataFrame, covid: tuple[str, str] = S.COVID_PERIOD, factor: float = S.COVID_FACTOR
) -> DataFrame:
    """Features that depend on a product's own rows alone (one shuffle)."""
    df = with_normalized_sales(fact, covid, factor).withColumn("PREIS", F.col("unit_preis"))
    for step in (lag_features, rolling_features, price_features, trend_features, calendar_features):
        df = step(df)
    return df


def create_features(
    fact: DataFrame, covid: tuple[str, str] = S.COVID_PERIOD, train_until: str | None = None
) -> DataFrame:
    """The whole feature table: product windows plus the category lookup."""
    return category_features(product_features(fact, covid), category_months(fact, train_until))


def select_features(
    features: DataFrame, names: Sequence[str] = S.SELECTED_FEATURES, keys: Sequence[str] = ("product_id", "MONAT")
) -> DataFrame:
    check_columns(features, names)
    return features.select(*keys, *names)


def check_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Raise where the table lacks a trained column."""
    absent = sorted(set(names) - set(df.columns))
    if absent:
        raise ValueError(f"missing required columns: {absent}")


def complete_rows(
    features: DataFrame, names: Sequence[str] = S.MODEL_FEATURES, min_rows: int | None = None
) -> DataFrame:
    """Rows with every feature known; with ``min_rows`` set, too few are an error."""
    rows = features.dropna(subset=list(names))
    if min_rows is not None and len(rows.limit(min_rows).take(min_rows)) < min_rows:
        raise ValueError("insufficient training data after cleaning")
    return rows
