"""Per-product reports and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthcast import settings as S
from monthcast.functions.scalars import product_stem


def product_kpis(series: DataFrame) -> DataFrame:
    """Total, monthly mean and number of months on the unfilled series."""
    return series.groupBy("product_id").agg(
        F.sum("anz_produkt").alias("total_sales"),
        F.avg("anz_produkt").alias("avg_monthly_sales"),
        F.count(F.lit(1)).alias("data_months"),
    )


def calendar_profile(series: DataFrame, min_rows: int = 12) -> DataFrame:
    """Mean quantity per calendar month for products with a year of rows."""
    per_month = series.groupBy("product_id", F.month("MONAT").alias("month")).agg(
        F.sum("anz_produkt").alias("_sum"),
        F.count("anz_produkt").alias("_known"),
        F.count(F.lit(1)).alias("_rows"),
    )
    rows = F.sum("_rows").over(Window.partitionBy("product_id"))
    return (
        per_month.withColumn("_total", rows)
        .where(F.col("_total") >= min_rows)
        .select("product_id", "month", F.try_divide("_sum", "_known").alias("avg_sales"))
    )


def range_and_recent(series: DataFrame, recent: int = 6) -> DataFrame:
    """First/last month, smallest/largest quantity and the last values in order.

    The series is one row per month, so a product's list is as short as its
    calendar.
    """
    newest = Window.partitionBy("product_id").orderBy(F.col("MONAT").desc())
    tail = F.when(F.col("_age") <= recent, F.struct("MONAT", "anz_produkt"))
    return (
        series.withColumn("_age", F.row_number().over(newest))
        .groupBy("product_id")
        .agg(
            F.min("MONAT").alias("first_month"),
            F.max("MONAT").alias("last_month"),
            F.min("anz_produkt").alias("min_sales"),
            F.max("anz_produkt").alias("max_sales"),
            F.sort_array(F.collect_list(tail)).getField("anz_produkt").alias("recent_sales"),
        )
    )


def forecast_summary(forecast: DataFrame, kpis: DataFrame) -> DataFrame:
    """Total and monthly mean of the forecast against the historical mean."""
    totals = forecast.groupBy("product_id").agg(
        F.sum("forecast").alias("total_forecast"), F.count(F.lit(1)).alias("_steps")
    )
    mean = F.col("avg_monthly_sales")
    change = F.when(mean > 0, F.try_divide(F.col("avg_forecast") - mean, mean) * 100).otherwise(0.0)
    return (
        totals.join(kpis.select("product_id", "avg_monthly_sales"), "product_id")
        .withColumn("avg_forecast", F.col("total_forecast") / F.col("_steps"))
        .select(
            "product_id",
            "total_forecast",
            "avg_forecast",
            F.col("total_forecast").cast("bigint").alias("total_forecast_shown"),
            F.col("avg_forecast").cast("bigint").alias("avg_forecast_shown"),
            change.alias("change_pct"),
        )
    )


def history_and_forecast(series: DataFrame, forecast: DataFrame) -> DataFrame:
    """Observed and forecast rows in one table, told apart by ``type``."""
    past = series.select("product_id", "MONAT", "anz_produkt", F.lit("Historical").alias("type"))
    future = forecast.select(
        "product_id", "MONAT", F.col("forecast").alias("anz_produkt"), F.lit("Forecast").alias("type")
    )
    return past.unionByName(future)


def export_rows(both: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Export layout: month text, volume, type, id, name and stem."""
    names = descriptions.select(
        F.col("NUMMER").alias("Stamm_Product"), F.col("BANAME1").alias("_name")
    )
    return (
        both.withColumn("Stamm_Product", product_stem("product_id"))
        .join(names, "Stamm_Product", "left")
        .select(
            F.date_format("MONAT", "yyyy-MM").alias("Month"),
            F.col("anz_produkt").alias("Sales_Volume"),
            F.col("type").alias("Data_Type"),
            F.col("product_id").alias("Product_ID"),
            F.coalesce("_name", F.lit(S.UNKNOWN_PRODUCT)).alias("Product_Name"),
            "Stamm_Product",
        )
    )


def rows_with_history(df: DataFrame, min_rows: int = S.MIN_HISTORY_MONTHS) -> DataFrame:
    """Rows of products that have at least ``min_rows`` of them."""
    enough = products_with_history(df, min_rows).select("product_id")
    return df.join(enough, "product_id", "left_semi")


def products_with_history(df: DataFrame, min_rows: int = S.MIN_HISTORY_MONTHS) -> DataFrame:
    return (
        df.groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") >= min_rows)
    )


def top_products(series: DataFrame, k: int) -> DataFrame:
    return (
        series.groupBy("product_id")
        .agg(F.sum("anz_produkt").alias("total_sales"))
        .orderBy(F.col("total_sales").desc(), "product_id")
        .limit(k)
    )


def region_rollup(df: DataFrame, date: str = "MONAT", sales: str = "MENGE") -> DataFrame:
    """Quantity per region and month."""
    return df.groupBy("region", F.trunc(date, "MM").alias("MONAT")).agg(F.sum(sales).alias("anz_produkt"))


def revenue_projection(forecast: DataFrame, prices: DataFrame) -> DataFrame:
    """Forecast quantity times the last known unit price."""
    last = (
        prices.where(F.col("unit_preis").isNotNull())
        .groupBy("product_id")
        .agg(F.max_by("unit_preis", "MONAT").alias("last_price"))
    )
    return forecast.join(last, "product_id", "left").withColumn(
        "revenue", F.col("forecast") * F.col("last_price")
    )
