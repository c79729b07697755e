"""Queries: aggregations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthcast.catalogue.registry import (
    DESCRIPTIONS,
    FACT,
    FILLED,
    LINES,
    SHORTENED,
    descriptions,
    monthly,
    query,
    rnd,
    sales_lines,
    shortened,
    shown,
    supplier_regions,
)
from monthcast.functions.skew import salted_lookup
from monthcast.operators import reporting as R
from monthcast.operators.cleaning import collapse_months
from monthcast.operators.series import fill_month_gaps
from monthcast.operators.trend import forecast_steps, moving_level, series_statistics
from monthcast.plans.forecasts import export_all, summarize_all
from monthcast.session import materialize, spread


def written_months(spark, sf):
    """The monthly fact, written once for the forecast and for the report beside it."""
    return materialize(monthly(spark, sf), "monthly")


def level_forecast(months):
    """A forecast that repeats the recent level, to feed the reports; of months that are written."""
    return forecast_steps(series_statistics(fill_month_gaps(months, deal=spread))).select(
        "product_id", "MONAT", "step", moving_level().alias("forecast")
    )


FORECAST = FILLED + """,
levels AS (
  SELECT product_id, max(MONAT) AS last_month,
         avg(x) FILTER (WHERE CASE WHEN least(6, n // 2) > 1 THEN n - 1 - t < least(6, n // 2)
                                   ELSE n - 1 = t END) AS level
  FROM pos GROUP BY product_id),
forecast AS (
  SELECT product_id, CAST(last_month + to_months(CAST(step + 1 AS INTEGER)) AS DATE) AS MONAT, step,
         level AS forecast
  FROM levels CROSS JOIN steps),
kpis AS (
  SELECT product_id, sum(anz_produkt) AS total_sales, avg(anz_produkt) AS avg_monthly_sales,
         count(*) AS data_months
  FROM fact GROUP BY product_id)"""


@query(
    "a1_month_collapse",
    LINES
    + """
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, sum(MENGE) AS anz_produkt,
       min(l_returnflag) AS product_category_id
FROM lines GROUP BY product_id, MONAT""",
)
def a1(spark, sf):
    rows = sales_lines(spark, sf).select(
        "product_id",
        F.trunc("MONAT", "MM").alias("MONAT"),
        F.col("MENGE").alias("anz_produkt"),
        F.col("l_returnflag").alias("product_category_id"),
    )
    return shown(collapse_months(rows))


@query(
    "a2_product_kpis",
    FORECAST
    + f"""
SELECT product_id, total_sales, {rnd("avg_monthly_sales")} AS avg_monthly_sales, data_months FROM kpis""",
)
def a2(spark, sf):
    return shown(R.product_kpis(monthly(spark, sf)))


@query(
    "a3_calendar_month_profile",
    SHORTENED
    + f"""
SELECT product_id, CAST(month(MONAT) AS INTEGER) AS month, {rnd("avg(anz_produkt)")} AS avg_sales
FROM short
WHERE product_id IN (SELECT product_id FROM short GROUP BY product_id HAVING count(*) >= 12)
GROUP BY product_id, month(MONAT)""",
)
def a3(spark, sf):
    return shown(R.calendar_profile(shortened(monthly(spark, sf))))


@query(
    "a4_range_and_recent",
    FACT
    + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY MONAT DESC) AS age FROM fact)
SELECT product_id, CAST(min(MONAT) AS VARCHAR) AS first_month, CAST(max(MONAT) AS VARCHAR) AS last_month,
       min(anz_produkt) AS min_sales, max(anz_produkt) AS max_sales,
       string_agg(CAST(CAST(anz_produkt AS BIGINT) AS VARCHAR), ',' ORDER BY MONAT)
         FILTER (WHERE age <= 6) AS recent_sales
FROM ranked GROUP BY product_id""",
)
def a4(spark, sf):
    df = R.range_and_recent(monthly(spark, sf))
    text = F.array_join(F.transform("recent_sales", lambda v: v.cast("bigint").cast("string")), ",")
    return shown(df.withColumn("recent_sales", text), dates=("first_month", "last_month"))


@query(
    "a5_forecast_summary",
    FORECAST
    + f""",
totals AS (SELECT product_id, sum(forecast) AS total, sum(forecast) / 6 AS mean FROM forecast GROUP BY product_id)
SELECT product_id, {rnd("total")} AS total_forecast, {rnd("mean")} AS avg_forecast,
       {rnd("CASE WHEN avg_monthly_sales > 0 THEN (mean - avg_monthly_sales) / avg_monthly_sales * 100 ELSE 0 END")}
         AS change_pct
FROM totals JOIN kpis USING (product_id)""",
)
def a5(spark, sf):
    months = written_months(spark, sf)
    df = summarize_all(months, level_forecast(months))
    return shown(df.drop("total_forecast_shown", "avg_forecast_shown"))


@query(
    "a6_history_and_forecast",
    FORECAST
    + f"""
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, {rnd("anz_produkt")} AS anz_produkt, type FROM (
  SELECT product_id, MONAT, anz_produkt, 'Historical' AS type FROM fact
  UNION ALL SELECT product_id, MONAT, forecast, 'Forecast' FROM forecast)""",
)
def a6(spark, sf):
    months = written_months(spark, sf)
    return shown(R.history_and_forecast(months, level_forecast(months)))


EXPORT = FORECAST + f""", {DESCRIPTIONS},
export AS (
  SELECT strftime(MONAT, '%Y-%m') AS "Month", {rnd("v")} AS "Sales_Volume", type AS "Data_Type",
         product_id AS "Product_ID", coalesce(BANAME1, 'Unknown Product') AS "Product_Name",
         substr(product_id, 1, 8) AS "Stamm_Product"
  FROM (SELECT product_id, MONAT, anz_produkt AS v, 'Historical' AS type FROM fact
        UNION ALL SELECT product_id, MONAT, forecast, 'Forecast' FROM forecast)
  LEFT JOIN names ON NUMMER = substr(product_id, 1, 8))"""


@query("a6_export_rows", EXPORT + "SELECT * FROM export")
def a6_export(spark, sf):
    months = written_months(spark, sf)
    return shown(export_all(months, level_forecast(months), descriptions(spark, sf)))


@query(
    "a7_rows_with_history",
    SHORTENED
    + """
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, anz_produkt FROM short
WHERE product_id IN (SELECT product_id FROM short GROUP BY product_id HAVING count(*) >= 6)""",
)
def a7(spark, sf):
    df = R.rows_with_history(shortened(monthly(spark, sf)))
    return shown(df.select("product_id", "MONAT", "anz_produkt"))


@query(
    "a7_products_with_history",
    FACT + "SELECT product_id, count(*) AS rows FROM fact GROUP BY product_id HAVING count(*) >= 6",
)
def a7_products(spark, sf):
    return R.products_with_history(monthly(spark, sf))


@query(
    "a9_top_products",
    FACT
    + """
SELECT product_id, sum(anz_produkt) AS total_sales FROM fact GROUP BY product_id
ORDER BY total_sales DESC, product_id LIMIT 20""",
)
def a9(spark, sf):
    return R.top_products(monthly(spark, sf), 20)


def regional_lines(spark, sf):
    """Sales lines with the region of their supplier.

    Quantities are first added up per product, supplier and month, so a
    supplier with a large share of the lines sends few rows to the join.
    """
    per_supplier = (
        sales_lines(spark, sf)
        .groupBy("product_id", "l_suppkey", F.trunc("MONAT", "MM").alias("MONAT"))
        .agg(F.sum("MENGE").alias("MENGE"))
    )
    return salted_lookup(per_supplier, supplier_regions(spark, sf), ["l_suppkey"], ["product_id"], how="inner")


REGIONAL = LINES + """,
regional AS (
  SELECT lines.*, 'F0' || (n_regionkey % 4 + 1) AS region
  FROM lines JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


@query(
    "a10_region_rollup",
    REGIONAL
    + """
SELECT region, CAST(MONAT AS VARCHAR) AS MONAT, sum(MENGE) AS anz_produkt
FROM regional GROUP BY region, MONAT""",
)
def a10(spark, sf):
    return shown(R.region_rollup(regional_lines(spark, sf)))


@query(
    "a11_revenue_projection",
    FORECAST
    + f""",
last_prices AS (SELECT product_id, arg_max(unit_preis, MONAT) AS last_price FROM fact GROUP BY product_id)
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, step, {rnd("forecast")} AS forecast,
       {rnd("last_price", 5)} AS last_price, {rnd("forecast * last_price", 2)} AS revenue
FROM forecast LEFT JOIN last_prices USING (product_id)""",
)
def a11(spark, sf):
    months = written_months(spark, sf)
    df = R.revenue_projection(level_forecast(months), months)
    return shown(df, revenue=2)
