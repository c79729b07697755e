"""Queries: gap fill, year-over-year change, spectrum, decomposition."""

from __future__ import annotations

from monthcast.catalogue.registry import FILLED, filled, query, rnd, shown
from monthcast.operators import decomposition as D
from monthcast.operators import series as T
from monthcast.operators.spectrum import dominant_period


@query(
    "t1_gap_fill",
    FILLED
    + """
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, x AS anz_produkt, CAST(t AS INTEGER) AS t,
       CAST(n AS INTEGER) AS n
FROM pos""",
)
def t1(spark, sf):
    return shown(filled(spark, sf))


YOY = FILLED + """,
yoy AS (
  SELECT product_id, MONAT, x, last AS last_year_sales, last IS NOT NULL AS has_comparison,
         CASE WHEN last > 0 THEN (x - last) / last * 100 WHEN last IS NOT NULL THEN 0.0 END AS change_pct
  FROM (SELECT *, lag(x, 12) OVER (PARTITION BY product_id ORDER BY MONAT) AS last FROM filled))"""


@query(
    "t2_year_over_year",
    YOY
    + f"""
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, x AS anz_produkt, last_year_sales, has_comparison,
       {rnd("change_pct")} AS change_pct
FROM yoy""",
)
def t2(spark, sf):
    return shown(T.year_over_year(filled(spark, sf)).drop("t", "n"))


@query(
    "t2_year_over_year_text",
    YOY
    + """
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, strftime(MONAT, '%B %Y') AS date,
       format('{:,}', CAST(x AS BIGINT)) || ' units' AS sales, has_comparison,
       CASE WHEN has_comparison THEN format('{:,}', CAST(last_year_sales AS BIGINT)) || ' units' END AS last_year,
       CASE WHEN has_comparison THEN printf('%+.1f%%', change_pct) END AS sales_change
FROM yoy""",
)
def t2_text(spark, sf):
    return shown(T.year_over_year_text(T.year_over_year(filled(spark, sf))))


SPECTRUM = FILLED + """,
waves AS (
  SELECT product_id, n, k, sum(x * cos(2 * pi() * ((t * k) % n) / n)) AS re,
         sum(x * sin(2 * pi() * ((t * k) % n) / n)) AS im
  FROM (SELECT *, unnest(range(1, n // 2)) AS k FROM pos WHERE n >= 24) GROUP BY product_id, n, k),
periods AS (
  SELECT product_id, k, n / k AS period FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY round(re * re + im * im, 6) DESC, k) AS place
    FROM waves) WHERE place = 1)"""


@query(
    "t11_dominant_period",
    SPECTRUM + f"SELECT product_id, CAST(k AS INTEGER) AS k, {rnd('period')} AS period FROM periods",
)
def t11(spark, sf):
    return shown(dominant_period(filled(spark, sf)))


# The moving average by a window with a per-series frame; the ends repeat the first and last full average.
DECOMPOSED = FILLED + """,
lengths AS (
  SELECT product_id, MONAT, x, t, n, least(12, n // 2) AS m, (least(12, n // 2) - 1) // 2 AS o FROM pos),
averages AS (
  SELECT *, avg(x) OVER (PARTITION BY product_id ORDER BY t ROWS BETWEEN greatest(m - 1 - o, 0) PRECEDING AND greatest(o, 0) FOLLOWING) AS v
  FROM lengths),
trended AS (
  SELECT product_id, MONAT, x, t, n, m, o,
         CASE WHEN m <= 1 THEN x ELSE nth_value(v, greatest(m - 1 - o, least(n - 1 - o, t)) + 1) OVER (
           PARTITION BY product_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS trend
  FROM averages),
parts AS (
  SELECT *, x - trend - seasonal AS residual FROM (
    SELECT *, CASE WHEN n >= 12 THEN avg(x - trend) OVER (PARTITION BY product_id, month(MONAT)) ELSE 0 END
             AS seasonal FROM trended))"""


@query(
    "t12_centred_trend",
    DECOMPOSED
    + f"SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, x AS anz_produkt, {rnd('trend')} AS trend FROM trended",
)
def t12(spark, sf):
    return shown(D.centred_trend(filled(spark, sf)).drop("t", "n"))


@query(
    "t13_decomposition",
    DECOMPOSED
    + f"""
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, {rnd("trend")} AS trend, {rnd("seasonal")} AS seasonal,
       {rnd("residual")} AS residual
FROM parts""",
)
def t13(spark, sf):
    return shown(D.decompose(filled(spark, sf)).drop("t", "n", "anz_produkt"))
