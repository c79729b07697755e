"""Queries: forecasts as of earlier dates, against what was sold since."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthcast.catalogue.forecasts import ALL, LISTED, LISTED_SQL
from monthcast.catalogue.registry import FACT, monthly, query, rnd, shown
from monthcast.plans import holdout as H
from monthcast.plans.forecasts import monthly_table
from monthcast.session import materialize

# The forecast's SQL over the histories up to each cut-off, keyed by age and product.
COPIES = FACT + f""",
cuts AS (
  SELECT CAST(k AS INTEGER) AS age, CAST(last - to_months(CAST(6 * k AS INTEGER)) AS DATE) AS cutoff
  FROM (SELECT max(MONAT) AS last FROM fact), (SELECT unnest(range(1, {H.CUTOFFS + 1})) AS k)),
keyed AS (SELECT age || ':' || product_id AS key, * FROM fact, cuts),
copies AS (SELECT key AS product_id, MONAT, anz_produkt FROM keyed WHERE MONAT <= cutoff)"""

HOLDOUT = (
    ALL.replace(FACT, COPIES, 1)
    .replace("FROM fact GROUP BY product_id)", "FROM copies GROUP BY product_id)")
    .replace("LEFT JOIN fact f", "LEFT JOIN copies f")
    .replace(f"product_id NOT IN ({LISTED_SQL})", f"split_part(product_id, ':', 2) NOT IN ({LISTED_SQL})")
    .replace(f"product_id IN ({LISTED_SQL})", f"split_part(product_id, ':', 2) IN ({LISTED_SQL})")
    + """,
levels AS (SELECT product_id, avg(x) FILTER (WHERE t >= n - 6) AS mean6, arg_max(x, t) AS naive FROM pos GROUP BY product_id),
tests AS MATERIALIZED (
  SELECT k.product_id, k.age, k.cutoff, k.MONAT, k.anz_produkt AS y, r.forecast,
         coalesce(p.x, l.mean6) AS seasonal_naive, l.naive
  FROM keyed k JOIN routed r ON r.product_id = k.key AND r.month = k.MONAT JOIN levels l ON l.product_id = k.key
  LEFT JOIN pos p ON p.product_id = k.key AND p.MONAT = k.MONAT - INTERVAL 12 MONTH
  WHERE k.MONAT > k.cutoff AND k.MONAT <= k.cutoff + INTERVAL 6 MONTH),
long AS (
  SELECT product_id, age, y, 'forecast' AS member, forecast AS yhat FROM tests
  UNION ALL SELECT product_id, age, y, 'seasonal_naive', seasonal_naive FROM tests
  UNION ALL SELECT product_id, age, y, 'naive', naive FROM tests),
older AS (
  SELECT level, key, member, avg(mae) AS mae
  FROM (SELECT 'product' AS level, product_id AS key, age, member, avg(abs(y - yhat)) AS mae FROM long WHERE age > 1 GROUP BY ALL
        UNION ALL
        SELECT 'global', 'all', age, member, avg(abs(y - yhat)) FROM long WHERE age > 1 GROUP BY ALL)
  GROUP BY ALL),
weights AS (
  SELECT *, coalesce(CASE WHEN mae > 0 THEN 1 / mae END / sum(CASE WHEN mae > 0 THEN 1 / mae END) OVER (PARTITION BY level, key), 0)
    AS weight FROM older),
newest AS (
  SELECT t.*, CASE WHEN product_id IN (SELECT key FROM weights WHERE level = 'product') THEN 'product' ELSE 'global' END
    AS weights_from FROM tests t WHERE age = 1),
wide AS (
  SELECT level, key, max(weight) FILTER (WHERE member = 'forecast') AS wf,
         max(weight) FILTER (WHERE member = 'seasonal_naive') AS ws, max(weight) FILTER (WHERE member = 'naive') AS wn
  FROM weights GROUP BY ALL),
blended AS (
  SELECT n.*, greatest(0, wf * forecast + ws * seasonal_naive + wn * naive) AS ensemble
  FROM newest n JOIN wide w ON w.level = weights_from
    AND w.key = CASE weights_from WHEN 'product' THEN n.product_id ELSE 'all' END)"""
)


def predictions(spark, sf):
    """The errors read these rows four times."""
    return materialize(H.holdout_predictions(monthly_table(monthly(spark, sf)), decomposed=LISTED), "tests")


@query(
    "m10_holdout_errors",
    HOLDOUT
    + f"""
SELECT age, CAST(cutoff AS VARCHAR) AS cutoff, member, count(yhat) AS months, {rnd("avg(abs(yhat - y))")} AS mae,
       {rnd("sqrt(avg((yhat - y) * (yhat - y)))")} AS rmse, {rnd("avg(yhat - y)")} AS bias
FROM (SELECT age, y, member, yhat FROM long UNION ALL SELECT age, y, 'ensemble', ensemble FROM blended) JOIN cuts USING (age)
GROUP BY ALL""",
)
def m10_holdout(spark, sf):
    """Error of the forecast, of its simple rivals and of their ensemble, in the last months and before."""
    return shown(H.holdout_errors(predictions(spark, sf)), dates=("cutoff",))


@query(
    "m3_holdout_predictions",
    HOLDOUT
    + f"""
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, y, {rnd("forecast")} AS forecast, {rnd("seasonal_naive")} AS seasonal_naive,
       naive, {rnd("ensemble")} AS ensemble, weights_from
FROM blended""",
)
def m3_holdout(spark, sf):
    rows = H.with_holdout_ensemble(predictions(spark, sf))
    return shown(rows.select("product_id", "MONAT", "y", *H.MEMBERS, "ensemble", "weights_from"))
