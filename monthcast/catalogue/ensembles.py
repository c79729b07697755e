"""Queries: folds, errors, weights and predictions of the ensemble.

The members here are plain expressions and one-variable lines, so that every
number can be checked in SQL; the Spark ML members run through the same
operators in the ``jobs`` queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from monthcast import settings as S
from monthcast.catalogue.registry import UNCATEGORIZED, query, rnd, shown, uncategorized_fact
from monthcast.functions.scalars import half_up
from monthcast.operators import ensemble as E
from monthcast.operators import members as B
from monthcast.operators.features import lag_features, rolling_features
from monthcast.operators.folds import FOLDS, fold_columns, fold_ranges, level_rows, with_folds
from monthcast.session import materialize

MEMBERS = list(B.BASELINES)


def baseline_rows(spark, sf):
    """Feature rows with the relational members, from each product's second month on."""
    df = rolling_features(lag_features(uncategorized_fact(spark, sf)))
    return (
        B.with_baselines(df)
        .where(F.col("naive").isNotNull())
        .select(
            "product_id",
            "product_category_id",
            "MONAT",
            "y",
            "naive",
            "seasonal_naive",
            "rolling_mean",
            "sales_lag_1",
        )
    )


def folded(spark, sf):
    """Rows are read by the ranking and its counts, folds by errors and lines."""
    rows = materialize(baseline_rows(spark, sf), "rows")
    return materialize(with_folds(rows), "folded", "level")


def scored(spark, sf):
    return B.with_line_member(folded(spark, sf))


def member_errors(folds):
    return E.cross_validation_errors(B.with_line_member(folds), MEMBERS)


def errors(spark, sf):
    return member_errors(folded(spark, sf))


FOLDED = UNCATEGORIZED + f""",
lagged AS (
  SELECT product_id, product_category_id, MONAT, anz_produkt AS y,
         lag(anz_produkt) OVER w AS naive,
         coalesce(lag(anz_produkt, 12) OVER w,
                  avg(anz_produkt) OVER (PARTITION BY product_id ORDER BY MONAT
                                         ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) AS seasonal_naive,
         avg(anz_produkt) OVER (PARTITION BY product_id ORDER BY MONAT
                                ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling_mean
  FROM loose WINDOW w AS (PARTITION BY product_id ORDER BY MONAT)),
rows AS (SELECT * FROM lagged WHERE naive IS NOT NULL),
levelled AS (
  SELECT 'global' AS level, 'all' AS key, * FROM rows
  UNION ALL SELECT 'category', product_category_id, * FROM rows WHERE product_category_id IS NOT NULL
  UNION ALL SELECT 'product', product_id, * FROM rows),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY level, key ORDER BY MONAT, md5(product_id), product_id) - 1 AS r,
         count(*) OVER (PARTITION BY level, key) AS n FROM levelled),
folded AS (
  SELECT * , CASE WHEN r < n - 3 * (n // 4) THEN 0 ELSE 1 + (r - (n - 3 * (n // 4))) // (n // 4) END AS fold
  FROM ranked WHERE n >= 4 AND (level = 'global' OR n >= {S.MIN_HISTORY_MONTHS}))"""


@query(
    "m2_time_folds",
    FOLDED
    + """
SELECT level, key, product_id, CAST(MONAT AS VARCHAR) AS MONAT, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(fold AS INTEGER) AS fold
FROM folded""",
)
def m2(spark, sf):
    return shown(folded(spark, sf).select("level", "key", "product_id", "MONAT", "r", "n", "fold"))


@query(
    "m2_fold_ranges",
    FOLDED
    + """
SELECT a.level, a.key, CAST(a.fold AS INTEGER) AS fold, test_rows, CAST(test_from AS VARCHAR) AS test_from,
       CAST(test_to AS VARCHAR) AS test_to, count(*) AS train_rows
FROM (SELECT level, key, fold, count(*) AS test_rows, min(MONAT) AS test_from, max(MONAT) AS test_to
      FROM folded WHERE fold > 0 GROUP BY ALL) a
JOIN folded b ON b.level = a.level AND b.key = a.key AND b.fold < a.fold
GROUP BY ALL""",
)
def m2_ranges(spark, sf):
    return shown(fold_ranges(folded(spark, sf)), dates=("test_from", "test_to"))


SCORED = FOLDED + """,
lines_by_fold AS (
  SELECT level, key, f, coalesce(regr_slope(y, naive), 0) AS slope,
         CASE WHEN regr_slope(y, naive) IS NULL THEN avg(y) ELSE regr_intercept(y, naive) END AS intercept
  FROM folded JOIN (SELECT unnest(range(1, 5)) AS f) ON fold < f GROUP BY level, key, f),
scored AS (
  SELECT a.*, slope * naive + intercept AS linear
  FROM folded a LEFT JOIN lines_by_fold l ON l.level = a.level AND l.key = a.key AND l.f = a.fold),
fold_mae AS (
  SELECT level, key, fold, member, avg(abs(y - yhat)) AS mae
  FROM (UNPIVOT (SELECT level, key, fold, y, CAST(naive AS DOUBLE) AS naive,
                        CAST(seasonal_naive AS DOUBLE) AS seasonal_naive,
                        CAST(rolling_mean AS DOUBLE) AS rolling_mean, CAST(linear AS DOUBLE) AS linear
                 FROM scored WHERE fold > 0)
        ON naive, seasonal_naive, rolling_mean, linear INTO NAME member VALUE yhat)
  GROUP BY level, key, fold, member),
maes AS (SELECT level, key, member, avg(mae) AS mae FROM fold_mae GROUP BY level, key, member),
weights AS (
  SELECT *, CASE WHEN mae > 0 THEN (1 / mae) /
              sum(CASE WHEN mae > 0 THEN 1 / mae END) OVER (PARTITION BY level, key) ELSE 0 END AS weight
  FROM maes)"""


@query(
    "m3_fold_errors",
    SCORED + f"SELECT level, key, CAST(fold AS INTEGER) AS fold, member, {rnd('mae')} AS mae FROM fold_mae",
)
def m3_folds(spark, sf):
    return shown(E.fold_errors(scored(spark, sf), MEMBERS))


@query("m3_cross_validation_error", SCORED + f"SELECT level, key, member, {rnd('mae')} AS mae FROM maes")
def m3(spark, sf):
    return shown(errors(spark, sf))


@query(
    "m4_inverse_error_weights",
    SCORED + f"SELECT level, key, member, {rnd('weight', 6)} AS weight FROM weights",
)
def m4(spark, sf):
    return shown(E.inverse_error_weights(errors(spark, sf)).drop("mae"), 6)


def final_models(rows):
    """Weights and the line fitted on all rows, per level and key."""
    lines = B.line_statistics(rows, "sales_lag_1").where(F.col("fold") == FOLDS + 1).drop("fold")
    weights = E.inverse_error_weights(E.cross_validation_errors(B.with_line_member(rows), MEMBERS))
    return materialize(E.wide_weights(weights, MEMBERS).join(lines, ["level", "key"]), "models", "level")


def predicted_rows(spark, sf):
    """Folds are columns of the rows, which are written once; copies per level and key last as long as a sum."""
    rows = fold_columns(baseline_rows(spark, sf))
    levelled = E.most_specific(rows, final_models(level_rows(rows)))
    return levelled.withColumn("linear", F.col("slope") * F.col("sales_lag_1") + F.col("intercept"))


PREDICTED = SCORED + """,
final_lines AS (SELECT * FROM lines_by_fold WHERE f = 4),
models AS (
  SELECT level, key, max(weight) FILTER (WHERE member = 'naive') AS w_naive,
         max(weight) FILTER (WHERE member = 'seasonal_naive') AS w_seasonal_naive,
         max(weight) FILTER (WHERE member = 'rolling_mean') AS w_rolling_mean,
         max(weight) FILTER (WHERE member = 'linear') AS w_linear, any_value(slope) AS slope,
         any_value(intercept) AS intercept
  FROM weights JOIN final_lines USING (level, key) GROUP BY level, key),
chosen AS (
  SELECT r.*, CASE WHEN p.key IS NOT NULL THEN 'product' WHEN c.key IS NOT NULL THEN 'category' ELSE 'global' END
           AS model_level,
         CASE WHEN p.key IS NOT NULL THEN p.key WHEN c.key IS NOT NULL THEN c.key ELSE 'all' END AS model_key
  FROM rows r LEFT JOIN models p ON p.level = 'product' AND p.key = r.product_id
  LEFT JOIN models c ON c.level = 'category' AND c.key = r.product_category_id),
predicted AS (
  SELECT c.*, w_naive, w_seasonal_naive, w_rolling_mean, w_linear, slope * naive + intercept AS linear
  FROM chosen c JOIN models m ON m.level = c.model_level AND m.key = c.model_key),
band AS (
  SELECT *, w_naive * naive + w_seasonal_naive * seasonal_naive + w_rolling_mean * rolling_mean
            + w_linear * linear AS total,
         w_naive + w_seasonal_naive + w_rolling_mean + w_linear AS weight_sum,
         (naive + seasonal_naive + rolling_mean + linear) / 4 AS m
  FROM predicted),
spread AS (
  SELECT *, sqrt(((naive - m) ^ 2 + (seasonal_naive - m) ^ 2 + (rolling_mean - m) ^ 2 + (linear - m) ^ 2) / 4)
           AS s, total / weight_sum AS mean
  FROM band)"""


@query(
    "m5_ensemble_prediction",
    PREDICTED
    + f"SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, {rnd('greatest(0, total)')} AS prediction FROM band",
)
def m5(spark, sf):
    df = predicted_rows(spark, sf)
    return shown(df.select("product_id", "MONAT", E.ensemble_prediction(MEMBERS).alias("prediction")))


@query(
    "m6_uncertainty_band",
    PREDICTED
    + f"""
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, {rnd("greatest(0, mean)")} AS predicted_sales,
       {rnd("greatest(0, mean - 1.96 * s)")} AS lower_bound, {rnd("greatest(0, mean + 1.96 * s)")} AS upper_bound
FROM spread""",
)
def m6(spark, sf):
    band = E.ensemble_band(predicted_rows(spark, sf), MEMBERS)
    return shown(band.select("product_id", "MONAT", "predicted_sales", "lower_bound", "upper_bound"))


def importance_rows(rows):
    """Coefficients of two one-variable lines per key as member importances."""
    parts = [
        B.line_statistics(rows, x)
        .where(F.col("fold") == FOLDS + 1)
        .select("level", "key", F.lit(member).alias("member"), F.lit(x).alias("feature"), F.col("slope").alias("importance"))
        for member, x in (("linear", "sales_lag_1"), ("rolling_mean", "rolling_mean"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "m7_feature_importance",
    SCORED
    + f""",
importances AS (
  SELECT level, key, 'linear' AS member, 'sales_lag_1' AS feature,
         coalesce(regr_slope(y, naive), 0) AS importance FROM folded GROUP BY level, key
  UNION ALL
  SELECT level, key, 'rolling_mean', 'rolling_mean', coalesce(regr_slope(y, rolling_mean), 0)
  FROM folded GROUP BY level, key),
raw AS (
  SELECT level, key, feature, sum(weight * abs(importance)) AS v
  FROM importances JOIN weights USING (level, key, member) GROUP BY level, key, feature)
SELECT level, key, feature, {rnd("v / sum(v) OVER (PARTITION BY level, key)", 6)} AS importance FROM raw""",
)
def m7(spark, sf):
    rows = folded(spark, sf)
    weights = E.inverse_error_weights(member_errors(rows))
    return shown(E.feature_importance(importance_rows(rows), weights), 6)


@query(
    "m9_hierarchical_prediction",
    PREDICTED
    + f"""
SELECT product_id, CAST(MONAT AS VARCHAR) AS MONAT, {rnd("greatest(0, mean)")} AS predicted_sales,
       {rnd("greatest(0, mean - 1.96 * s)")} AS lower_bound, {rnd("greatest(0, mean + 1.96 * s)")} AS upper_bound,
       model_level
FROM spread""",
)
def m9(spark, sf):
    return shown(E.hierarchical_prediction(predicted_rows(spark, sf), MEMBERS))


@query(
    "m10_member_scoreboard",
    SCORED
    + f"""
SELECT level, key, member, mae, CAST(row_number() OVER (PARTITION BY level, key ORDER BY mae, member) AS INTEGER) AS place
FROM (SELECT level, key, member, {rnd("mae", 6)} AS mae FROM maes)""",
)
def m10(spark, sf):
    """Errors are rounded before they are ranked, so that equal ones stand by name in either engine."""
    return E.member_scoreboard(errors(spark, sf).withColumn("mae", half_up("mae", 6)))
