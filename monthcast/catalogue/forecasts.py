"""Queries: statistical and decomposition forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthcast.catalogue.registry import filled, monthly, query, rnd, shown
from monthcast.catalogue.series import DECOMPOSED, SPECTRUM
from monthcast.operators import decomposition as D
from monthcast.operators import trend as M
from monthcast.operators.routing import routed_forecast, with_method
from monthcast.operators.series import fill_month_gaps
from monthcast.plans.forecasts import forecast_all, monthly_table, summarize_all

STATS = SPECTRUM + """,
stats AS (
  SELECT product_id, any_value(n) AS n, max(MONAT) AS last_month, avg(x) AS mean, min(x) AS lo, max(x) AS hi,
         stddev_pop(x) AS sd, regr_slope(x, CAST(t AS DOUBLE)) AS slope,
         regr_intercept(x, CAST(t AS DOUBLE)) AS intercept,
         list(x ORDER BY t) AS xs
  FROM pos GROUP BY product_id),
smooth AS (
  SELECT product_id, xs[1] AS s0, list_reduce(xs, lambda a, b: 0.3 * b + 0.7 * a) AS s1,
         CASE WHEN least(6, n // 2) > 1 THEN list_avg(xs[n - least(6, n // 2) + 1 :]) ELSE xs[n] END AS level,
         CASE WHEN n >= 12 THEN (list_avg(xs[n-2:n]) - list_avg(xs[n-5:n-3]))
                              - (list_avg(xs[n-5:n-3]) - list_avg(xs[n-8:n-6])) ELSE 0 END AS acceleration
  FROM stats),
indices AS (
  SELECT product_id, t % 12 AS p, CASE WHEN any_value(mean) > 0 THEN avg(x) / any_value(mean) ELSE 1 END AS idx
  FROM pos JOIN stats USING (product_id) GROUP BY product_id, t % 12),
growths AS (
  SELECT product_id, CASE WHEN any_value(n) >= 24 THEN
           coalesce(avg((x - base) / base) FILTER (WHERE base > 0), 0) ELSE 0 END AS growth
  FROM (SELECT *, lag(x, 12) OVER (PARTITION BY product_id ORDER BY t) AS base FROM pos) GROUP BY product_id),
parts_by_step AS (
  SELECT s.product_id, step, n, last_month, s.mean, s.lo, s.hi, s.sd,
         slope * (n + step + 1) + intercept AS f1,
         s1 + (s1 - s0) / n * (step + 1) AS f2,
         level AS f3, growth,
         coalesce(0.1 * sin(2 * pi() * step / period) * s.mean, 0) AS f7,
         coalesce(idx, 1) AS idx,
         CASE WHEN n < 6 THEN 0 ELSE acceleration * (step + 1) * 0.1 * exp(-0.1 * step) END AS f9
  FROM stats s JOIN smooth USING (product_id) JOIN growths USING (product_id)
  LEFT JOIN periods USING (product_id)
  CROSS JOIN steps
  LEFT JOIN indices i ON i.product_id = s.product_id AND i.p = (n + step) % 12),
blends AS (
  SELECT *, CASE WHEN n < 2 THEN 0 ELSE 0.4 * f1 + 0.3 * f2 + 0.3 * f3 END AS f4,
         CASE WHEN n < 12 THEN 0 ELSE (idx - 1) * mean * 0.3 + growth * mean * 0.2 + f7 * 0.5 END AS f8
  FROM parts_by_step),
f10 AS (
  SELECT *, CAST(last_month + to_months(CAST(step + 1 AS INTEGER)) AS DATE) AS month,
         CASE WHEN n < 3 THEN 0 ELSE greatest(0, f4 + f8 + f9) END AS forecast
  FROM blends)"""

STEP_COLUMN = "CAST(step AS INTEGER) AS step"


def steps_sql(column: str, name: str) -> str:
    return f"{STATS} SELECT product_id, {STEP_COLUMN}, {rnd(column)} AS {name} FROM f10"


def stepped(spark, sf, component, name):
    steps = M.forecast_steps(M.series_statistics(filled(spark, sf)))
    return shown(steps.select("product_id", "step", component.alias(name)))


@query("f1_linear_trend", steps_sql("f1", "linear"))
def f1(spark, sf):
    return stepped(spark, sf, M.linear_trend(), "linear")


@query("f2_smoothed_trend", steps_sql("f2", "smoothed"))
def f2(spark, sf):
    return stepped(spark, sf, M.smoothed_trend(), "smoothed")


@query("f3_moving_level", steps_sql("f3", "level"))
def f3(spark, sf):
    return stepped(spark, sf, M.moving_level(), "level")


@query("f4_blended_trend", steps_sql("f4", "trend"))
def f4(spark, sf):
    return stepped(spark, sf, M.blended_trend(), "trend")


@query(
    "f5_seasonal_indices",
    STATS
    + f"""
SELECT product_id, CAST(p AS INTEGER) AS position, {rnd("idx")} AS seasonal_index
FROM indices JOIN stats USING (product_id) WHERE n >= 12""",
)
def f5(spark, sf):
    stats = M.series_statistics(filled(spark, sf)).where(F.col("n") >= 12)
    return shown(stats.select("product_id", F.posexplode("seasonal_index").alias("position", "seasonal_index")))


@query("f6_yearly_growth", STATS + f"SELECT product_id, {rnd('growth', 6)} AS growth FROM growths")
def f6(spark, sf):
    return shown(M.series_statistics(filled(spark, sf)).select("product_id", "growth"), 6)


@query("f7_dominant_wave", steps_sql("CASE WHEN n >= 24 THEN f7 ELSE 0 END", "wave"))
def f7(spark, sf):
    return stepped(spark, sf, M.wave(), "wave")


@query("f8_seasonal_blend", steps_sql("f8", "seasonal"))
def f8(spark, sf):
    return stepped(spark, sf, M.seasonal_blend(), "seasonal")


@query("f9_residual_adjustment", steps_sql("f9", "adjustment"))
def f9(spark, sf):
    return stepped(spark, sf, M.residual_adjustment(), "adjustment")


@query(
    "f9_volatility",
    STATS
    + f"""
SELECT product_id, CASE WHEN n >= 6 THEN {rnd("list_stddev_pop(xs[n-5:n]) / (list_avg(xs[n-5:n]) + 1e-8)", 6)}
  ELSE 0 END AS volatility
FROM stats""",
)
def f9_volatility(spark, sf):
    return shown(M.series_statistics(filled(spark, sf)).select("product_id", "volatility"), 6)


def uniform_sql(salt: int) -> str:
    return f"(CAST('0x' || substr(md5(product_id || ':' || step || ':7:{salt}'), 1, 10) AS BIGINT) + 0.5) / 1099511627776"


NOISE = f"sqrt(-2 * ln({uniform_sql(1)})) * cos(2 * pi() * {uniform_sql(2)})"


@query(
    "f9_seeded_noise",
    STATS
    + f"""
SELECT product_id, {STEP_COLUMN}, CASE WHEN f.n < 6 THEN 0.0 ELSE {rnd(
        f"f9 + {NOISE} * (list_stddev_pop(xs[f.n-5:f.n]) / (list_avg(xs[f.n-5:f.n]) + 1e-8)) * f.mean * 0.1 * exp(-0.1 * step)"
    )} END AS adjustment
FROM f10 f JOIN stats USING (product_id)""",
)
def f9_noise(spark, sf):
    """Noise is fixed by product, step and seed, whatever the partitioning."""
    return stepped(spark, sf, M.residual_adjustment(noise_seed=7), "adjustment")


@query(
    "f10_statistical_forecast",
    STATS
    + f"SELECT product_id, CAST(month AS VARCHAR) AS MONAT, {STEP_COLUMN}, {rnd('forecast')} AS forecast FROM f10",
)
def f10(spark, sf):
    return shown(M.statistical_forecast(filled(spark, sf)))


DECOMPOSITION = (
    STATS
    + DECOMPOSED[DECOMPOSED.index(",\nlengths AS") :]
    + """,
recent AS (
  SELECT *, t - greatest(n - 6, 0) AS i, lag(residual) OVER (PARTITION BY product_id ORDER BY t) AS older
  FROM parts),
tail AS (
  SELECT product_id, regr_slope(trend, CAST(i AS DOUBLE)) AS tslope,
         regr_intercept(trend, CAST(i AS DOUBLE)) AS tintercept, arg_max(trend, t) AS tlast,
         arg_max(residual, t) AS rlast,
         covar_pop(residual, older) FILTER (WHERE i > 0) /
           nullif((stddev_pop(residual) FILTER (WHERE i > 0)) * (stddev_pop(older) FILTER (WHERE i > 0)), 0) AS c
  FROM recent WHERE i >= 0 GROUP BY product_id),
month_season AS (
  SELECT product_id, month(MONAT) AS m, avg(seasonal) AS season FROM parts GROUP BY ALL),
f14_parts AS (
  SELECT s.product_id, step, s.n, last_month, mean, lo, hi, sd,
         CASE WHEN n < 2 THEN tlast ELSE tslope * (least(n, 6) + step + 1) + tintercept END AS f11,
         CASE WHEN n < 12 THEN 0 ELSE coalesce(season, 0) END AS f12,
         CASE WHEN n < 3 THEN 0
              ELSE rlast * power(greatest(-0.8, least(0.8, coalesce(c, 0.8))), step + 1) END AS f13
  FROM stats s JOIN tail USING (product_id) CROSS JOIN steps
  LEFT JOIN month_season q ON q.product_id = s.product_id AND q.m = (month(last_month) + step + 11) % 12 + 1),
clamped AS (
  SELECT *, greatest(greatest(0, lo * 0.1), least(hi * 2, greatest(0, f11 + f12 + f13))) AS v FROM f14_parts),
f14 AS (
  SELECT *, CAST(last_month + to_months(CAST(step + 1 AS INTEGER)) AS DATE) AS month,
         CASE WHEN n < 6 THEN 0 WHEN v > mean + 2 * sd THEN mean + 1.5 * sd
              WHEN v < mean - 2 * sd THEN greatest(0, mean - 1.5 * sd) ELSE v END AS forecast
  FROM clamped)"""
)


def decomposed_steps(spark, sf, **components):
    steps = M.forecast_steps(D.decomposition_statistics(D.decompose(filled(spark, sf))))
    return shown(steps.select("product_id", "step", *[c.alias(n) for n, c in components.items()]))


@query(
    "f11_trend_extrapolation",
    f"{DECOMPOSITION} SELECT product_id, {STEP_COLUMN}, {rnd('f11')} AS trend FROM f14_parts",
)
def f11(spark, sf):
    return decomposed_steps(spark, sf, trend=D.trend_extrapolation())


@query(
    "f12_seasonal_projection",
    f"{DECOMPOSITION} SELECT product_id, {STEP_COLUMN}, {rnd('f12')} AS seasonal FROM f14_parts",
)
def f12(spark, sf):
    return decomposed_steps(spark, sf, seasonal=D.seasonal_projection())


@query(
    "f13_residual_decay",
    f"{DECOMPOSITION} SELECT product_id, {STEP_COLUMN}, {rnd('f13')} AS residual FROM f14_parts",
)
def f13(spark, sf):
    return decomposed_steps(spark, sf, residual=D.residual_decay())


@query(
    "f14_decomposition_forecast",
    DECOMPOSITION
    + f"SELECT product_id, CAST(month AS VARCHAR) AS MONAT, {STEP_COLUMN}, {rnd('forecast')} AS forecast FROM f14",
)
def f14(spark, sf):
    return shown(D.decomposition_forecast(filled(spark, sf)))


@query(
    "f15_bounds",
    STATS
    + f""",
wide AS (SELECT *, greatest(greatest(0, lo * 0.1), least(hi * 2, f1 * 3 - mean)) AS v FROM f10)
SELECT product_id, {STEP_COLUMN},
       {rnd('''CASE WHEN v > mean + 2 * sd THEN mean + 1.5 * sd
            WHEN v < mean - 2 * sd THEN greatest(0, mean - 1.5 * sd) ELSE v END''')} AS bounded
FROM wide""",
)
def f15(spark, sf):
    """Bounds applied to a trend blown up so that they bite on either side."""
    return stepped(spark, sf, D.bounded(M.linear_trend() * 3 - F.col("mean")), "bounded")


LISTED = ("A0000007", "A0000011", "A0000042", "A0000123", "A0000150")
LISTED_SQL = ", ".join(f"'{p}'" for p in LISTED)


@query(
    "f16_method_routing",
    STATS
    + f"""
SELECT product_id, CASE WHEN product_id IN ({LISTED_SQL}) THEN 'decomposition' ELSE 'statistical' END AS method
FROM stats""",
)
def f16(spark, sf):
    return with_method(monthly(spark, sf).select("product_id").distinct(), LISTED)


@query(
    "f17_forecast_calendar",
    STATS
    + f"""
SELECT product_id, {STEP_COLUMN}, CAST(CAST(last_month + to_months(CAST(step + 1 AS INTEGER)) AS DATE) AS VARCHAR)
  AS MONAT FROM stats CROSS JOIN (SELECT unnest(range(12)) AS step)""",
)
def f17(spark, sf):
    last = filled(spark, sf).groupBy("product_id").agg(F.max("MONAT").alias("last_month"))
    return shown(M.forecast_steps(last, 12).select("product_id", "step", "MONAT"))


ALL = (
    DECOMPOSITION
    + f""",
routed AS (
  SELECT product_id, month, step, forecast, 'statistical' AS method FROM f10
  WHERE product_id NOT IN ({LISTED_SQL})
  UNION ALL
  SELECT product_id, month, step, forecast, 'decomposition' FROM f14 WHERE product_id IN ({LISTED_SQL}))"""
)


@query(
    "p4_forecast_all_products",
    ALL
    + f"""
SELECT product_id, CAST(month AS VARCHAR) AS MONAT, {STEP_COLUMN}, {rnd("forecast")} AS forecast, method
FROM routed""",
)
def p4(spark, sf):
    return shown(forecast_all(monthly_table(monthly(spark, sf)), decomposed=LISTED))


@query(
    "p4_forecast_summary",
    ALL
    + f"""
SELECT product_id, {rnd("total")} AS total_forecast, {rnd("total / 6")} AS avg_forecast,
       CAST(trunc(total) AS BIGINT) AS total_forecast_shown, CAST(trunc(total / 6) AS BIGINT) AS avg_forecast_shown,
       {rnd("CASE WHEN mean > 0 THEN (total / 6 - mean) / mean * 100 ELSE 0 END")} AS change_pct
FROM (SELECT product_id, sum(forecast) AS total FROM routed GROUP BY product_id)
JOIN (SELECT product_id, avg(anz_produkt) AS mean FROM fact GROUP BY product_id) USING (product_id)""",
)
def p4_summary(spark, sf):
    series = monthly_table(monthly(spark, sf))
    return shown(summarize_all(series, forecast_all(series, decomposed=LISTED)))


@query(
    "p4_routed_twelve_months",
    ALL.replace("range(6)", "range(12)")
    + f"""
SELECT product_id, CAST(month AS VARCHAR) AS MONAT, {STEP_COLUMN}, {rnd("forecast")} AS forecast, method
FROM routed""",
)
def p4_twelve(spark, sf):
    return shown(routed_forecast(fill_month_gaps(monthly_table(monthly(spark, sf))), 12, LISTED))
