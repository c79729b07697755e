"""Additive decomposition (trend, season, residual) and the forecast built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthcast import settings as S
from monthcast.operators.trend import YEAR, age, forecast_steps, length, position, step, value

# --- fixed values -----------------------------------------------------------
RECENT = 6
MAX_COEFFICIENT = 0.8
MIN_FLOOR_SHARE = 0.1
MAX_CEILING = 2
EXTREME_SIGMAS = 2
EXTREME_SHIFT = 1.5
# --- end of fixed values ----------------------------------------------------


def centred_trend(filled: DataFrame) -> DataFrame:
    """Centred moving average over min(12, n/2) months, ends repeated outwards.

    The frame [t-(m-1-o), t+o] with o = (m-1)/2 has a length that depends on
    the series, so each possible length is a constant window frame and the
    series picks its own.
    """
    ordered = Window.partitionBy("product_id").orderBy("MONAT")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    width = F.least(F.lit(YEAR), F.expr("n div 2"))
    average = F.when(width <= 1, value())
    for m in range(2, YEAR + 1):
        after = (m - 1) // 2
        before = m - 1 - after
        full = (position() >= before) & (age() >= after)
        average = average.when(
            (width == m) & full, F.avg("anz_produkt").over(ordered.rowsBetween(-before, after))
        )
    first = F.first("_average", ignorenulls=True).over(whole)
    last = F.last("_average", ignorenulls=True).over(whole)
    return (
        filled.withColumn("_average", average)
        .withColumn("trend", F.coalesce("_average", F.when(position() < length() / 2, first).otherwise(last)))
        .drop("_average")
    )


def decompose(filled: DataFrame) -> DataFrame:
    """Columns ``trend``, ``seasonal`` (0 under a year of rows) and ``residual``.

    The calendar months' means are twelve aggregates over the series as the
    trend left it sorted; a window by month would sort all rows again, and
    whatever follows by date once more.
    """
    ordered = Window.partitionBy("product_id").orderBy("MONAT")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    month = F.month("MONAT")
    means = [F.avg(F.when(month == m, value() - F.col("trend"))).over(whole) for m in range(1, YEAR + 1)]
    season = F.when(length() >= YEAR, F.get(F.array(*means), month - 1)).otherwise(0.0)
    return (
        centred_trend(filled)
        .withColumn("seasonal", season)
        .withColumn("residual", value() - F.col("trend") - F.col("seasonal"))
    )


def decomposition_statistics(parts: DataFrame) -> DataFrame:
    """One row per product with what the three component forecasts need."""
    recent = age() < RECENT
    offset = position() - F.greatest(length() - RECENT, F.lit(0))
    ordered = Window.partitionBy("product_id").orderBy("MONAT")
    pairs = parts.withColumn("_before", F.lag("residual").over(ordered))
    paired = (age() < RECENT - 1) & (position() > 0)
    newer, older = F.when(paired, F.col("residual")), F.when(paired, F.col("_before"))
    month = F.month("MONAT")
    return pairs.groupBy("product_id").agg(
        F.max("n").alias("n"),
        F.max("MONAT").alias("last_month"),
        F.avg(value()).alias("mean"),
        F.stddev_pop(value()).alias("deviation"),
        F.min(value()).alias("smallest"),
        F.max(value()).alias("largest"),
        F.regr_slope(F.when(recent, F.col("trend")), F.when(recent, offset)).alias("trend_slope"),
        F.regr_intercept(F.when(recent, F.col("trend")), F.when(recent, offset)).alias("trend_intercept"),
        F.max(F.when(age() == 0, F.col("trend"))).alias("trend_last"),
        F.array(*[F.avg(F.when(month == m, F.col("seasonal"))) for m in range(1, YEAR + 1)]).alias(
            "month_season"
        ),
        F.max(F.when(age() == 0, F.col("residual"))).alias("residual_last"),
        F.try_divide(
            F.covar_pop(older, newer), F.stddev_pop(older) * F.stddev_pop(newer)
        ).alias("_correlation"),
    ).withColumn(
        "coefficient",
        F.greatest(
            F.lit(-MAX_COEFFICIENT),
            F.least(F.lit(MAX_COEFFICIENT), F.coalesce("_correlation", F.lit(MAX_COEFFICIENT))),
        ),
    ).drop("_correlation")


def trend_extrapolation() -> Column:
    """Line through the last six trend values, continued past their end."""
    used = F.least(length(), F.lit(RECENT))
    return F.when(length() < 2, F.col("trend_last")).otherwise(
        F.col("trend_slope") * (used + step() + 1) + F.col("trend_intercept")
    )


def seasonal_projection() -> Column:
    """Seasonal mean by calendar month; step 0 repeats the last observed month."""
    index = (F.month("last_month") + step() + 11) % YEAR
    return F.when(length() < YEAR, 0.0).otherwise(F.coalesce(F.get("month_season", index), F.lit(0.0)))


def residual_decay() -> Column:
    """Last residual times the first-order coefficient, once more each step."""
    return F.when(length() < 3, 0.0).otherwise(F.col("residual_last") * F.pow("coefficient", step() + 1))


def bounded(forecast: Column) -> Column:
    """Within a tenth of the minimum and twice the maximum, extremes pulled in."""
    low = F.greatest(F.lit(0.0), F.col("smallest") * MIN_FLOOR_SHARE)
    high = F.col("largest") * MAX_CEILING
    clamped = F.greatest(low, F.least(high, forecast))
    mean, sigma = F.col("mean"), F.col("deviation")
    return (
        F.when(clamped > mean + EXTREME_SIGMAS * sigma, mean + EXTREME_SHIFT * sigma)
        .when(
            clamped < mean - EXTREME_SIGMAS * sigma,
            F.greatest(F.lit(0.0), mean - EXTREME_SHIFT * sigma),
        )
        .otherwise(clamped)
    )


def decomposition_forecast(filled: DataFrame, horizon: int = S.HORIZON_MONTHS) -> DataFrame:
    """Sum of the three component forecasts, bounded; 0 under six rows."""
    total = F.greatest(F.lit(0.0), trend_extrapolation() + seasonal_projection() + residual_decay())
    stats = decomposition_statistics(decompose(filled))
    return forecast_steps(stats, horizon).select(
        "product_id",
        "MONAT",
        "step",
        F.when(length() < RECENT, 0.0).otherwise(bounded(total)).alias("forecast"),
    )
