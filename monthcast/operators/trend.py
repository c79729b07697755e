"""Statistical forecasts from one row of statistics per product.

``series_statistics`` reduces a gap-filled series to one row; every forecast
is a projection of that row onto the horizon's steps. Unused statistics are
pruned by the optimizer, so a single component costs only its own part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthcast import settings as S
from monthcast.operators.spectrum import ordered_values, strongest_frequency

# --- fixed values -----------------------------------------------------------
SMOOTHING = 0.3
LEVEL_MONTHS = 6
TREND_WEIGHTS = (0.4, 0.3, 0.3)
YEAR = 12
SEASONAL_SHARE = 0.3
GROWTH_SHARE = 0.2
WAVE_SHARE = 0.5
WAVE_AMPLITUDE = 0.1
ACCELERATION_STEP = 0.1
DECAY = 0.1
NOISE_SHARE = 0.1
TINY = 1e-8
# --- end of fixed values ----------------------------------------------------


def value() -> Column:
    return F.col("anz_produkt")


def position() -> Column:
    return F.col("t")


def length() -> Column:
    return F.col("n")


def age() -> Column:
    """Months since, 0 for the newest row."""
    return length() - 1 - position()


def step() -> Column:
    """Forecast step, 0 .. horizon-1."""
    return F.col("step")


def forecast_steps(per_product: DataFrame, horizon: int = S.HORIZON_MONTHS) -> DataFrame:
    """``horizon`` rows per product: step 0.. and the month it stands for."""
    return per_product.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))).withColumn(
        "MONAT", F.add_months("last_month", F.col("step") + 1)
    )


def _mean(values: Column) -> Column:
    """Mean of an array, null when it is empty."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda total, x: total + x), F.size(values))


def _recent(months: int, skip: int = 0) -> Column:
    """The values of ``months`` months, ``skip`` months back from the newest."""
    return F.slice("_values", -(months + skip), months)


def _position_means() -> Column:
    """Mean by position in the year, null where a short series has none."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(YEAR - 1)),
        lambda p: _mean(F.filter("_values", lambda _, i: i % YEAR == p)),
    )


def _growths() -> Column:
    """Relative changes over a year, where the year before sold something."""
    changes = F.zip_with(
        F.slice(F.col("_values"), F.lit(YEAR + 1), length()),
        F.slice(F.col("_values"), F.lit(1), F.greatest(length() - YEAR, F.lit(0))),
        lambda x, base: F.when(base > 0, (x - base) / base),
    )
    return F.filter(changes, lambda change: change.isNotNull())


def series_statistics(filled: DataFrame) -> DataFrame:
    """Everything the forecasts need, one row per product.

    One aggregation takes the moments and the values in order; the values are
    as many as the calendar has months, and what depends on their order is
    read off that array.
    """
    stats = filled.groupBy("product_id").agg(
        F.max("n").alias("n"),
        F.max("MONAT").alias("last_month"),
        F.avg(value()).alias("mean"),
        F.min(value()).alias("smallest"),
        F.max(value()).alias("largest"),
        F.stddev_pop(value()).alias("deviation"),
        F.regr_slope(value(), position()).alias("slope"),
        F.regr_intercept(value(), position()).alias("intercept"),
        ordered_values().alias("_values"),
    )
    mean = F.col("mean")
    level_months = F.greatest(F.lit(1), F.least(F.lit(LEVEL_MONTHS), F.floor(length() / 2))).cast("int")
    index = F.transform(
        _position_means(), lambda m: F.when((mean > 0) & m.isNotNull(), m / mean).otherwise(F.lit(1.0))
    )
    newest, middle, oldest = (_mean(_recent(3, skip)) for skip in (0, 3, 6))
    half_year = _recent(6)
    half_mean = _mean(half_year)
    half_deviation = F.sqrt(_mean(F.transform(half_year, lambda x: F.pow(x - half_mean, 2))))
    return stats.select(
        "product_id",
        "n",
        "last_month",
        "mean",
        "smallest",
        "largest",
        "deviation",
        "slope",
        "intercept",
        F.get("_values", F.lit(0)).alias("smooth_first"),
        F.aggregate(
            "_values", F.get("_values", F.lit(0)), lambda s, x: s * (1 - SMOOTHING) + x * SMOOTHING
        ).alias("smooth_last"),
        _mean(F.slice(F.col("_values"), -level_months, level_months)).alias("level"),
        index.alias("seasonal_index"),
        F.when(length() >= 2 * YEAR, F.coalesce(_mean(_growths()), F.lit(0.0))).otherwise(0.0).alias("growth"),
        F.when(length() >= YEAR, (newest - middle) - (middle - oldest)).otherwise(0.0).alias("acceleration"),
        F.when(length() >= 6, half_deviation / (half_mean + TINY)).otherwise(0.0).alias("volatility"),
        (length() / strongest_frequency("_values")).alias("period"),
    )


def linear_trend() -> Column:
    """Fitted line, one month beyond the next free position."""
    return F.col("slope") * (length() + step() + 1) + F.col("intercept")


def smoothed_trend() -> Column:
    rise = (F.col("smooth_last") - F.col("smooth_first")) / length()
    return F.col("smooth_last") + rise * (step() + 1)


def moving_level() -> Column:
    return F.col("level")


def blended_trend() -> Column:
    parts = (linear_trend(), smoothed_trend(), moving_level())
    return F.when(length() < 2, 0.0).otherwise(sum(w * p for w, p in zip(TREND_WEIGHTS, parts)))


def wave() -> Column:
    """Sine of the dominant period, a tenth of the mean high."""
    angle = 2 * F.pi() * step() / F.col("period")
    return F.coalesce(WAVE_AMPLITUDE * F.sin(angle) * F.col("mean"), F.lit(0.0))


def seasonal_blend() -> Column:
    index = F.get(F.col("seasonal_index"), (length() + step()) % YEAR)
    blend = (
        (index - 1) * F.col("mean") * SEASONAL_SHARE
        + F.col("growth") * F.col("mean") * GROWTH_SHARE
        + wave() * WAVE_SHARE
    )
    return F.when(length() < YEAR, 0.0).otherwise(blend)


def seeded_noise(seed: int) -> Column:
    """Standard normal value fixed by product, step and seed (not by partition)."""

    def uniform(salt):
        text = F.concat_ws(":", "product_id", step().cast("string"), F.lit(f"{seed}"), F.lit(f"{salt}"))
        return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("double") + 0.5) / float(2**40)

    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * F.pi() * uniform(2))


def residual_adjustment(noise_seed: int | None = None) -> Column:
    """Acceleration and, with a seed, volatility noise; both fade with the step."""
    push = F.col("acceleration") * (step() + 1) * ACCELERATION_STEP
    if noise_seed is not None:
        push = push + seeded_noise(noise_seed) * F.col("volatility") * F.col("mean") * NOISE_SHARE
    return F.when(length() < 6, 0.0).otherwise(push * F.exp(-DECAY * step()))


def statistical_forecast(
    filled: DataFrame, horizon: int = S.HORIZON_MONTHS, noise_seed: int | None = None
) -> DataFrame:
    """Trend + season + adjustment per product and step, never negative."""
    total = blended_trend() + seasonal_blend() + residual_adjustment(noise_seed)
    return forecast_steps(series_statistics(filled), horizon).select(
        "product_id",
        "MONAT",
        "step",
        F.when(length() < 3, 0.0).otherwise(F.greatest(F.lit(0.0), total)).alias("forecast"),
    )
