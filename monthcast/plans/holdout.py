"""Rolling-origin holdout: every product forecast again as of several cut-off dates, in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthcast import settings as S
from monthcast.operators import ensemble as E
from monthcast.operators.folds import with_level_keys
from monthcast.operators.routing import routed_forecast
from monthcast.operators.series import fill_month_gaps
from monthcast.session import clustered, dealt_to_buckets

#: Predictions that are weighed against each other; ``forecast`` is the routed forecast.
MEMBERS = ("forecast", "seasonal_naive", "naive")
CUTOFFS = 3


def cutoff_dates(monthly: DataFrame, cutoffs: int = CUTOFFS, horizon: int = S.HORIZON_MONTHS):
    """Array of (age, cutoff): the month ``age * horizon`` months before the last one of the table."""
    last = monthly.agg(F.max("MONAT")).scalar()
    ages = [(k, F.add_months(last, -horizon * k)) for k in range(1, cutoffs + 1)]
    return F.array(*[F.struct(F.lit(k).alias("age"), d.alias("cutoff")) for k, d in ages])


def holdout_predictions(
    monthly: DataFrame,
    cutoffs: int = CUTOFFS,
    horizon: int = S.HORIZON_MONTHS,
    decomposed: Sequence[str] = S.DECOMPOSED_PRODUCTS,
) -> DataFrame:
    """What each month's sales were, and what was expected of them at the cut-off before.

    A cut-off sees the rows up to its month, and the ``horizon`` months after
    it are its test; ``age`` 1 is the newest. A history's copies are keyed by
    age and product, so gap filling and forecasts of all cut-offs are those
    of one job over longer keys; they are written clustered by it, so statistics
    and rivals take them where they lie. Columns: product_id, age, cutoff, MONAT, y,
    forecast, seasonal_naive (a year before, else the mean of the last six
    months), naive (the last month).

    Products without a history at a cut-off, and months without sales or
    beyond a forecast that starts earlier, give no row there.
    """
    known = monthly.select("product_id", "MONAT", "anz_produkt").where(F.col("product_id").isNotNull())
    dated = known.select("*", F.explode(cutoff_dates(known, cutoffs, horizon)).alias("_c")).select("*", "_c.*")
    key = F.concat(F.col("age").cast("string"), F.lit(":"), F.col("product_id"))
    keyed = dated.drop("_c").withColumn("_key", key)
    past = keyed.where(F.col("MONAT") <= F.col("cutoff"))
    copies = past.select(F.col("_key").alias("product_id"), "MONAT", "anz_produkt")
    filled = clustered(fill_month_gaps(copies, deal=dealt_to_buckets), "holdout", "product_id")
    listed = [f"{k}:{p}" for k in range(1, cutoffs + 1) for p in decomposed]
    forecast = routed_forecast(filled, horizon, listed).select(
        F.col("product_id").alias("_key"), "MONAT", "forecast"
    )
    year_before = filled.select(
        F.col("product_id").alias("_key"), F.add_months("MONAT", 12).alias("MONAT"), F.col("anz_produkt").alias("_year")
    )
    recent = F.when(F.col("t") >= F.col("n") - 6, F.col("anz_produkt"))
    level = filled.groupBy(F.col("product_id").alias("_key")).agg(
        F.avg(recent).alias("_mean"), F.max_by("anz_produkt", "t").alias("naive")
    )
    ahead = (F.col("MONAT") > F.col("cutoff")) & (F.col("MONAT") <= F.add_months("cutoff", horizon))
    tests = keyed.where(ahead & F.col("anz_produkt").isNotNull())
    return (
        tests.join(forecast, ["_key", "MONAT"])
        .join(year_before, ["_key", "MONAT"], "left")
        .join(level, "_key")
        .select(
            "product_id",
            "age",
            "cutoff",
            "MONAT",
            F.col("anz_produkt").alias("y"),
            "forecast",
            F.coalesce("_year", "_mean").alias("seasonal_naive"),
            "naive",
        )
    )


def holdout_weights(predictions: DataFrame, members: Sequence[str] = MEMBERS) -> DataFrame:
    """Inverse-error weights from the cut-offs before the newest: a product's own, else those of all.

    One row per product tested at the newest cut-off and member: level, key,
    member, mae, weight, weights_from.
    """
    older = with_level_keys(predictions.where(F.col("age") > 1).withColumn("fold", F.col("age")), ["global", "product"])
    weights = E.inverse_error_weights(E.cross_validation_errors(older, members))
    keys = predictions.where(F.col("age") == 1).select(
        F.lit("product").alias("level"), F.col("product_id").alias("key"), F.lit(None).cast("string").alias("category")
    )
    return E.with_inherited_weights(weights, keys.distinct())


def with_holdout_ensemble(predictions: DataFrame, members: Sequence[str] = MEMBERS) -> DataFrame:
    """Rows of the newest cut-off with ``ensemble``, weighed by the errors at older ones, and ``weights_from``.

    Nothing after the newest cut-off enters the weights. Without an older
    cut-off there are none, and no row.
    """
    weights = holdout_weights(predictions, members)
    wide = E.wide_weights(weights, members).join(weights.select("key", "weights_from").distinct(), "key")
    rows = predictions.where(F.col("age") == 1).join(wide.withColumnRenamed("key", "product_id"), "product_id")
    return rows.withColumn("ensemble", E.ensemble_prediction(members)).drop("level", *[f"w_{m}" for m in members])


def holdout_errors(predictions: DataFrame, members: Sequence[str] = MEMBERS) -> DataFrame:
    """Per cut-off and member: months tested, mean absolute error, root mean square error, mean error.

    The newest cut-off also has the member ``ensemble``.
    """

    def errors(rows, names):
        measures = [
            F.struct(
                F.lit(m).alias("member"),
                F.count(m).alias("months"),
                F.avg(F.abs(F.col(m) - F.col("y"))).alias("mae"),
                F.sqrt(F.avg(F.pow(F.col(m) - F.col("y"), 2))).alias("rmse"),
                F.avg(F.col(m) - F.col("y")).alias("bias"),
            )
            for m in names
        ]
        found = rows.groupBy("age", "cutoff").agg(F.array(*measures).alias("_m"))
        return found.select("age", "cutoff", F.inline("_m"))

    return errors(predictions, members).unionByName(errors(with_holdout_ensemble(predictions, members), ["ensemble"]))
