"""Weighted ensembles over member predictions, at every level in one plan.

Members are columns of one table: a row carries ``level, key, fold``, the
target ``y`` and one prediction per member. Errors aggregate as columns and
are turned into (member, value) rows only once they are small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthcast.functions.skew import salted_lookup

# --- fixed values -----------------------------------------------------------
BAND_SIGMAS = 1.96
# --- end of fixed values ----------------------------------------------------


def cross_validation_errors(folded: DataFrame, members: Sequence[str], target: str = "y") -> DataFrame:
    """Mean absolute error per level, key and member: the mean of the folds' means."""
    per_fold = (
        folded.where(F.col("fold") > 0)
        .groupBy("level", "key", "fold")
        .agg(*[F.avg(F.abs(F.col(target) - F.col(m))).alias(m) for m in members])
    )
    return (
        per_fold.groupBy("level", "key")
        .agg(*[F.avg(m).alias(m) for m in members])
        .unpivot(["level", "key"], list(members), "member", "mae")
    )


def fold_errors(folded: DataFrame, members: Sequence[str], target: str = "y") -> DataFrame:
    """Mean absolute error of every single fold."""
    return (
        folded.where(F.col("fold") > 0)
        .groupBy("level", "key", "fold")
        .agg(*[F.avg(F.abs(F.col(target) - F.col(m))).alias(m) for m in members])
        .unpivot(["level", "key", "fold"], list(members), "member", "mae")
    )


def inverse_error_weights(errors: DataFrame) -> DataFrame:
    """Weight 1/mae over the sum of 1/mae; members without a positive error get 0."""
    inverse = F.when(F.col("mae") > 0, 1 / F.col("mae"))
    total = F.sum(inverse).over(Window.partitionBy("level", "key"))
    return errors.withColumn("weight", F.coalesce(F.try_divide(inverse, total), F.lit(0.0)))


def with_inherited_weights(weights: DataFrame, keys: DataFrame) -> DataFrame:
    """Weights for every (level, key) of ``keys``: its own, else its category's, else the global ones.

    ``keys`` has level, key and category (null above the product level). The
    column ``weights_from`` names the level they come from. A model has as
    many rows as there are members, so the maps are small.
    """
    entry = F.struct("member", F.struct("mae", "weight"))
    own = weights.groupBy("level", "key").agg(F.map_from_entries(F.collect_list(entry)).alias("_w"))
    category = own.where("level = 'category'").select(F.col("key").alias("category"), F.col("_w").alias("_c"))
    overall = own.where("level = 'global'").select("_w").scalar()
    found = keys.join(own, ["level", "key"], "left").join(category, "category", "left")
    chosen = found.select(
        "level",
        "key",
        F.when(F.col("_w").isNotNull(), F.col("level"))
        .when(F.col("_c").isNotNull(), F.lit("category"))
        .otherwise(F.lit("global"))
        .alias("weights_from"),
        F.explode(F.coalesce("_w", "_c", overall)).alias("member", "_v"),
    )
    return chosen.select("level", "key", "member", "_v.mae", "_v.weight", "weights_from")


def member_scoreboard(errors: DataFrame) -> DataFrame:
    """Members of each model, best first."""
    order = Window.partitionBy("level", "key").orderBy("mae", "member")
    return errors.withColumn("place", F.row_number().over(order))


def wide_weights(weights: DataFrame, members: Sequence[str]) -> DataFrame:
    """One row per level and key with a ``w_<member>`` column each."""
    return weights.groupBy("level", "key").agg(
        *[F.max(F.when(F.col("member") == m, F.col("weight"))).alias(f"w_{m}") for m in members]
    )


def most_specific(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Attach to each row the model of its product, else category, else the global one.

    ``models`` has one row per (level, key). The large product part joins on
    the product, which has one row per month; the category part is spread
    over salted keys, as one category may hold most rows; the global model is
    a single row and needs no join. Adds ``model_level``, ``model_key`` and
    the columns of the chosen model.
    """
    names = [c for c in models.columns if c not in ("level", "key")]
    model = F.struct("level", "key", *names)

    def at(level, column):
        return models.where(F.col("level") == level).select(
            F.col("key").alias(column), model.alias(f"_{level}")
        )

    joined = rows.join(at("product", "product_id"), "product_id", "left")
    joined = salted_lookup(joined, at("category", "product_category_id"), ["product_category_id"], ["product_id"])
    overall = models.where(F.col("level") == "global").select(model).scalar()
    chosen = joined.withColumn("_model", F.coalesce("_product", "_category", overall))
    return chosen.select(
        *rows.columns,
        F.col("_model.level").alias("model_level"),
        F.col("_model.key").alias("model_key"),
        *[F.col(f"_model.{c}").alias(c) for c in names],
    )


def _weighted(members: Sequence[str]) -> Column:
    return sum(F.coalesce(F.col(f"w_{m}"), F.lit(0.0)) * F.col(m) for m in members)


def ensemble_prediction(members: Sequence[str]) -> Column:
    """Weighted sum of the members, never negative."""
    return F.greatest(F.lit(0.0), _weighted(members))


def _spread(members: Sequence[str]) -> Column:
    """Population deviation of the members, each counted once."""
    count = float(len(members))
    mean = sum(F.col(m) for m in members) / count
    return F.sqrt(sum(F.pow(F.col(m) - mean, 2) for m in members) / count)


def ensemble_band(df: DataFrame, members: Sequence[str]) -> DataFrame:
    """Weighted mean and +-1.96 member deviations, each clipped at 0 afterwards.

    All weights zero have no weighted mean: the prediction is null.
    """
    total = sum(F.coalesce(F.col(f"w_{m}"), F.lit(0.0)) for m in members)
    banded = df.withColumn("_mean", F.try_divide(_weighted(members), total)).withColumn(
        "_margin", BAND_SIGMAS * _spread(members)
    )

    def clipped(c):
        return F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))

    mean, margin = F.col("_mean"), F.col("_margin")
    return banded.withColumns(
        {
            "predicted_sales": clipped(mean),
            "lower_bound": clipped(mean - margin),
            "upper_bound": clipped(mean + margin),
        }
    ).drop("_mean", "_margin")


def hierarchical_prediction(levelled: DataFrame, members: Sequence[str]) -> DataFrame:
    """Band per row, from rows with member predictions and their model's weights."""
    return ensemble_band(levelled, members).select(
        "product_id", "MONAT", "predicted_sales", "lower_bound", "upper_bound", "model_level"
    )


def feature_importance(importances: DataFrame, weights: DataFrame) -> DataFrame:
    """Members' importances weighted, summed per feature, normalised to 1 per model.

    ``importances``: level, key, member, feature, importance (coefficients of
    a linear member enter with their size).
    """
    summed = (
        importances.join(weights.select("level", "key", "member", "weight"), ["level", "key", "member"])
        .groupBy("level", "key", "feature")
        .agg(F.sum(F.col("weight") * F.abs("importance")).alias("_raw"))
    )
    total = F.sum("_raw").over(Window.partitionBy("level", "key"))
    return summed.select(
        "level",
        "key",
        "feature",
        F.when(total > 0, F.col("_raw") / total).otherwise(F.col("_raw")).alias("importance"),
    )
