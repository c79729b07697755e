"""Choice of forecast method per product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthcast import settings as S
from monthcast.operators.decomposition import decomposition_forecast
from monthcast.operators.trend import statistical_forecast


def with_method(df: DataFrame, decomposed: Sequence[str] = S.DECOMPOSED_PRODUCTS) -> DataFrame:
    """Column ``method``: decomposition for the listed products, else statistical."""
    listed = F.col("product_id").isin(*decomposed)
    return df.withColumn("method", F.when(listed, "decomposition").otherwise("statistical"))


def routed_forecast(
    filled: DataFrame,
    horizon: int = S.HORIZON_MONTHS,
    decomposed: Sequence[str] = S.DECOMPOSED_PRODUCTS,
    noise_seed: int | None = None,
) -> DataFrame:
    """Each product forecast by its own method, in one job."""
    listed = F.col("product_id").isin(*decomposed)
    return with_method(
        statistical_forecast(filled.where(~listed), horizon, noise_seed).unionByName(
            decomposition_forecast(filled.where(listed), horizon)
        ),
        decomposed,
    )
