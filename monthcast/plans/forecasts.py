"""Forecast, summary and export of every product in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from monthcast import settings as S
from monthcast.operators.cleaning import collapse_months
from monthcast.operators.reporting import (
    export_rows,
    forecast_summary,
    history_and_forecast,
    product_kpis,
)
from monthcast.operators.routing import routed_forecast
from monthcast.operators.series import fill_month_gaps
from monthcast.session import materialize


def monthly_table(fact: DataFrame) -> DataFrame:
    """The collapsed series of all products, written once.

    Both forecast methods, the summary and the export start from it; read
    from the raw lines, each would scan and aggregate them again.
    """
    return materialize(collapse_months(fact), "monthly")


def forecast_all(
    monthly: DataFrame,
    horizon: int = S.HORIZON_MONTHS,
    decomposed: Sequence[str] = S.DECOMPOSED_PRODUCTS,
    noise_seed: int | None = None,
) -> DataFrame:
    """Monthly table -> one row per product and coming month."""
    filled = fill_month_gaps(monthly)
    return routed_forecast(filled, horizon, decomposed, noise_seed)


def summarize_all(monthly: DataFrame, forecast: DataFrame) -> DataFrame:
    return forecast_summary(forecast, product_kpis(monthly))


def export_all(monthly: DataFrame, forecast: DataFrame, descriptions: DataFrame) -> DataFrame:
    return export_rows(history_and_forecast(monthly, forecast), descriptions)
