"""Dominant period of a series by discrete Fourier transform."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_SERIES = 24


def ordered_values(position: str = "t", value: str = "anz_produkt") -> Column:
    """Aggregate: a product's values in order. One value per calendar month,
    so the array is as short as the calendar, however many sales there were."""
    return F.sort_array(F.collect_list(F.struct(position, value))).getField(value)


@F.pandas_udf(T.IntegerType())
def strongest_frequency(series: pd.Series) -> pd.Series:
    """Index of the largest DFT magnitude among 1 .. n/2-1; null under 24 values.

    Equal magnitudes, float noise aside, give the lowest index.

    Series of one length are transformed together. Spark has no Fourier
    transform; sums of sines per frequency cost n*n/2 terms a series.
    """
    lengths = series.str.len().fillna(0).to_numpy()
    strongest = np.full(len(series), np.nan)
    for n in np.unique(lengths[lengths >= MIN_SERIES]).astype(int):
        same = np.flatnonzero(lengths == n)
        spectrum = np.fft.rfft(np.stack(series.iloc[same].to_numpy()), axis=1)
        power = np.round(np.abs(spectrum) ** 2, 6)
        strongest[same] = 1 + power[:, 1 : n // 2].argmax(axis=1)
    return pd.Series(strongest).astype("Int32")


def dominant_period(filled: DataFrame, value: str = "anz_produkt") -> DataFrame:
    """``k`` of the strongest frequency and its period n/k, for n >= 24."""
    return (
        filled.groupBy("product_id")
        .agg(F.max("n").alias("n"), ordered_values(value=value).alias("_values"))
        .where(F.col("n") >= MIN_SERIES)
        .select("product_id", "n", strongest_frequency("_values").alias("k"))
        .select("product_id", "k", (F.col("n") / F.col("k")).alias("period"))
    )
