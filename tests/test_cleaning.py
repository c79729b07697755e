"""Scalar cleaning, flags and the monthly aggregation on hand-made rows."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthcast.functions import scalars
from monthcast.operators import cleaning, outliers


def values(df, column):
    return [r[column] for r in df.collect()]


def test_ids_lose_all_white_space_at_the_ends_only(spark):
    df = spark.createDataFrame([(" \tA 1 \n",), (None,), ("B",)], "product_id string")
    assert values(cleaning.normalize_product_id(df), "product_id") == ["A 1", None, "B"]
    assert cleaning.normalize_product_id(df, "other").columns == ["product_id"]


def test_stock_article_id_pads_but_never_cuts(spark):
    rows = [("A1", "38", "SW"), ("A23456789X", "LARGE", None), ("A1", None, None), ("A1", " 40 ", "BLUE")]
    df = spark.createDataFrame(rows, "a string, g string, f string")
    got = values(df.select(scalars.stock_article_id("a", "g", "f").alias("id")), "id")
    want = [
        "A1".ljust(8) + "38".ljust(4) + "SW",
        "A23456789X" + "LARGE",
        "A1",
        "A1".ljust(8) + "40".ljust(4) + "BLUE",
    ]
    assert got == want


def test_stems(spark):
    df = spark.createDataFrame([("A1      38  SW",), ("SHORT",), ("  X",)], "product_id string")
    got = df.select(scalars.product_stem().alias("s"), scalars.index_stem().alias("i")).collect()
    assert [tuple(r) for r in got] == [("A1", "A1"), ("SHORT", "SHORT"), ("  X", "X")]


def test_covid_flag_is_inclusive_and_null_is_false(spark):
    days = [date(2019, 12, 31), date(2020, 1, 1), date(2022, 12, 31), date(2023, 1, 1), None]
    df = spark.createDataFrame([(d, 8.0) for d in days], "d date, q double")
    df = df.withColumn("c", cleaning.covid_flag("d"))
    assert values(df, "c") == [False, True, True, False, False]
    normalized = df.select(cleaning.covid_normalized("q", "c").alias("n"))
    assert values(normalized, "n") == [8.0, 10.0, 10.0, 8.0, 8.0]


def test_stock_outs_need_a_full_window(spark, monthly):
    df = cleaning.detect_stock_outs(monthly({"P": [0, 9, 0, 9, 0], "Z": [0, 0, 0]}))
    got = {(r.product_id, r.MONAT.month): r.stock_out for r in df.collect()}
    assert [got["P", m] for m in range(1, 6)] == [False, False, True, False, False]
    assert not any(got["Z", m] for m in range(1, 4))


def test_price_changes(spark):
    prices = [0.0, 5.0, None, 5.0, 5.5, 0.0, 0.0, 6.0, 6.5]
    rows = [("P", i, p) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "product_id string, MONAT int, unit_preis double")
    got = values(cleaning.detect_price_changes(df).orderBy("MONAT"), "price_change")
    exactly_a_tenth = abs(5.5 / 5.0 - 1) > 0.1
    assert got == [False, True, False, False, exactly_a_tenth, True, False, True, False]


def test_categories(spark):
    df = spark.createDataFrame([(" shoes ",), ("NaN",), ("none",), ("  ",), (None,)], "c string")
    assert values(cleaning.clean_categories(df, ["c", "absent"]), "c") == ["SHOES", None, None, None, None]


def test_aggregate_drops_unknown_keys_and_sums_nulls_to_zero(spark):
    rows = [
        ("P", "2023-01-15", 2.0, 10.0),
        ("P", "2023-01-31 10:00:00", 3.0, 20.0),
        ("P", "2023-02-01", None, None),
        ("P", "soon", 9.0, 9.0),
        (None, "2023-01-01", 9.0, 9.0),
    ]
    df = spark.createDataFrame(rows, "product_id string, MONAT string, MENGE double, PREIS double")
    got = cleaning.aggregate_sales(df, ["product_id"]).orderBy("MONAT").collect()
    assert [tuple(r) for r in got] == [
        ("P", date(2023, 1, 1), 5.0, 15.0),
        ("P", date(2023, 2, 1), 0.0, None),
    ]


def test_aggregate_takes_further_date_formats(spark):
    df = spark.createDataFrame([("P", "03.02.2023", 1.0, 1.0)], "product_id string, MONAT string, MENGE double, PREIS double")
    got = cleaning.aggregate_sales(df, ["product_id"], date_formats=("dd.MM.yyyy",)).collect()
    assert got[0].MONAT == date(2023, 2, 1)


def test_quantiles_equal_numpy(spark):
    # A third of the rows share one value; the rest spreads widely.
    df = spark.range(150_001).select(
        F.when(F.col("id") % 3 == 0, 17.5).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("v"),
        (F.col("id") % 2).alias("k"),
    )
    probs = (0.25, 0.5, 0.75)
    data = df.toPandas()
    got = outliers.exact_quantiles(df, "v", probs).first()
    assert np.allclose(list(got), np.quantile(data.v, probs), rtol=1e-12)
    for row in outliers.exact_quantiles(df, "v", probs, ["k"]).collect():
        assert np.allclose(list(row)[1:], np.quantile(data.v[data.k == row.k], probs), rtol=1e-12)


def test_quantiles_of_short_columns(spark):
    """Ranks that fall beside the sketch's bracket."""
    dice = np.random.default_rng(3)
    data = [(n, float(v)) for n in range(1, 41) for v in dice.integers(0, 15, n)]
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    for row in outliers.exact_quantiles(spark.createDataFrame(data, "k int, v double"), "v", probs, ["k"]).collect():
        assert np.allclose(list(row)[1:], np.quantile([v for k, v in data if k == row.k], probs), rtol=1e-12)


def test_outlier_filters(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "v double")
    assert sorted(values(outliers.filter_outliers(df, "v"), "v")) == [1, 2, 3, 4]
    assert sorted(values(outliers.filter_outliers(df, "v", "zscore", 1.0), "v")) == [1, 2, 3, 4]
    constant = spark.createDataFrame([(5.0,)] * 4, "v double")
    assert outliers.filter_outliers(constant, "v", "zscore", 3).count() == 0
    assert outliers.filter_outliers(constant, "v").count() == 4
    with pytest.raises(ValueError):
        outliers.filter_outliers(df, "v", "median")


def test_signed_percent_matches_python(spark):
    numbers = [6.25, -6.25, 12.345, 0.0, -0.01, 56.25, 33.333333, -100.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = values(df.orderBy("i").select(scalars.signed_percent("x").alias("t")), "t")
    assert got == [f"{x:+.1f}%" for x in numbers]
