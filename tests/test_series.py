"""Gap fill, year-over-year change, decomposition and forecasts against numpy."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import month
from monthcast.catalogue import QUERIES, reports
from monthcast.operators import decomposition as D
from monthcast.operators import trend as M
from monthcast.operators.routing import routed_forecast
from monthcast.operators.series import fill_month_gaps, year_over_year, year_over_year_text
from monthcast.operators.spectrum import dominant_period
from monthcast.operators.cleaning import collapse_months
from monthcast.plans.forecasts import forecast_all

HORIZON = 6
LENGTHS = [1, 2, 3, 4, 5, 6, 7, 11, 12, 13, 23, 24, 25, 40]


@pytest.fixture(scope="module")
def examples():
    rng = np.random.default_rng(3)
    series = {f"L{n:02d}": rng.integers(0, 60, n).astype(float) for n in LENGTHS}
    series["ZERO"] = np.zeros(30)
    series["FLAT"] = np.full(26, 7.0)
    series["LINE"] = np.arange(30.0)
    series["WAVE"] = 50 + 20 * np.sin(np.arange(36) * 2 * np.pi / 12)
    return series


@pytest.fixture(scope="module")
def filled(monthly, examples):
    return fill_month_gaps(monthly(examples)).cache()


def by_step(df, column):
    out = {}
    for r in df.collect():
        out.setdefault(r.product_id, {})[r.step] = r[column]
    return {p: [v[i] for i in range(HORIZON)] for p, v in out.items()}


def test_gap_fill_edges(spark):
    rows = [
        ("GAP", date(2019, 11, 1), 1.0), ("GAP", date(2020, 2, 1), 4.0),
        ("LEAD", date(2020, 1, 1), None), ("LEAD", date(2020, 3, 1), 5.0), ("LEAD", date(2020, 4, 1), None),
        ("NONE", date(2020, 1, 1), None), ("NONE", date(2020, 2, 1), None),
        ("ONE", date(2020, 1, 17), 3.0),
        ("MID", date(2020, 1, 15), 9.0), ("MID", date(2020, 2, 1), 2.0), ("MID", date(2020, 4, 20), 8.0),
        ("OFF", date(2020, 1, 10), 6.0), ("OFF", date(2020, 3, 10), 6.0),
        ("SAME", date(2020, 1, 10), 6.0), ("SAME", date(2020, 1, 20), 6.0),
    ]
    df = fill_month_gaps(spark.createDataFrame(rows, "product_id string, MONAT date, anz_produkt double"))
    got = {}
    for r in df.orderBy("product_id", "MONAT").collect():
        got.setdefault(r.product_id, []).append((r.MONAT.isoformat(), r.anz_produkt, r.t, r.n))
    assert got == {
        "GAP": [("2019-11-01", 1, 0, 4), ("2019-12-01", 1, 1, 4), ("2020-01-01", 1, 2, 4), ("2020-02-01", 4, 3, 4)],
        "LEAD": [("2020-01-01", 5, 0, 4), ("2020-02-01", 5, 1, 4), ("2020-03-01", 5, 2, 4), ("2020-04-01", 5, 3, 4)],
        "NONE": [("2020-01-01", 0, 0, 2), ("2020-02-01", 0, 1, 2)],
        "ONE": [("2020-01-17", 3, 0, 1)],
        "MID": [("2020-02-01", 2, 0, 3), ("2020-03-01", 2, 1, 3), ("2020-04-01", 2, 2, 3)],
        "OFF": [("2020-02-01", 0, 0, 2), ("2020-03-01", 0, 1, 2)],
    }


def test_year_over_year(spark, monthly):
    compared = year_over_year(fill_month_gaps(monthly({"P": [1600, 0] + [1] * 10 + [1700, 5]})))
    text = {r.MONAT: r for r in year_over_year_text(compared).collect()}
    first, second, early = text[month(12)], text[month(13)], text[month(3)]
    assert (first.date, first.sales, first.last_year, first.sales_change) == (
        "January 2021", "1,700 units", "1,600 units", f"{100 / 16:+.1f}%",
    )
    assert second.sales_change == "+0.0%"
    assert not early.has_comparison and early.sales_change is None


def test_dominant_period_equals_a_plain_transform(filled, examples):
    got = {r.product_id: r.k for r in dominant_period(filled).collect()}
    for p, x in examples.items():
        if len(x) < 24:
            assert p not in got
        elif p in ("FLAT", "ZERO"):
            assert got[p] == 1
        else:
            assert got[p] == np.argmax(np.abs(np.fft.fft(x)[1 : len(x) // 2])) + 1
    assert got["WAVE"] == 3


def smoothed_rise(x, steps):
    n = len(x)
    level = x[0] * 0.7 ** (n - 1) + sum(0.3 * 0.7 ** (n - 1 - i) * x[i] for i in range(1, n))
    return level + (level - x[0]) / n * (steps + 1)


def statistical(x):
    """The forecast restated from its definition, on one array."""
    n, i = len(x), np.arange(HORIZON)
    if n < 3:
        return np.zeros(HORIZON)
    slope, intercept = np.polyfit(np.arange(n), x, 1)
    m = min(6, n // 2)
    trend = 0.4 * (slope * (n + i + 1) + intercept) + 0.3 * smoothed_rise(x, i) + 0.3 * x[-max(m, 1) :].mean()
    season = np.zeros(HORIZON)
    if n >= 12:
        index = np.array([x[p::12].mean() / x.mean() if x.mean() > 0 else 1 for p in range(12)])
        season = (index[(n + i) % 12] - 1) * x.mean() * 0.3
        if n >= 24:
            base = x[:-12]
            rise = (x[12:][base > 0] - base[base > 0]) / base[base > 0]
            k = np.argmax(np.abs(np.fft.fft(x)[1 : n // 2])) + 1
            season = season + (rise.mean() if rise.size else 0) * x.mean() * 0.2
            season = season + 0.5 * 0.1 * np.sin(2 * np.pi * i * k / n) * x.mean()
    push = 0.0
    if n >= 12:
        a, b, c = x[-3:].mean(), x[-6:-3].mean(), x[-9:-6].mean()
        push = (a - 2 * b + c) * (i + 1) * 0.1 * np.exp(-0.1 * i)
    return np.maximum(0, trend + season + push)


def test_statistical_forecast(filled, examples):
    got = by_step(M.statistical_forecast(filled), "forecast")
    # A flat series has no strongest frequency beyond float noise.
    for p, x in examples.items():
        if p not in ("ZERO", "FLAT"):
            assert np.allclose(got[p], statistical(x), atol=1e-8), p
    assert got["ZERO"] == [0.0] * HORIZON
    assert np.allclose(got["FLAT"], 7.0, atol=0.4)


def split(x, start=0):
    s = pd.Series(x)
    width = min(12, len(x) // 2)
    trend = s.rolling(width, center=True).mean().bfill().ffill() if width > 1 else s
    months = (np.arange(len(x)) + start) % 12
    season = (s - trend).groupby(months).transform("mean") if len(x) >= 12 else s * 0
    return trend.to_numpy(), season.to_numpy(), (s - trend - season).to_numpy()


def decomposed(x):
    n, i = len(x), np.arange(HORIZON)
    if n < 6:
        return np.zeros(HORIZON)
    trend, season, rest = split(x)
    slope, intercept = np.polyfit(np.arange(6), trend[-6:], 1)
    total = slope * (6 + i + 1) + intercept
    if n >= 12:
        total = total + np.array([season[(np.arange(n) % 12) == (n - 1 + s) % 12].mean() for s in i])
    with np.errstate(all="ignore"):
        phi = np.corrcoef(rest[-6:-1], rest[-5:])[0, 1]
    phi = 0.8 if np.isnan(phi) else float(np.clip(phi, -0.8, 0.8))
    total = np.maximum(0, total + rest[-1] * phi ** (i + 1))
    total = np.clip(total, max(0, 0.1 * x.min()), 2 * x.max())
    mean, sd = x.mean(), x.std()
    high, low = total > mean + 2 * sd, total < mean - 2 * sd
    return np.where(high, mean + 1.5 * sd, np.where(low, max(0, mean - 1.5 * sd), total))


def test_decomposition(filled, examples):
    parts = {}
    for r in D.decompose(filled).orderBy("product_id", "t").collect():
        parts.setdefault(r.product_id, []).append((r.trend, r.seasonal, r.residual))
    for p, x in examples.items():
        assert np.allclose(np.array(parts[p]).T, np.array(split(x)), atol=1e-9), p


def test_decomposition_forecast(filled, examples):
    got = by_step(D.decomposition_forecast(filled), "forecast")
    for p, x in examples.items():
        if p != "LINE":  # its residual is constant up to float noise
            assert np.allclose(got[p], decomposed(x), atol=1e-7), p


def test_constant_residuals_keep_four_fifths(spark):
    rows = [("P", month(i), 5.0, i, 6, 5.0, 0.0, 2.0) for i in range(6)]
    parts = spark.createDataFrame(
        rows,
        "product_id string, MONAT date, anz_produkt double, t int, n int, trend double, seasonal double, residual double",
    )
    assert D.decomposition_statistics(parts).first()["coefficient"] == 0.8


def test_routing_and_calendar(filled, examples):
    listed = ("L25", "WAVE")
    got = routed_forecast(filled, HORIZON, listed)
    values = by_step(got, "forecast")
    assert np.allclose(values["L25"], decomposed(examples["L25"]), atol=1e-7)
    assert np.allclose(values["L24"], statistical(examples["L24"]), atol=1e-8)
    methods = {r.product_id: r.method for r in got.select("product_id", "method").distinct().collect()}
    assert methods["WAVE"] == "decomposition" and methods["L01"] == "statistical"
    first = got.where((F.col("product_id") == "L13") & (F.col("step") == 0)).first()
    assert first.MONAT == month(13)


def test_noise_is_seeded_and_independent_of_partitions(filled):
    one = by_step(M.statistical_forecast(filled, noise_seed=1), "forecast")
    again = by_step(M.statistical_forecast(filled.repartition(7, "t"), noise_seed=1), "forecast")
    other = by_step(M.statistical_forecast(filled, noise_seed=2), "forecast")
    assert np.allclose(one["L40"], again["L40"])
    assert not np.allclose(one["L40"], other["L40"])


def test_noise_is_standard_normal(spark):
    draws = spark.range(20_000).select(
        F.col("id").cast("string").alias("product_id"), F.lit(0).alias("step")
    ).select(M.seeded_noise(5).alias("z")).toPandas().z
    assert abs(draws.mean()) < 0.03 and abs(draws.std() - 1) < 0.03


def test_forecast_collapses_duplicate_months(spark, monthly):
    fact = monthly({"P": [1, 2, 3, 4, 5, 6, 7]})
    doubled = fact.unionByName(fact)
    got = by_step(forecast_all(collapse_months(doubled)), "forecast")
    assert np.allclose(got["P"], statistical(2 * np.arange(1.0, 8.0)))


def test_forecast_reads_the_lines_once(spark, monthly, tmp_path):
    path = str(tmp_path / "fact")
    monthly({"P": range(30)}).write.parquet(path)
    plan = M.statistical_forecast(fill_month_gaps(spark.read.parquet(path)))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_tasks_of_a_long_table_stay_small(spark, monthly, monkeypatch):
    """More rows are dealt over more tasks, and a decomposition sorts them by product and date only."""
    rows = monthly({f"P{i}": [float(i + j) for j in range(15)] for i in range(40)})
    want = {(r.product_id, r.MONAT): r for r in D.decompose(fill_month_gaps(rows)).collect()}
    monkeypatch.setattr("monthcast.session.ROWS_A_TASK", 20)
    filled = fill_month_gaps(rows)
    assert filled.rdd.getNumPartitions() == 30 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = D.decompose(filled)
    assert {(r.product_id, r.MONAT): r for r in got.collect()} == want and len(want) == 600
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "month(" in plan and "Window" in plan
    assert not [line for line in plan.splitlines() if "windowspecdefinition(product_id" in line and "_w" in line.split("windowspecdefinition(")[1].split("specifiedwindowframe")[0]]


def test_export_reads_the_lines_once(spark, monthly, monkeypatch, tmp_path):
    """History and forecast of a report come from one written table; the lines behind it are read and summed once."""
    path = str(tmp_path / "fact")
    monthly({"P": range(30), "Q": range(5)}).write.parquet(path)
    names = spark.createDataFrame([("P", "name")], "NUMMER string, BANAME1 string")
    monkeypatch.setattr(reports, "monthly", lambda spark, sf: spark.read.parquet(path))
    monkeypatch.setattr(reports, "filled", lambda spark, sf: fill_month_gaps(spark.read.parquet(path)), raising=False)
    monkeypatch.setattr(reports, "descriptions", lambda spark, sf: names)
    made = [name for name in ("a5_forecast_summary", "a6_history_and_forecast", "a6_export_rows") if path in str(QUERIES[name](spark, "").inputFiles())]
    assert made == []
    rows = QUERIES["a6_export_rows"](spark, "").collect()
    assert len(rows) == 35 + 12 and {r.Product_Name for r in rows if r.Product_ID == "P"} == {"name"}
