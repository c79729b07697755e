"""Rolling-origin holdout against a forecast of each truncated table."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import month
from monthcast.plans import holdout as H
from monthcast.plans.forecasts import forecast_all


@pytest.fixture(scope="module")
def examples():
    rng = np.random.default_rng(5)
    series = {f"P{i}": [None if rng.random() < 0.2 else float(rng.integers(1, 60)) for _ in range(40)] for i in range(6)}
    series["LATE"] = [None] * 36 + [4.0, 5.0, 6.0, 7.0]
    series["GONE"] = [3.0, 8.0, 2.0, 9.0, 4.0, 1.0, 5.0]
    series["SAME"] = [7.0] * 40
    return series


@pytest.fixture(scope="module")
def table(monthly, examples):
    return monthly(examples)


@pytest.fixture(scope="module")
def predicted(table):
    return H.holdout_predictions(table, decomposed=("P1",)).cache()


def test_each_cutoff_is_a_forecast_of_the_table_so_far(table, predicted):
    """What a cut-off is told equals the forecast of the table cut there; nothing later enters."""
    got = {(r.age, r.product_id, r.MONAT): r for r in predicted.collect()}
    want = 0
    for age in (1, 2, 3):
        cutoff = month(39 - 6 * age)
        alone = forecast_all(table.where(F.col("MONAT") <= F.lit(cutoff)), decomposed=("P1",))
        expected = {(r.product_id, r.MONAT): r.forecast for r in alone.collect()}
        for r in table.where(F.col("anz_produkt").isNotNull()).collect():
            if cutoff < r.MONAT <= month(45 - 6 * age) and (r.product_id, r.MONAT) in expected:
                row = got[(age, r.product_id, r.MONAT)]
                assert row.y == r.anz_produkt and row.cutoff == cutoff
                assert row.forecast == pytest.approx(expected[(r.product_id, r.MONAT)], abs=1e-9)
                want += 1
    assert want == len(got) > 50


def test_simple_members(predicted, examples):
    """A year before in the filled series, else the mean of its last six months; and its last month."""
    for r in predicted.where("age = 1").collect():
        known = examples[r.product_id][: 40 - 6]
        first = next(i for i, v in enumerate(known) if v is not None)
        last = max(i for i, v in enumerate(known) if v is not None)
        filled = []
        for v in known[first : last + 1]:
            filled.append(filled[-1] if v is None else v)
        at = (r.MONAT.year - 2020) * 12 + r.MONAT.month - 1 - 12 - first
        assert r.naive == filled[-1]
        assert r.seasonal_naive == pytest.approx(filled[at] if 0 <= at < len(filled) else np.mean(filled[-6:]))


def test_weights_come_from_older_cutoffs(predicted):
    rows = predicted.collect()
    got = {(r.product_id, r.MONAT): r for r in H.with_holdout_ensemble(predicted).collect()}
    assert set(got) == {(r.product_id, r.MONAT) for r in rows if r.age == 1}

    def errors(product):
        old = [r for r in rows if r.age > 1 and product in (None, r.product_id)]
        ages = sorted({r.age for r in old})
        return [np.mean([np.mean([abs(r.y - r[m]) for r in old if r.age == a]) for a in ages]) for m in H.MEMBERS] if ages else None

    for (product, _), r in got.items():
        own = errors(product)
        mae = np.array(own or errors(None))
        inverse = np.array([1 / e if e > 0 else 0.0 for e in mae])
        weights = inverse / inverse.sum() if inverse.sum() else inverse
        assert r.weights_from == ("product" if own else "global")
        assert r.ensemble == pytest.approx(max(0.0, sum(w * r[m] for w, m in zip(weights, H.MEMBERS, strict=True))), abs=1e-9)


def test_no_history_and_no_rows(spark, monthly):
    assert H.holdout_predictions(monthly({"NEW": [1.0, 2.0]})).count() == 0
    empty = spark.createDataFrame([], "product_id string, MONAT date, anz_produkt double")
    assert H.holdout_errors(H.holdout_predictions(empty)).count() == 0
    one = spark.createDataFrame([(None, date(2020, 1, 1), 3.0)], empty.schema)
    assert H.holdout_predictions(one).count() == 0


def test_statistics_take_the_copies_where_they_lie(table, monkeypatch):
    """Copies of the histories are dealt by key once, one file a task, and the forecast and its rivals do not move them."""
    seen = []
    routed = H.routed_forecast
    monkeypatch.setattr(H, "routed_forecast", lambda filled, *rest: (seen.append(filled), routed(filled, *rest))[1])
    monkeypatch.setattr("monthcast.session.ROWS_A_TASK", 50)
    got = H.holdout_predictions(table, decomposed=("P1",))
    assert got.count() > 0
    plan = routed(seen[0], 6, [])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert len(seen[0].inputFiles()) <= -(-table.count() * 3 // 50 // 4) * 4
