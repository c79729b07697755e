"""Folds, errors, weights, bands and the fitted hierarchy."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.ml import PipelineModel, regression
from pyspark.sql import functions as F

from monthcast import settings as S
from monthcast.catalogue import ensembles
from monthcast.operators import ensemble as E
from monthcast.operators import features as T
from monthcast.operators import folds, forest
from monthcast.operators import members as B
from monthcast.operators.folds import fold_columns, fold_ranges, level_rows, time_rank, with_folds, with_level_keys
from monthcast.operators.calendar_member import CalendarMeans
from monthcast.plans import training
from monthcast.plans.training import HierarchicalModel, fit_hierarchy
from monthcast.sources.models import changed_nodes, load_models, save_models, tree_nodes

TREES = B.TreeParameters(
    boosted_a={"maxIter": 2, "maxDepth": 3, "seed": 1},
    boosted_b={"maxIter": 2, "maxDepth": 2, "seed": 1},
    forest={"numTrees": 3, "maxDepth": 3, "seed": 1},
)


def test_ranks_equal_a_global_sort(monthly):
    fact = monthly({f"P{i}": range(i % 9 + 1) for i in range(40)})
    got = time_rank(with_level_keys(fact)).collect()
    for level, key in {(r.level, r.key) for r in got}:
        group = [r for r in got if (r.level, r.key) == (level, key)]
        order = sorted(group, key=lambda r: (r.MONAT, hashlib.md5(r.product_id.encode()).hexdigest()))
        assert [r.r for r in order] == list(range(len(group)))
        assert {r.n for r in group} == {len(group)}


@pytest.mark.parametrize("n, expected", [(3, None), (4, [0, 1, 2, 3]), (6, [0, 0, 0, 1, 2, 3]),
                                         (7, [0, 0, 0, 0, 1, 2, 3]),
                                         (13, [0] * 4 + [1] * 3 + [2] * 3 + [3] * 3)])
def test_fold_layout(monthly, n, expected):
    folded = with_folds(monthly({"P": range(n)}), ("product",), min_rows=1)
    got = [r.fold for r in folded.orderBy("MONAT").collect()]
    assert got == (expected or [])


def test_fold_ranges(monthly):
    folded = with_folds(monthly({"P": range(13)}), ("product",))
    got = [(r.fold, r.train_rows, r.test_rows) for r in fold_ranges(folded).orderBy("fold").collect()]
    assert got == [(1, 4, 3), (2, 7, 3), (3, 10, 3)]


def test_short_keys_have_no_model(monthly):
    folded = with_folds(monthly({"P": range(5), "Q": range(8)}))
    assert {(r.level, r.key) for r in folded.select("level", "key").distinct().collect()} == {
        ("global", "all"), ("category", "C1"), ("product", "Q"),
    }


def test_fold_columns_are_the_folds_of_every_level(spark):
    rng = np.random.default_rng(4)
    facts = [(f"P{i}" if i else None, f"C{i % 3}" if i % 5 else None, m, float(rng.integers(9))) for i in range(30) for m in range(i % 11 + 1)]
    df = spark.createDataFrame([(*r, r[3] * 2) for r in facts], "product_id string, product_category_id string, m int, y double, x double")
    rows = df.selectExpr("product_id", "product_category_id", "add_months(DATE'2020-01-01', m) AS MONAT", "y", "x")
    names = ["level", "key", "product_id", "MONAT", "fold", "y"]
    table = fold_columns(rows)
    got = level_rows(table).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, with_folds(rows).select(names).collect()))
    assert len(got) > 200


def test_folds_of_repeated_rows_keep_their_sizes(monthly):
    one = monthly({f"P{i}": range(12) for i in range(4)})
    rows = one.union(one).union(one)
    sizes = lambda df: sorted(map(tuple, df.groupBy("level", "key", "fold").count().collect()))
    assert sizes(level_rows(fold_columns(rows))) == sizes(with_folds(rows))


def test_products_are_fitted_and_met_where_their_rows_lie(monthly):
    rows = monthly({f"P{i}": range(12) for i in range(9)}).withColumn("y", F.col("anz_produkt"))
    table = fold_columns(rows)
    models = B.fold_models(table, lambda r: B.linear_models(r, ["unit_preis"]), ["product"])
    plans = []
    for df in (B.linear_models(level_rows(table, ["product"]), ["unit_preis"]), B.with_fold_models(table, models).select("y", "_product")):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert not any("Exchange hashpartitioning" in plan for plan in plans)


def weights_of(spark, maes):
    rows = [("product", "P", m, e) for m, e in maes.items()]
    df = E.inverse_error_weights(spark.createDataFrame(rows, "level string, key string, member string, mae double"))
    return {r.member: r.weight for r in df.collect()}


def test_weights(spark):
    assert weights_of(spark, {"a": 1.0, "b": 3.0}) == pytest.approx({"a": 0.75, "b": 0.25})
    assert weights_of(spark, {"a": 0.0, "b": 2.0, "c": None}) == {"a": 0.0, "b": 1.0, "c": 0.0}
    assert weights_of(spark, {"a": 0.0}) == {"a": 0.0}


def test_bands(spark):
    rows = [
        (1, 10.0, 20.0, 0.75, 0.25),
        (2, 5.0, 5.0, 0.5, 0.5),
        (3, 1.0, 9.0, 1.0, 0.0),
        (4, 1.0, 9.0, 0.0, 0.0),
        (5, -8.0, -2.0, 0.5, 0.5),
    ]
    df = spark.createDataFrame(rows, "id int, a double, b double, w_a double, w_b double")
    got = {r.id: (r.predicted_sales, r.lower_bound, r.upper_bound) for r in E.ensemble_band(df, ["a", "b"]).collect()}
    assert got[1] == pytest.approx((12.5, 12.5 - 1.96 * 5, 12.5 + 1.96 * 5))
    assert got[2] == pytest.approx((5, 5, 5))
    assert got[3] == pytest.approx((1, 0, 1 + 1.96 * 4))
    assert got[4] == (None, None, None)
    assert got[5] == pytest.approx((0, 0, -5 + 1.96 * 3))


def test_linear_models_equal_least_squares_on_the_rows(spark):
    rng = np.random.default_rng(0)
    rows = []
    for p, n in {"LONG": 40, "SHORT": 5, "FLAT": 9}.items():
        x = rng.normal(100, 5, (n, 3)) * (0 if p == "FLAT" else 1) + 3
        y = x @ [2.0, -1.0, 0.5] + rng.normal(0, 1, n)
        rows += [("product", p, 0, *map(float, x[i]), float(y[i])) for i in range(n)]
    schema = "level string, key string, fold int, a double, b double, c double, y double"
    df = spark.createDataFrame(rows, schema)
    models = {r.key: r.coefficients for r in B.linear_models(df, ["a", "b", "c"]).collect()}
    data = df.toPandas()
    for p, part in data.groupby("key"):
        x, y = part[["a", "b", "c"]].to_numpy(), part.y.to_numpy()
        centred = x - x.mean(axis=0)
        beta = np.linalg.lstsq(centred, y - y.mean(), rcond=None)[0]
        fitted = centred @ beta + y.mean()
        ours = models[p][0] + x @ np.array(models[p][1:])
        assert np.allclose(ours, fitted, atol=1e-5), p


def test_linear_models_in_batches_are_those_of_one_aggregation(monthly, monkeypatch):
    rng = np.random.default_rng(6)
    rows = monthly({f"P{i}": rng.integers(5, 50, 8 + i % 17).tolist() for i in range(40)}, category="C")
    names = ["a", "b", "c"]
    rows = rows.withColumn("y", F.when(F.col("anz_produkt") != 7, F.col("anz_produkt"))).selectExpr(
        "*", "anz_produkt * 0.5 + month(MONAT) AS a", "hash(product_id, MONAT) % 7 * 1.0 AS b", "3.0 AS c"
    )
    table = fold_columns(rows)
    monkeypatch.setattr(B, "ROWS_MULTIPLIED", 5, raising=False)
    monkeypatch.setattr(B, "SUMS_HELD", 1, raising=False)
    models = B.linear_fold_models(table, names)
    for level in ("product", "category", "global"):
        want = {(r.key, r.fold): r.coefficients for r in B.linear_models(level_rows(table, [level]), names).collect()}
        got = {(r.key, f): m.coefficients for r in models[level].collect() for f, m in r.models.items()}
        assert got.keys() == want.keys() and len(got) >= 4
        assert all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-6) for k in want), level


def test_scored_rows_are_written_once_for_the_fits(monthly, monkeypatch):
    """Fits and errors read one written table, and no row of it is joined with models again."""
    read = []
    keep = training.fit_member
    monkeypatch.setattr(training, "fit_member", lambda rows, *rest: (read.append(rows), keep(rows, *rest))[1])
    rng = np.random.default_rng(8)
    rows = T.complete_rows(T.create_features(monthly({f"P{i}": rng.integers(5, 50, 24).tolist() for i in range(5)})))
    fit_hierarchy(rows, estimators={"linear_all": B.global_linear()})
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in read]
    assert len(plans) == 4 and not any("Join" in plan or "Subquery" in plan for plan in plans)


def test_features_are_safe_from_their_own_month(monthly):
    base = [5, 9, 2, 8, 4, 7, 1, 6, 3, 9, 2, 5, 8, 4, 6]
    one = T.create_features(monthly({"P": base})).orderBy("MONAT").collect()
    two = T.create_features(monthly({"P": [*base[:-1], 999]})).orderBy("MONAT").collect()
    own = [f for f in S.MODEL_FEATURES if f not in ("unit_preis", "month", "category_seasonal_index")]
    assert [one[-1][f] for f in own] == [two[-1][f] for f in own]


def test_missing_feature_is_an_error(monthly):
    with pytest.raises(ValueError, match="trend_6"):
        T.check_columns(monthly({"P": [1]}), ["anz_produkt", "trend_6"])
    features = T.create_features(monthly({"P": range(12)}))
    with pytest.raises(ValueError, match="insufficient"):
        T.complete_rows(features, min_rows=10)


def test_hierarchy(monthly):
    rng = np.random.default_rng(1)
    fact = monthly({f"P{i}": (rng.integers(5, 50, 24 if i < 5 else 10)).tolist() for i in range(6)})
    rows = T.complete_rows(T.create_features(fact))
    model = fit_hierarchy(rows, estimators=B.tree_estimators(TREES))
    assert model.counts() == {"product_models": 5, "category_models": 1, "global_model": 1}
    sums = model.weights.groupBy("level", "key").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)
    predicted = model.predict(rows)
    assert predicted.count() == rows.count()
    levels = {r.product_id: r.model_level for r in predicted.select("product_id", "model_level").distinct().collect()}
    assert levels["P0"] == "product" and levels["P5"] == "category"
    assert predicted.where("lower_bound > predicted_sales or predicted_sales > upper_bound").count() == 0
    shares = model.importance().groupBy("level", "key").agg(F.sum("importance").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in shares)
    with pytest.raises(ValueError):
        model.predict(rows.drop("trend_6"))


def test_vectors_are_written_once_and_dealt_out(monthly):
    features = ["a", "b"]
    rows = monthly({"P": range(30)}).selectExpr("product_id", "MONAT", "anz_produkt AS y", "anz_produkt AS a", "-anz_produkt AS b")
    ready = B.assembled(rows.coalesce(1), features)
    assert ready.columns == ["product_id", "MONAT", "y", B.VECTOR]
    assert ready.inputFiles() and {tuple(r[B.VECTOR]) for r in ready.collect()} == {(float(i), -float(i)) for i in range(30)}
    spread = B.assembled(monthly({f"P{i}": range(9) for i in range(50)}).selectExpr("product_id", "MONAT", "anz_produkt AS a").coalesce(1), ["a"])
    assert spread.count() == 450 and len(spread.inputFiles()) > 4


def test_assembled_and_plain_rows_give_the_same_member(monthly):
    rows = monthly({"P": [3, 1, 4, 1, 5, 9, 2, 6]}).selectExpr("product_id", "MONAT", "anz_produkt AS y", "month(MONAT) * 1.0 AS a")
    ready = B.assembled(rows, ["a"])
    one, two = (B.fit_member(t, B.global_linear(), ["a"], "m") for t in (rows, ready))
    want = [r.m for r in B.predict_member(one, rows, "m").orderBy("MONAT").collect()]
    assert [r.m for r in B.predict_member(two, ready, "m").orderBy("MONAT").collect()] == pytest.approx(want)
    assert B.predict_member(two, rows, "m").columns == [*rows.columns, "m"]


def test_tuned_share_and_checkpoints():
    made = B.tree_estimators()
    assert made["boosted_a"].getFeatureSubsetStrategy() == "0.9578410352643851"
    assert made["boosted_b"].getFeatureSubsetStrategy() == "0.9945381025198837"
    assert all(e.getCheckpointInterval() > 0 and e.getCacheNodeIds() for e in made.values())


def test_boosting_over_several_checkpoints(spark, monthly):
    rng = np.random.default_rng(3)
    rows = monthly({f"P{i}": rng.integers(1, 60, 20).tolist() for i in range(4)})
    rows = rows.selectExpr("product_id", "MONAT", "anz_produkt AS y", "month(MONAT) * 1.0 AS a", "anz_produkt * 0.5 AS b")
    ready = B.assembled(rows, ["a", "b"])
    sizes = B.TreeParameters(boosted_a={"maxIter": 25, "maxDepth": 3, "stepSize": 0.2, "featureSubsetStrategy": "0.9", "seed": 1})
    model = B.fit_member(ready, B.tree_estimators(sizes)["boosted_a"], ["a", "b"], "m")
    assert spark.sparkContext.getCheckpointDir()
    error = B.predict_member(model, ready, "m").agg(F.avg(F.abs(F.col("m") - F.col("y")))).first()[0]
    plain = ready.agg(F.mean(F.abs(F.col("y") - ready.agg(F.avg("y").alias("m")).scalar()))).first()[0]
    assert model.stages[-1].getNumTrees == 25 and error < plain / 2


@pytest.fixture
def stored_trees(spark, monthly, tmp_path):
    rng = np.random.default_rng(5)
    rows = monthly({f"P{i}": rng.integers(1, 60, 20).tolist() for i in range(4)})
    ready = B.assembled(rows.selectExpr("product_id", "MONAT", "anz_produkt AS y", "month(MONAT) * 1.0 AS a"), ["a"])
    made = B.tree_estimators(TREES)
    members = {n: B.fit_member(ready, made[n], ["a"], n) for n in ("forest", "boosted_a")}
    path = f"{tmp_path}/first"
    save_models(spark, path, members, {}, ["a"])
    return members, path


def test_stored_trees_node_by_node(spark, stored_trees, tmp_path):
    members, path = stored_trees
    loaded, _, _ = load_models(spark, path)
    save_models(spark, f"{tmp_path}/second", loaded, {}, ["a"])
    first, second = (tree_nodes(spark, p, list(members)) for p in (path, f"{tmp_path}/second"))
    got = {r.member: r for r in changed_nodes(first, second).collect()}
    assert {m: (r.trees, r.changed) for m, r in got.items()} == {"forest": (3, 0), "boosted_a": (2, 0)}
    for name, model in members.items():
        assert got[name].nodes == model.stages[-1].totalNumNodes
    leaves = first.where("left < 0")
    assert leaves.where("feature IS NOT NULL OR threshold IS NOT NULL").isEmpty()
    assert first.where("left >= 0 AND (feature IS NULL OR threshold IS NULL)").isEmpty()
    assert {r.weight for r in first.where("member = 'forest'").collect()} == {1.0}


def test_a_changed_added_or_missing_node_is_found(spark, stored_trees):
    members, path = stored_trees
    nodes = tree_nodes(spark, path, ["forest"])
    moved = nodes.withColumn("threshold", F.when(F.col("tree") == 0, F.col("threshold") + 1).otherwise(F.col("threshold")))
    splits = nodes.where("tree = 0 AND left >= 0").count()
    assert splits > 0 and changed_nodes(nodes, moved).first().changed == splits
    assert changed_nodes(nodes, nodes.where("node <> 0")).first().changed == 3
    assert changed_nodes(nodes.where("tree < 2"), nodes).first().changed == nodes.where("tree = 2").count()


def test_own_member_is_weighed_stored_and_loaded(spark, monthly, tmp_path):
    rng = np.random.default_rng(2)
    rows = T.complete_rows(T.create_features(monthly({f"P{i}": rng.integers(5, 50, 24).tolist() for i in range(5)})))
    model = fit_hierarchy(rows, estimators={"calendar": CalendarMeans(), "linear_all": B.global_linear()})
    assert model.weights.where("member = 'calendar'").count() == 7
    path = f"{tmp_path}/models"
    save_models(spark, path, model.members, {"models": model.models, "weights": model.weights}, model.features)
    members, tables, features = load_models(spark, path)
    loaded = HierarchicalModel(members, tables["models"], tables["weights"], features)
    order = ["product_id", "MONAT"]
    assert loaded.predict(rows).orderBy(*order).collect() == model.predict(rows).orderBy(*order).collect()
    data = rows.toPandas()
    means = data.groupby(data.MONAT.map(lambda d: d.month)).anz_produkt.mean()
    got = B.predict_member(members["calendar"], rows, "calendar").collect()
    assert all(r.calendar == pytest.approx(means[r.MONAT.month]) for r in got)
    shares = loaded.importance().groupBy("level", "key").agg(F.sum("importance").alias("s")).collect()
    assert all(r.s == pytest.approx(1) or r.s == 0 for r in shares)


def test_calendar_means_without_a_month_date_or_rows(spark):
    schema = "MONAT date, y double"
    train = spark.createDataFrame([("2024-01-01", 2.0), ("2024-01-01", 4.0), ("2024-03-01", 9.0), (None, 1.0), ("2024-03-01", None)], "d string, y double")
    train = train.selectExpr("CAST(d AS DATE) AS MONAT", "y")
    model = CalendarMeans()._set(labelCol="y").fit(train)
    asked = spark.createDataFrame([("2025-01-05",), ("2025-03-01",), ("2025-02-01",), (None,)], "d string").selectExpr("CAST(d AS DATE) AS MONAT")
    assert [r.prediction for r in model.transform(asked).collect()] == [3.0, 9.0, 4.0, 4.0]
    with pytest.raises(ValueError, match="no rows"):
        CalendarMeans()._set(labelCol="y").fit(spark.createDataFrame([], schema))


def test_forest_fitted_a_few_trees_at_a_time(spark, monthly, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    rows = monthly({f"P{i}": rng.integers(1, 60, 20).tolist() for i in range(4)})
    ready = B.assembled(rows.selectExpr("product_id", "MONAT", "anz_produkt AS y", "month(MONAT) * 1.0 AS a"), ["a"])
    at_once, fit = [], B.RandomForestRegressor._fit
    monkeypatch.setattr(B, "TREES_A_FIT", 2, raising=False)
    monkeypatch.setattr(B.RandomForestRegressor, "_fit", lambda self, train: at_once.append(self.getNumTrees()) or fit(self, train))
    sizes = B.TreeParameters(forest={"numTrees": 5, "maxDepth": 3, "seed": 1})
    model = B.fit_member(ready, B.tree_estimators(sizes)["forest"], ["a"], "m")
    forest = model.stages[-1]
    assert sum(at_once) == 5 and max(at_once) <= 2
    assert len(forest.trees) == forest.getNumTrees == forest.getOrDefault("numTrees") == 5
    assert len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) > 2  # the fits draw differently
    path = f"{tmp_path}/stored"
    save_models(spark, path, {"forest": model}, {}, ["a"])
    loaded = load_models(spark, path)[0]["forest"]
    read = [B.predict_member(m, ready, "m").orderBy("product_id", "MONAT").toPandas()["m"].tolist() for m in (model, loaded)]
    vector = ready.orderBy("product_id", "MONAT").first()[B.VECTOR]
    assert read[0] == read[1] and np.isclose(read[0][0], np.mean([t.predict(vector) for t in forest.trees]))
    assert tree_nodes(spark, path, ["forest"]).select("tree").distinct().count() == 5


@pytest.fixture
def wavy(monthly):
    """Rows of more values than there are thresholds, in two columns that matter and one that does not."""
    rng = np.random.default_rng(11)
    rows = monthly({f"P{i}": (40 + 20 * np.sin(np.arange(20) + i) + rng.normal(0, 3, 20)).tolist() for i in range(30)})
    rows = rows.selectExpr("product_id", "MONAT", "anz_produkt AS y", "month(MONAT) * 1.0 AS a")
    return B.assembled(rows.selectExpr("*", "round(y * a, 2) + a AS b", "7.0 AS c"), ["a", "b", "c"])


def test_forest_from_blocks_is_that_of_spark_where_nothing_is_drawn(wavy, monkeypatch):
    drawn = {"numTrees": 1, "maxDepth": 6, "bootstrap": False, "featureSubsetStrategy": "all", "seed": 4, "minInstancesPerNode": 2}
    columns = {"featuresCol": B.VECTOR, "labelCol": "y"}
    want = regression.RandomForestRegressor(**drawn, **columns).fit(wavy)
    monkeypatch.setattr(regression.RandomForestRegressor, "_fit", lambda *_: pytest.fail("rows and trees are held together"))
    monkeypatch.setattr(forest, "BLOCK_ROWS", 7)
    monkeypatch.setattr(forest, "MOST_NODES", 3)
    got = B.RandomForestRegressor(**drawn, **columns).fit(wavy)
    shape = [t.toDebugString.split("\n", 1)[1] for m in (want, got) for t in m.trees]
    numbers = [[float(x) for x in re.findall(r"-?\d+\.\d+", text)] for text in shape]
    assert re.sub(r"-?\d+\.\d+", "#", shape[0]) == re.sub(r"-?\d+\.\d+", "#", shape[1])
    assert numbers[0] == pytest.approx(numbers[1]) and want.totalNumNodes > 20
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray())


def test_forest_predicts_in_batches_what_its_transform_gives(wavy, monkeypatch, tmp_path):
    model = B.fit_member(wavy, B.tree_estimators(B.TreeParameters(forest={"numTrees": 7, "maxDepth": 5, "seed": 1}))["forest"], ["a", "b", "c"], "m")
    want = {(r.product_id, r.MONAT): r.m for r in model.stages[-1].transform(wavy).collect()}
    monkeypatch.setattr(type(model.stages[-1]), "transform", lambda *_: pytest.fail("each row walks down all trees"))
    monkeypatch.setattr(forest, "WALKED_ROWS", 5)
    model.write().overwrite().save(f"{tmp_path}/m")
    for m in (model, PipelineModel.load(f"{tmp_path}/m")):
        assert {(r.product_id, r.MONAT): r.m for r in B.predict_member(m, wavy, "m").collect()} == want
    assert len(set(want.values())) > 20


def test_forest_refuses_what_it_cannot_add_up(wavy):
    made = B.tree_estimators(B.TreeParameters(forest={"numTrees": 2, "maxDepth": 2, "seed": 1}))["forest"]
    for label in ("CAST(NULL AS DOUBLE)", "CAST('NaN' AS DOUBLE)"):
        with pytest.raises(Exception):
            B.fit_member(wavy.withColumn("y", F.expr(f"IF(a = 3, {label}, y)")), made, ["a", "b", "c"], "m")
    with pytest.raises(Exception):
        B.fit_member(wavy.where("a < 0"), made, ["a", "b", "c"], "m")


def test_weights_and_columns_are_drawn_as_stated(wavy):
    draws = forest.weights_by_draw(1.0, True)
    assert draws.mean() == pytest.approx(1, abs=1e-3) and draws.var() == pytest.approx(1, abs=5e-3)
    assert forest.weights_by_draw(0.25, False).mean() == 0.25 and forest.weights_by_draw(1.0, False).min() == 1
    shares = {"all": 13, "onethird": 5, "sqrt": 4, "log2": 4, "auto": 5, "6": 6, "0.5": 7}
    assert {s: B.RandomForestRegressor(numTrees=3, featureSubsetStrategy=s).columns_a_node(13) for s in shares} == shares


def test_predictions_write_their_rows_once(spark, monthly, monkeypatch):
    """No copy of the rows per level and key is written for the errors and lines behind a prediction."""
    fact = monthly({f"P{i}": [float(i + j % 7) for j in range(15)] for i in range(12)})
    monkeypatch.setattr(ensembles, "uncategorized_fact", lambda spark, sf: fact)
    written = []
    for module in (ensembles, folds):
        keep = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, *by, keep=keep: (written.append((name, df.count())), keep(df, name, *by))[1])
    rows = ensembles.predicted_rows(spark, "")
    assert rows.count() == 12 * 14
    assert written and not [(name, n) for name, n in written if n >= 12 * 14]
