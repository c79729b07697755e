"""Ensemble members: relational baselines, per-key linear models, Spark ML trees."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthcast.functions.skew import salted_lookup
from monthcast.operators.features import check_columns
from monthcast.operators.folds import FOLDS, LEVELS, level_rows
from monthcast.operators.forest import RandomForestRegressor, with_prediction
from monthcast.session import clustered, materialize, scratch_root

BASELINES = ("naive", "seasonal_naive", "rolling_mean", "linear")


def with_baselines(features: DataFrame) -> DataFrame:
    """Members read off the feature table: last month, last year, mean of three."""
    return features.withColumns(
        {
            "y": F.col("anz_produkt"),
            "naive": F.col("sales_lag_1"),
            "seasonal_naive": F.coalesce("sales_lag_12", "sales_rolling_mean_6"),
            "rolling_mean": F.col("sales_rolling_mean_3"),
        }
    )


def line_statistics(folded: DataFrame, x: str, y: str = "y") -> DataFrame:
    """Least-squares line per level, key and fold, fitted on all earlier folds.

    The sums of a fold are added up once; running totals over the at most four
    folds of a key give every training set. ``fold`` 4 is the fit on all rows.
    """
    sums = folded.groupBy("level", "key", "fold").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(F.col(x) * F.col(y)).alias("sxy"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"),
    )
    upto = Window.partitionBy("level", "key").orderBy("fold")
    names = ("n", "sx", "sy", "sxy", "sxx")
    totals = sums.select(
        "level", "key", (F.col("fold") + 1).alias("fold"), *[F.sum(c).over(upto).alias(c) for c in names]
    )
    n, sx, sy, sxy, sxx = (F.col(c) for c in names)
    slope = F.coalesce(F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx), F.lit(0.0))
    return totals.withColumn("slope", slope).select(
        "level", "key", "fold", "slope", ((sy - F.col("slope") * sx) / n).alias("intercept")
    )


def with_line_member(folded: DataFrame, x: str = "sales_lag_1", y: str = "y") -> DataFrame:
    """Add ``linear``: each fold predicted by the line fitted before it."""
    lines = line_statistics(folded, x, y).where(F.col("fold") <= FOLDS)
    return (
        _lookup_fold(folded, lines)
        .withColumn("linear", F.col("slope") * F.col(x) + F.col("intercept"))
        .drop("slope", "intercept")
    )


def _lookup_fold(folded: DataFrame, models: DataFrame) -> DataFrame:
    """Join on level, key and fold; categories and the whole are spread, while
    a product has few rows and the many product models stay unrepeated."""
    many = F.col("level") != "product"
    return salted_lookup(folded, models, ["level", "key", "fold"], ["product_id"], hot=many)


# --- linear model on all features, for every key at once ---------------------


def _products(columns: Sequence[pa.Array]) -> np.ndarray:
    """Per row the products of 1, x and y with each other, as the upper triangle of one matrix; nulls add nothing."""
    wide = [pc.fill_null(c.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) for c in columns]
    wide = np.column_stack([np.ones(len(wide[0])), *wide])
    upper = np.triu_indices(wide.shape[1])
    return wide[:, upper[0]] * wide[:, upper[1]]


#: Keys and folds whose sums a task holds before it hands them on.
SUMS_HELD = 4096


def _moments(folded: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """Sums ``_m`` of these products per level, key and fold of a task's rows, several rows a key and fold at most."""
    columns = [*features, y]

    def handed(sums: dict) -> pa.RecordBatch:
        level, key, fold = zip(*sums, strict=True)
        arrays = [pa.array(level, pa.string()), pa.array(key, pa.string()), pa.array(fold, pa.int32())]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(list(sums.values()), pa.list_(pa.float64()))], ["level", "key", "fold", "_m"])

    def add(batches):
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.stack([batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in ("level", "key", "fold")])
            order = np.lexsort(codes)
            sorted_codes = codes[:, order]
            starts = np.flatnonzero(np.r_[True, (sorted_codes[:, 1:] != sorted_codes[:, :-1]).any(axis=0)])
            added = np.add.reduceat(_products([batch.column(c) for c in columns])[order], starts, axis=0)
            firsts = pa.array(order[starts])
            for place, own in zip(zip(*[batch.column(c).take(firsts).to_pylist() for c in ("level", "key", "fold")], strict=True), added, strict=True):
                sums[place] = sums[place] + own if place in sums else own
            if len(sums) > SUMS_HELD:
                yield handed(sums)
                sums = {}
        if sums:
            yield handed(sums)

    rows = folded.select("level", "key", F.col("fold").cast("int").alias("fold"), *[F.col(c).cast("double").alias(c) for c in columns])
    return rows.mapInArrow(add, "level string, key string, fold int, _m array<double>")


def solve_least_squares(triangles: np.ndarray) -> np.ndarray:
    """Intercept and coefficients from flattened triangles of sums.

    The smallest solution where features are collinear or rows too few, as a
    least-squares solver on the rows themselves would give. A matrix that is
    far from singular has one solution, which its inverse gives sooner.
    """
    width = int((np.sqrt(8 * triangles.shape[1] + 1) - 1) / 2)
    upper = np.triu_indices(width)
    sums = np.zeros((len(triangles), width, width))
    sums[:, upper[0], upper[1]] = triangles
    sums[:, upper[1], upper[0]] = triangles
    n = sums[:, :1, 0]
    means = sums[:, 0, 1:] / n
    centred = sums[:, 1:, 1:] - n[:, :, None] * means[:, :, None] * means[:, None, :]
    variance = np.clip(np.einsum("bii->bi", centred)[:, :-1], 0.0, None)
    constant = variance <= 1e-18 * n * (1.0 + means[:, :-1] ** 2)
    scale = np.where(constant, np.inf, np.sqrt(variance))
    gram = centred[:, :-1, :-1] / (scale[:, :, None] * scale[:, None, :])
    target = centred[:, :-1, -1] / scale
    inverse = np.empty_like(gram)
    regular = ~constant.any(axis=1) & (n[:, 0] > width - 1) & np.isfinite(gram).all(axis=(1, 2))
    try:
        inverse[regular] = np.linalg.inv(gram[regular])
        condition = np.linalg.norm(gram[regular], 1, axis=(1, 2)) * np.linalg.norm(inverse[regular], 1, axis=(1, 2))
        regular[regular] = condition < 1e7
    except np.linalg.LinAlgError:
        regular[:] = False
    inverse[~regular] = np.linalg.pinv(gram[~regular], rcond=1e-10, hermitian=True)
    beta = np.einsum("bij,bj->bi", inverse, target) / scale
    intercept = means[:, -1] - np.einsum("bi,bi->b", beta, means[:, :-1])
    return np.column_stack([intercept, beta])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def least_squares(moments: pd.Series) -> pd.Series:
    """``solve_least_squares`` of a column of triangles."""
    return pd.Series(list(solve_least_squares(np.stack(moments.to_numpy()).astype(float))))


def linear_models(folded: DataFrame, features: Sequence[str], y: str = "y") -> DataFrame:
    """``coefficients`` (intercept first) per level, key and fold.

    Training sums are algebraic: one aggregation with map-side combining
    serves all levels, keys and folds however large a key is, and only the
    small matrix of each model is solved in Python.
    """
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(y).cast("double")]
    products = [F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    return _solved(folded.groupBy("level", "key", "fold").agg(F.array(*products).alias("_m")), len(products))


def wide_linear_models(folded: DataFrame, features: Sequence[str], y: str = "y") -> DataFrame:
    """``linear_models`` of keys with many rows each: a task adds up its own before they are added by key."""
    width = len(features) + 2
    size = width * (width + 1) // 2
    sums = _moments(folded, features, y).groupBy("level", "key", "fold")
    return _solved(sums.agg(F.array(*[F.sum(F.col("_m")[i]) for i in range(size)]).alias("_m")), size)


def _solved(sums: DataFrame, size: int) -> DataFrame:
    """The models of sums ``_m`` per fold, each of all folds up to its own."""
    upto = Window.partitionBy("level", "key").orderBy("fold")
    totals = sums.select(
        "level",
        "key",
        (F.col("fold") + 1).alias("fold"),
        F.array(*[F.sum(F.col("_m")[i]).over(upto) for i in range(size)]).alias("_m"),
    )
    return totals.select("level", "key", "fold", least_squares("_m").alias("coefficients"))


#: Rows whose products are held at once.
ROWS_MULTIPLIED = 16_384


def product_linear_models(folded: DataFrame, features: Sequence[str], y: str = "y") -> DataFrame:
    """``linear_models`` of keys with one row a month: ``models`` per level and key, a map from fold to coefficients.

    A key's rows meet as one list where they lie, and a batch of keys is
    summed, added up over the folds and solved at once.
    """
    columns = [*features, y]

    @F.arrow_udf("array<struct<fold:int,coefficients:array<double>>>")
    def solved(lists: pa.Array) -> pa.Array:
        rows = lists.flatten()
        held, lengths = [rows.field(c) for c in columns], lists.value_lengths().to_numpy()
        key = np.repeat(np.arange(len(lengths)), lengths)
        fold = rows.field("fold").to_numpy(zero_copy_only=False)
        order = np.lexsort((fold, key))
        key, fold, sums = key[order], fold[order], []
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (fold[1:] != fold[:-1])])
        first = 0
        while first < len(starts):
            last = max(first + 1, np.searchsorted(starts, starts[first] + ROWS_MULTIPLIED))
            part = order[starts[first] : starts[last] if last < len(starts) else len(order)]
            sums.append(np.add.reduceat(_products([c.take(pa.array(part)) for c in held]), starts[first:last] - starts[first], axis=0))
            first = last
        sums, key, fold = np.concatenate(sums), key[starts], fold[starts]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        while len(same):  # a fold adds what its key's fold before it has, the first folds first
            ready = same[~np.isin(same - 1, same)]
            sums[ready] += sums[ready - 1]
            same = same[~np.isin(same, ready)]
        coefficients = solve_least_squares(sums)
        inner = pa.FixedSizeListArray.from_arrays(pa.array(coefficients.ravel()), coefficients.shape[1]).cast(pa.list_(pa.float64()))
        entries = pa.StructArray.from_arrays([pa.array((fold + 1).astype(np.int32)), inner], ["fold", "coefficients"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(key, np.arange(len(lengths) + 1)).astype(np.int32)), entries)

    row = F.struct(F.col("fold").cast("int").alias("fold"), *[F.col(c).cast("double").alias(c) for c in columns])
    lists = folded.groupBy("level", "key").agg(F.collect_list(row).alias("_rows"))
    entries = F.transform(solved("_rows"), lambda e: F.struct(e.fold, F.struct(e.coefficients.alias("coefficients"))))
    return lists.select("level", "key", F.map_from_entries(entries).alias("models"))


def linear_value(features: Sequence[str], coefficients: Column | str = "coefficients") -> Column:
    """Prediction of ``coefficients`` for a row."""
    own = F.col(coefficients) if isinstance(coefficients, str) else coefficients
    terms = [own[i + 1] * F.col(f) for i, f in enumerate(features)]
    return own[0] + sum(terms)


def fold_models(
    table: DataFrame,
    fit: Callable[[DataFrame], DataFrame],
    levels: Sequence[str] = LEVELS,
    fit_products: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Per level: key and ``models``, a map from each fold to the model of its training rows.

    ``fit`` gets rows of ``fold_columns`` per level, key and fold;
    ``fit_products``, if given, those of products, and returns their maps.
    Products are fitted where their rows lie, and their models are clustered like
    them; sums of categories and the whole combine on the map side.
    """

    def mapped(models):
        values = [c for c in models.columns if c not in ("level", "key", "fold")]
        entries = F.collect_list(F.struct("fold", F.struct(*values)))
        return models.groupBy("level", "key").agg(F.map_from_entries(entries).alias("models"))

    out = {}
    if "product" in levels:
        rows = level_rows(table, ["product"])
        out["product"] = clustered(mapped(fit(rows)) if fit_products is None else fit_products(rows), "lines", "key")
    wide = [level for level in levels if level != "product"]
    if wide:
        lines = materialize(mapped(fit(level_rows(table, wide))), "lines")
        out |= {level: lines.where(F.col("level") == level) for level in wide}
    return out


def linear_fold_models(table: DataFrame, features: Sequence[str], levels: Sequence[str] = LEVELS) -> dict[str, DataFrame]:
    """``fold_models`` of the linear member."""
    return fold_models(
        table, lambda rows: wide_linear_models(rows, features), levels, lambda rows: product_linear_models(rows, features)
    )


def with_fold_models(table: DataFrame, models: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of ``fold_columns`` with the models of their keys in a map ``_<level>`` a level.

    Products meet their models where they lie; categories, of which one may
    hold most rows, are spread; the models of the whole are one row.
    """
    for level, own in models.items():
        if level == "global":
            table = table.withColumn("_global", own.select("models").scalar())
            continue
        key = f"{'product' if level == 'product' else 'product_category'}_id"
        own = own.select(F.col("key").alias(key), F.col("models").alias(f"_{level}"))
        table = table.join(own, key, "left") if level == "product" else salted_lookup(table, own, [key], ["product_id"])
    return table


def model_at(level: str, fold: Column | int | None = None) -> Column:
    """The model of a level for a fold, by default the one that predicts the row's own fold."""
    return F.col(f"_{level}")[F.col(f"fold_{level}") if fold is None else fold]


def with_linear_member(
    folded: DataFrame, models: DataFrame, features: Sequence[str], output: str = "linear"
) -> DataFrame:
    table = models.where(F.col("fold") <= FOLDS)
    return (
        _lookup_fold(folded, table)
        .withColumn(output, linear_value(features))
        .drop("coefficients")
    )


# --- Spark ML members ----------------------------------------------------------

#: The trained columns in order, as one vector.
VECTOR = "_features"


@dataclass(frozen=True)
class TreeParameters:
    """Sizes of the tree members; the defaults are the tuned values.

    The tuned column share is drawn anew for every node, not once a tree.
    """

    # fixed values
    boosted_a: Mapping = field(
        default_factory=lambda: {
            "maxIter": 303,
            "maxDepth": 10,
            "stepSize": 0.10487662447025792,
            "subsamplingRate": 0.8493831368447333,
            "featureSubsetStrategy": "0.9578410352643851",
            "seed": 42,
        }
    )
    boosted_b: Mapping = field(
        default_factory=lambda: {
            "maxIter": 499,
            "maxDepth": 9,
            "stepSize": 0.1594880549905189,
            "subsamplingRate": 0.829623127594056,
            "featureSubsetStrategy": "0.9945381025198837",
            "seed": 42,
        }
    )
    forest: Mapping = field(default_factory=lambda: {"numTrees": 200, "maxDepth": 10, "seed": 42})


#: Rows keep the node they reached, so that a level does not walk every tree
#: from its root again; that and boosting's residuals grow a lineage, which is
#: cut every so many rounds.
GROWING = {"cacheNodeIds": True, "checkpointInterval": 10}


def tree_estimators(parameters: TreeParameters = TreeParameters()) -> dict[str, Estimator]:
    """The boosted and forest members by name."""
    return {
        "boosted_a": GBTRegressor(**GROWING, **parameters.boosted_a),
        "boosted_b": GBTRegressor(**GROWING, **parameters.boosted_b),
        "forest": RandomForestRegressor(**GROWING, **parameters.forest),
    }


def global_linear() -> Estimator:
    return LinearRegression(regParam=0.0)


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR)


def assembled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows with their trained columns as one vector, written for the many fits that read them.

    A fit works for long on few bytes, so a table too small to be read in
    as many tasks as the cluster has cores is dealt out to that many.
    """
    check_columns(rows, features)
    vectors = _assembler(features).transform(rows).drop(*features)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        vectors = vectors.repartition(cores, *[c for c in ("product_id", "MONAT") if c in vectors.columns])
    return materialize(vectors, "assembled")


#: Most trees of a forest that are fitted at once.
TREES_A_FIT = 200


def _fit_forest(train: DataFrame, forest: RandomForestRegressor) -> Model:
    """A forest fitted as several of at most ``TREES_A_FIT`` trees, one after the other, with a seed each.

    The rows are binned once for all of them.
    """
    train = forest.prepared(train)
    total = forest.getNumTrees()
    fits = -(-total // TREES_A_FIT)
    if fits < 2:
        return forest.fit(train)
    sizes = [total * (i + 1) // fits - total * i // fits for i in range(fits)]
    seeds = [forest.getSeed() + 1_000_003 * i for i in range(fits)]
    parts = [forest.fit(train, {forest.numTrees: n, forest.seed: s}) for n, s in zip(sizes, seeds, strict=True)]
    gateway = train.sparkSession.sparkContext._gateway
    kinds = gateway.jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(kinds.DecisionTreeRegressionModel, total)
    for i, tree in enumerate(t for part in parts for t in part._java_obj.trees()):
        trees[i] = tree
    joined = kinds.RandomForestRegressionModel(parts[0].uid, trees, parts[0].numFeatures)
    model = forest._copyValues(RandomForestRegressionModel(joined))
    model._transfer_params_to_java()
    return model


def fit_member(
    train: DataFrame, estimator: Estimator, features: Sequence[str], output: str, y: str = "y"
) -> Model:
    """Fit on assembled rows, or on plain ones, whose columns are assembled in order; absent ones are an error.

    The estimator may be any of Spark ML's or a user's own with the three
    usual columns (features, label, prediction); its fitted model is stored
    with the others if it can write and read itself.
    """
    assembler = _assembler(features)
    if VECTOR not in train.columns:
        check_columns(train, features)
        train = assembler.transform(train)
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(train.sparkSession))
    columns = {estimator.featuresCol: VECTOR, estimator.labelCol: y, estimator.predictionCol: output}
    fitting = estimator.copy(columns)
    fitted = _fit_forest(train, fitting) if isinstance(fitting, RandomForestRegressor) else fitting.fit(train)
    return PipelineModel([assembler, fitted])


def predict_member(model: Model, rows: DataFrame, output: str) -> DataFrame:
    """The rows with a member's prediction; rows that are assembled already are not assembled again."""
    given = rows if VECTOR in rows.columns else model.stages[0].transform(rows)
    fitted = model.stages[-1]
    if isinstance(fitted, RandomForestRegressionModel) and not fitted.getLeafCol():
        predicted = with_prediction(fitted, given, VECTOR, output)
    else:
        predicted = fitted.transform(given)
    return predicted if given is rows else predicted.drop(VECTOR)


def member_importance(model: Model, features: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, importance) of a fitted member, coefficients by size; 0 where a model has neither."""
    fitted = model.stages[-1]
    values = getattr(fitted, "featureImportances", None)
    if values is None:
        values = [abs(c) for c in getattr(fitted, "coefficients", np.zeros(len(features)))]
    return [(f, float(values[i])) for i, f in enumerate(features)]
