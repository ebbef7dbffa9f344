"""Classifiers, grid searches, clustering sweeps and stacked scoring on MLlib."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from itertools import product

from pyspark.ml.classification import (GBTClassifier, LogisticRegression, RandomForestClassifier)
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel
from pyspark.util import inheritable_thread_target

from wordtrail.functions.arrays import let
from wordtrail.functions.hashing import unit_hash
from wordtrail.operators import boosting, evaluate
from wordtrail.operators.features import stacked_vector, text_features
from wordtrail.operators.votes import apply_models, pair_code, pair_label
from wordtrail.session import cut_lineage

# The grids.
FOREST_GRID = {"maxDepth": [5, 7, 9, 11, 13, 15], "numTrees": [5, 10, 15, 20, 25, 30, 35, 40, 45, 50]}
LOGISTIC_GRID = {"regParam": [0.01, 0.05, 0.1, 0.5], "maxIter": [10, 50, 100, 1000],
                 "elasticNetParam": [0.0, 0.8]}
TREE_REGRESSION_GRID = {"maxDepth": [5, 10, 15], "numTrees": [5, 10, 20, 50]}
SMALLER_IS_BETTER = {"hammingLoss", "falsePositiveRateByLabel", "weightedFalsePositiveRate"}
BOOSTING_GRID = {"maxDepth": [5, 10, 15], "maxIter": [5, 10, 20, 50]}


def side_by_side(spark: SparkSession, fits: Iterable[Callable], at_once: int = 4) -> Iterator:
    """What the calls return, in their order; at most ``at_once`` run or wait to be taken."""
    waiting: deque = deque()
    with ThreadPoolExecutor(at_once) as pool:
        try:
            for fit in fits:
                waiting.append(pool.submit(inheritable_thread_target(spark)(fit)))
                if len(waiting) == at_once:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()
        finally:
            for left in waiting:
                left.cancel()


def grid_search(estimator, grid: dict[str, Sequence], train: DataFrame, test: DataFrame, evaluator,
                threshold: float | None = None):
    """Best ``(model, parameters with metricValue)`` over the grid, in the grid's order.

    Fits run side by side, metrics are taken in the grid's order. Stops at the first metric that
    reaches ``threshold``. Both frames are kept for the fits.
    """
    larger = evaluator.isLargerBetter()
    best_model, best = None, None
    kept = [df.persist(StorageLevel.MEMORY_AND_DISK) for df in ({train, test})]
    grids = [dict(zip(grid, values)) for values in product(*grid.values())]
    copies = [estimator.copy({getattr(estimator, k): v for k, v in params.items()}) for params in grids]
    fitted = side_by_side(train.sparkSession, [partial(copy.fit, train) for copy in copies])
    try:
        for params, model in zip(grids, fitted):
            metric = evaluator.evaluate(model.transform(test))
            if best is None or (metric > best["metricValue"] if larger else metric < best["metricValue"]):
                best_model, best = model, {**params, "metricValue": metric}
            if threshold is not None and (metric >= threshold if larger else metric <= threshold):
                break
    finally:
        fitted.close()
        for df in kept:
            df.unpersist()
    return best_model, best


class FirstTrees:
    """The first ``n`` trees of a fitted ensemble as a model of their own; ``n`` may be several numbers.

    A boosted ensemble of fewer rounds is the beginning of a longer one, tree by tree, and the first
    trees of a forest are a forest. So one fit serves every number of trees.
    """

    def __init__(self, model, n: int | Sequence[int], prediction: str):
        self.model, self.prediction = model, prediction
        self.sizes = [n] if isinstance(n, int) else list(n)

    def predictions(self, df: DataFrame) -> DataFrame:
        """``df`` with an array of one prediction a size. Every tree is applied once."""
        if isinstance(self.model, boosting.Boosted):
            return self.model.beginnings(df, self.sizes)
        forest, classes = hasattr(self.model, "numClasses"), getattr(self.model, "numClasses", 0)
        boosted = "GBT" in type(self.model).__name__
        out, trees = df, []
        for i, tree in enumerate(self.model.trees[:max(self.sizes)]):
            tree = tree.setFeaturesCol(self.model.getFeaturesCol())
            if forest and not boosted:
                tree = tree.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"_tree{i}")
            else:
                tree = tree.setPredictionCol(f"_tree{i}")
            out = tree.transform(out)
            trees.append(vector_to_array(f"_tree{i}") if forest and not boosted else F.col(f"_tree{i}"))
        weights = F.array(*[F.lit(float(w)) for w in self.model.treeWeights])
        found = out.select(*df.columns, F.array(*trees).alias("_trees"))

        reached = sorted({min(n, len(trees)) for n in self.sizes})
        # one walk over the trees with a running sum; the predictions are taken at the sizes passed
        begin = F.array_repeat(F.lit(0.0), classes) if forest and not boosted else F.lit(0.0)
        weighted = found.withColumn("_trees", F.zip_with("_trees", weights, lambda t, w: t if forest and not boosted else w * t))

        def added(total: Column, tree: Column) -> Column:
            return F.zip_with(total, tree, lambda a, b: a + b) if forest and not boosted else total + tree

        def predicted(total: Column, n: Column) -> Column:
            if boosted:
                return F.when(total > 0, 1.0).otherwise(0.0) if forest else total
            if not forest:
                return total / n
            return (F.array_position(total, F.array_max(total)) - 1).cast("double")

        def walk(state: Column, tree: Column) -> Column:
            def after(total: Column) -> Column:
                n = state["n"] + 1
                out = F.when(n.isin(reached), F.concat(state["out"], F.array(predicted(total, n)))).otherwise(state["out"])
                return F.struct(n.alias("n"), total.alias("total"), out.alias("out"))
            return let(added(state["total"], tree), after)

        start = F.struct(F.lit(0).alias("n"), begin.alias("total"), F.array().cast("array<double>").alias("out"))
        walked = F.aggregate("_trees", start, walk, lambda state: state["out"])
        return weighted.select(*df.columns, walked.alias("_reached")).select(*df.columns, F.array(*[
            F.get("_reached", F.lit(reached.index(min(n, len(trees))))) for n in self.sizes]).alias("_predictions"))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.predictions(df).select(*df.columns, F.get("_predictions", F.lit(0)).alias(self.prediction))


def class_metric(counts: dict[tuple[float, float], int], metric: str, label: float = 0.0, beta: float = 1.0) -> float:
    """A metric of MLlib's by name, from the numbers of rows by (true class, predicted class)."""
    total = sum(counts.values())
    truths = sorted({t for t, _ in counts})
    right = lambda c: counts.get((c, c), 0)
    true_of = lambda c: sum(n for (t, _), n in counts.items() if t == c)
    said = lambda c: sum(n for (_, p), n in counts.items() if p == c)
    ratio = lambda a, b: a / b if b else 0.0
    recall = lambda c: ratio(right(c), true_of(c))
    precision = lambda c: ratio(right(c), said(c))
    f = lambda c: ratio((1 + beta ** 2) * precision(c) * recall(c), beta ** 2 * precision(c) + recall(c))
    wrongly = lambda c: ratio(said(c) - right(c), total - true_of(c))
    of_label = {"precisionByLabel": precision, "recallByLabel": recall, "truePositiveRateByLabel": recall, "fMeasureByLabel": f, "falsePositiveRateByLabel": wrongly}
    weighted = {"f1": f, "weightedFMeasure": f, "weightedPrecision": precision, "weightedRecall": recall, "weightedTruePositiveRate": recall,
                "weightedFalsePositiveRate": wrongly}
    if metric in of_label:
        return of_label[metric](label)
    if metric in weighted:
        return sum(true_of(c) * weighted[metric](c) for c in truths) / total
    if metric in ("accuracy", "hammingLoss"):
        share = sum(map(right, truths)) / total
        return share if metric == "accuracy" else 1 - share
    raise ValueError(f"no class metric {metric}")


def several_scores(predicted: DataFrame, label: str, score: Callable[[dict], float] | None) -> list[float]:
    """One metric a model from an array ``_predictions``, all in one aggregate: ``score`` of the
    counts by (true, predicted) class, or the root mean squared error where there is none."""
    each = predicted.select(F.col(label).cast("double").alias("y"), F.posexplode("_predictions").alias("i", "p"))
    if score is None:
        error = F.sqrt(F.avg(F.pow(F.col("p") - F.col("y"), 2))).alias("v")
        return [r.v for r in each.groupBy("i").agg(error).orderBy("i").collect()]
    counts: dict[int, dict] = {}
    for r in each.groupBy("i", "y", "p").count().collect():  # models times the square of the number of classes
        counts.setdefault(r.i, {})[r.y, r.p] = r["count"]
    return [score(counts[i]) for i in sorted(counts)]


def best_point(points: Iterable[tuple], larger: bool, threshold: float | None = None) -> tuple:
    """``(model, parameters, all points seen)`` of the best metric, the first of equal ones; the
    first point that reaches ``threshold`` ends the search."""
    best, seen = None, []
    for model, params in points:
        value = params["metricValue"]
        seen.append(params)
        if best is None or (value > best[1]["metricValue"] if larger else value < best[1]["metricValue"]):
            best = model, params
        if threshold is not None and (value >= threshold if larger else value <= threshold):
            break
    return (*best, seen) if best else (None, None, seen)


def ensemble_grid(estimator, depths: Sequence[int], size_param: str, sizes: Sequence[int], df: DataFrame, label: str,
                  score: Callable[[dict], float] | None = None, larger: bool = True, threshold: float | None = None) -> tuple:
    """Best model over depth times number of trees: one fit a depth, of the largest number of trees,
    and one pass over the rows for the metrics of all its beginnings. Fits run side by side.

    Boosted trees are grown by ``boosting.fit`` and known by the rows they were fitted on: their
    predictions for these at every size are left by the fit.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    prediction = estimator.getPredictionCol()
    copies = [estimator.copy({estimator.maxDepth: d, getattr(estimator, size_param): max(sizes)}) for d in depths]
    boosted = isinstance(estimator, (GBTClassifier, GBTRegressor))
    fits = [partial(boosting.fit, copy, kept, sizes) if boosted else partial(copy.fit, kept) for copy in copies]
    fitted = side_by_side(df.sparkSession, fits)

    def points():
        for depth, model in zip(depths, fitted):
            predicted = model.fitted if boosted else FirstTrees(model, sizes, prediction).predictions(kept.select("features", label))
            values = several_scores(predicted, label, score)
            if boosted:
                model.forget()
            for n, value in zip(sizes, values):
                yield FirstTrees(model, n, prediction), {"maxDepth": depth, size_param: n, "metricValue": value}

    try:
        return best_point(points(), larger, threshold)
    finally:
        fitted.close()
        kept.unpersist()


def classifier_grid(estimator, grid: dict[str, Sequence], train: DataFrame, test: DataFrame, label: str,
                score: Callable[[dict], float], larger: bool = True, threshold: float | None = None) -> tuple:
    """Best model over a grid of a classifier: fits side by side, then all models applied in one
    pass over ``test``, whose metrics are one aggregate. Both frames are kept for the fits."""
    kept = {id(df): df.persist(StorageLevel.MEMORY_AND_DISK) for df in (train, test)}
    grids = [dict(zip(grid, values)) for values in product(*grid.values())]
    copies = [estimator.copy({getattr(estimator, k): v for k, v in params.items()}) for params in grids]
    try:
        models = list(side_by_side(train.sparkSession, [partial(copy.fit, train) for copy in copies]))
        rows = test.select("features", label)
        for i, model in enumerate(models):
            named = model.copy().setPredictionCol(f"_p{i}").setRawPredictionCol("").setProbabilityCol("")
            rows = named.transform(rows)
        values = several_scores(rows.select(label, F.array(*[f"_p{i}" for i in range(len(models))]).alias("_predictions")), label, score)
        return best_point(((m, {**params, "metricValue": v}) for m, params, v in zip(models, grids, values)), larger, threshold)
    finally:
        for df in kept.values():
            df.unpersist()


def forest_grid(df: DataFrame, prediction: str, label: str, threshold: float | None = 1.0,
                grid: dict = FOREST_GRID, seed: int = 42) -> tuple:
    """Random-forest classifier by accuracy on the training rows, with early stop."""
    estimator = RandomForestClassifier(featuresCol="features", labelCol=label, predictionCol=prediction, seed=seed)
    return ensemble_grid(estimator, grid["maxDepth"], "numTrees", grid["numTrees"], df, label, partial(class_metric, metric="accuracy"), True, threshold)


def logistic_grid(train: DataFrame, test: DataFrame, prediction: str, label: str,
                  metric: str = "accuracy", metric_label: float = 0.0, threshold: float | None = 1.0,
                  grid: dict = LOGISTIC_GRID) -> tuple:
    """Multinomial logistic regression scored on held-out rows."""
    estimator = LogisticRegression(featuresCol="features", labelCol=label, predictionCol=prediction,
                                   family="multinomial")
    return classifier_grid(estimator, grid, train, test, label, partial(class_metric, metric=metric, label=metric_label),
                       metric not in SMALLER_IS_BETTER, threshold)


def forest_regression_grid(df: DataFrame, prediction: str, label: str, grid: dict = TREE_REGRESSION_GRID,
                           seed: int = 42) -> tuple:
    """Random-forest regression with the smallest rmse."""
    estimator = RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol=prediction, seed=seed)
    return ensemble_grid(estimator, grid["maxDepth"], "numTrees", grid["numTrees"], df, label, larger=False)


def boosted_regression_grid(df: DataFrame, prediction: str, label: str, grid: dict = BOOSTING_GRID,
                            seed: int = 42) -> tuple:
    """Gradient-boosted regression with the smallest rmse."""
    estimator = GBTRegressor(featuresCol="features", labelCol=label, predictionCol=prediction, seed=seed)
    return ensemble_grid(estimator, grid["maxDepth"], "maxIter", grid["maxIter"], df, label, larger=False)


def boosted_classifier_grid(df: DataFrame, prediction: str, label: str, metric: str = "accuracy",
                            grid: dict = BOOSTING_GRID, seed: int = 42) -> tuple:
    """Gradient-boosted binary classifier by a classification metric."""
    estimator = GBTClassifier(featuresCol="features", labelCol=label, predictionCol=prediction, seed=seed)
    return ensemble_grid(estimator, grid["maxDepth"], "maxIter", grid["maxIter"], df, label, partial(class_metric, metric=metric),
                         metric not in SMALLER_IS_BETTER)


def sentiment_flow(train: DataFrame, test: DataFrame, text: str, label: str, key: str, form: str, **params) -> DataFrame:
    """``(key, label, num_tokens, prediction, score)`` of the test rows: text features and a logistic
    regression, both fitted on the training rows alone.

    The assembler names every slot in the column's metadata, which would travel with each of the
    regression's passes; it is dropped. The rows are dealt to all cores; not to more tasks than
    that, as each sends back a gradient as wide as the features.
    """
    staged = text_features(text, form).fit(train)
    rows = cut_lineage(staged.transform(train).select("features", label).withMetadata("features", {}))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    model = LogisticRegression(labelCol=label, **params).fit(rows.repartition(cores))
    scored = model.transform(staged.transform(test).withMetadata("features", {}))
    return scored.select(key, label, "num_tokens", "prediction", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def test_metrics(scored: DataFrame, label: str) -> DataFrame:
    """One row: area under the curve, and counts and rates of the predictions."""
    kept = cut_lineage(scored.select(F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("p"), "score"))
    return evaluate.binary_metrics(kept, "y", "p").crossJoin(F.broadcast(evaluate.area_under_roc(kept, "score", "y")))  # a row each


def cross_validated(estimator, grid: dict[str, Sequence], df: DataFrame, evaluator, folds: int = 3,
                    parallelism: int = 4, seed: int = 42) -> CrossValidatorModel:
    """Spark's own k-fold search with fits running side by side."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(estimator, name), list(values))
    return CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=evaluator,
                          numFolds=folds, parallelism=parallelism, seed=seed).fit(df)


def auc(predictions: DataFrame, label: str) -> float:
    return BinaryClassificationEvaluator(labelCol=label).evaluate(predictions)


def cluster_sweep(df: DataFrame, largest: int, features: str = "features", bisecting: bool = False,
                  seed: int = 42) -> DataFrame:
    """``(clusters, silhouette, cost)`` for 2..largest clusters."""
    kept = df.select(features).persist(StorageLevel.MEMORY_AND_DISK)
    kind = BisectingKMeans if bisecting else KMeans
    evaluator = ClusteringEvaluator(predictionCol="cluster", featuresCol=features, metricName="silhouette")
    rows = []
    for k in range(2, largest + 1):
        model = kind(featuresCol=features, k=k, predictionCol="cluster", seed=seed).fit(kept)
        rows.append((k, evaluator.evaluate(model.transform(kept)), model.summary.trainingCost))
    kept.unpersist()
    return df.sparkSession.createDataFrame(rows, "clusters int, silhouette double, cost double")


def fit_binary_scorers(df: DataFrame, label: str, targets: Iterable[int], **params) -> dict:
    """One boosted yes/no model per target score."""
    targets = list(targets)
    fits = [partial(_boosted, df.withColumn("_y", (F.col(label) == t).cast("int")), **params) for t in targets]
    return dict(zip(targets, side_by_side(df.sparkSession, fits)))


def fit_pair_scorers(df: DataFrame, label: str, pairs: Iterable[tuple], rest: bool = False, **params) -> dict:
    """One boosted model per score pair: upper member against lower (``rest``: the pair's members
    against all other scores)."""
    pairs, fits = list(pairs), []
    for pair in pairs:
        if rest:
            rows, y = df, F.col(label).isin(*pair)
        else:
            rows, y = df.filter(F.col(label).isin(*pair)), F.col(label) == pair[1]
        fits.append(partial(_boosted, rows.withColumn("_y", y.cast("int")), **params))
    return dict(zip(pairs, side_by_side(df.sparkSession, fits)))


def _boosted(df: DataFrame, **params):
    return GBTClassifier(featuresCol="features", labelCol="_y", predictionCol="_p",
                         **{"seed": 42, **params}).fit(df)


def stack(df: DataFrame, key: str, binary: dict, pairs: dict, quaternary: dict) -> DataFrame:
    """``key``, ``features`` and the stacked vector ``features_2`` of all first-level outputs:
    binary outputs, 0/1 pair winners and quaternary outputs, in one plan."""
    names = lambda models: ["_".join(map(str, k)) if isinstance(k, tuple) else str(k) for k in models]
    scored = df
    for prefix, models in (("bin_", binary), ("pair_", pairs), ("quad_", quaternary)):
        keep = scored.columns
        scored = apply_models(scored, list(models.values()), prefix, names(models))
        scored = scored.select(*keep, *[f"{prefix}{n}" for n in names(models)])
    pair_columns = [pair_code(pair_label(f"pair_{n}", pair), pair) for n, pair in zip(names(pairs), pairs)]
    columns = [f"bin_{n}" for n in names(binary)] + pair_columns + [f"quad_{n}" for n in names(quaternary)]
    return scored.select(*df.columns, stacked_vector(columns, "features_2"))


def with_folds(df: DataFrame, key: str, folds: int) -> DataFrame:
    return df.withColumn("_fold", F.floor(unit_hash(F.col(key), F.lit("folds")) * folds).cast("int"))


def cross_fitted_stack(df: DataFrame, key: str, label: str, fit_first: Callable[[DataFrame], tuple[dict, dict, dict]], folds: int = 2) -> DataFrame:
    """The stacked rows of ``stack``, in which no row is scored by a model that has seen it: the
    rows are dealt into folds by hash, and each fold is scored by models fitted on the others."""
    kept = with_folds(df, key, folds).persist(StorageLevel.MEMORY_AND_DISK)
    parts = []
    for fold in range(folds):
        models = fit_first(kept.filter(F.col("_fold") != fold).drop("_fold"))
        parts.append(stack(kept.filter(F.col("_fold") == fold), key, *models))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def cross_fitted_scores(df: DataFrame, key: str, label: str, fit_first: Callable[[DataFrame], tuple[dict, dict, dict]], folds: int = 2) -> DataFrame:
    """``(key, score)``: both levels cross-fitted, so that no model behind a row's score has seen its label."""
    stacked = cut_lineage(cross_fitted_stack(df, key, label, fit_first, folds).select(key, label, "_fold", "features_2"))
    parts = [final_score(stacked.filter(F.col("_fold") == fold), key, fit_final(stacked.filter(F.col("_fold") != fold), label)) for fold in range(folds)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def fit_final(stacked: DataFrame, label: str, seed: int = 42):
    """Second-level model over the stacked vector; its classes start at 0."""
    zero_based = stacked.withColumn("_final", F.col(label) - 1)
    return RandomForestClassifier(featuresCol="features_2", labelCol="_final", predictionCol="_final_p",
                                  seed=seed).fit(zero_based)


def final_score(stacked: DataFrame, key: str, model) -> DataFrame:
    """``(key, score)``"""
    return model.transform(stacked).select(key, (F.col(model.getPredictionCol()) + 1).cast("int").alias("score"))
