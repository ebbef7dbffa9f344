"""Model queries search the whole grids and fit every model of the stack."""

import math
import random
from itertools import combinations

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from wordtrail import plans
from wordtrail.operators import learning
from wordtrail.plans import learned


def test_grids_are_whole(spark, folder, monkeypatch):
    points, fits = [], []

    def ensemble(estimator, depths, size_param, sizes, *rest, **options):
        points.append(len(depths) * len(sizes)), fits.append(len(depths))
        return None, {"metricValue": 0.0}, []

    def classifier(estimator, grid, *rest, **options):
        points.append(math.prod(map(len, grid.values()))), fits.append(points[-1])
        return None, {"metricValue": 0.0}, []

    monkeypatch.setattr(learning, "ensemble_grid", ensemble)
    monkeypatch.setattr(learning, "classifier_grid", classifier)
    for name in ("l6_forest_grid", "l7_logistic_grid", "l8_forest_regression_grid", "l9_boosted_regression_grid", "l10_boosted_classifier_grid"):
        plans.all_queries()[name](spark, folder)
    assert points == [60, 32, 12, 12, 12] and fits == [6, 32, 3, 3, 3]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    made = [(Vectors.dense([r.gauss(0, 1) for _ in range(4)]),) for _ in range(400)]
    noisy = F.get(vector_to_array("features"), F.lit(0)) + F.rand(1) - 0.5
    return spark.createDataFrame(made, ["features"]).select("features", (noisy > 0).cast("double").alias("y"), noisy.alias("z"),
                                                            F.pmod(F.floor(noisy), F.lit(3)).cast("double").alias("c")).cache()


def test_first_trees_equal_shorter_boosted_fits(rows):
    whole = GBTClassifier(labelCol="y", predictionCol="p", maxIter=8, maxDepth=3, seed=7).fit(rows)
    line = GBTRegressor(labelCol="z", predictionCol="p", maxIter=8, maxDepth=3, seed=7).fit(rows)
    for n in (1, 3, 8):
        for model, label in ((whole, "y"), (line, "z")):
            kind = GBTClassifier if label == "y" else GBTRegressor
            own = kind(labelCol=label, predictionCol="q", maxIter=n, maxDepth=3, seed=7).fit(rows)
            both = learning.FirstTrees(model, n, "p").transform(own.transform(rows))
            assert both.filter("abs(p - q) > 1e-9").isEmpty() and both.count() == 400


def test_first_trees_of_a_forest_are_a_forest(rows):
    for label, kind in (("c", RandomForestClassifier), ("z", RandomForestRegressor)):
        model = kind(labelCol=label, predictionCol="q", numTrees=6, maxDepth=4, seed=7).fit(rows)
        both = learning.FirstTrees(model, 6, "p").transform(model.transform(rows))
        assert both.filter("abs(p - q) > 1e-9").isEmpty()
        several = learning.FirstTrees(model, [1, 2, 6], "p").predictions(rows).withColumnRenamed("_predictions", "each")
        for i, n in enumerate([1, 2, 6]):
            single = learning.FirstTrees(model, n, "p").transform(several)
            assert single.filter(F.abs(F.col("p") - F.col("each")[i]) > 1e-12).isEmpty()


def test_all_sizes_come_from_one_walk_over_the_trees(rows):
    for label, kind in (("c", RandomForestClassifier), ("z", RandomForestRegressor)):
        model = kind(labelCol=label, predictionCol="q", numTrees=12, maxDepth=3, seed=7).fit(rows)
        found = learning.FirstTrees(model, [2, 12, 7], "p").predictions(rows)
        assert found._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
        several = found.withColumnRenamed("_predictions", "each")
        for i, n in enumerate([2, 12, 7]):
            single = learning.FirstTrees(model, n, "p").transform(several)
            assert single.filter(F.abs(F.col("p") - F.col("each")[i]) > 1e-12).isEmpty()


def test_tf_idf_cuts_texts_into_words_once(spark, folder):
    found = plans.all_queries()["v3_tf_idf"](spark, folder)
    assert "regexp_extract_all" not in found._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("metric", ["accuracy", "f1", "weightedPrecision", "weightedRecall", "weightedFMeasure", "precisionByLabel", "recallByLabel",
                                    "fMeasureByLabel", "falsePositiveRateByLabel", "weightedFalsePositiveRate", "hammingLoss"])
def test_class_metrics_are_those_of_the_library(rows, metric):
    said = rows.select("c", F.pmod(F.floor(F.col("z") * 2), F.lit(3)).cast("double").alias("p"))
    theirs = MulticlassClassificationEvaluator(labelCol="c", predictionCol="p", metricName=metric, metricLabel=1.0).evaluate(said)
    (ours,) = learning.several_scores(said.select("c", F.array("p").alias("_predictions")), "c", lambda n: learning.class_metric(n, metric, 1.0))
    assert abs(ours - theirs) < 1e-12


def test_grid_metrics_recomputed_from_predictions(rows):
    model, best, points = learning.forest_grid(rows, "p", "c", threshold=None, grid={"maxDepth": [2, 4], "numTrees": [2, 5]})
    assert [(p["maxDepth"], p["numTrees"]) for p in points] == [(2, 2), (2, 5), (4, 2), (4, 5)]
    share = model.transform(rows).agg(F.avg((F.col("p") == F.col("c")).cast("int"))).first()[0]
    assert abs(share - best["metricValue"]) < 1e-12 and best["metricValue"] == max(p["metricValue"] for p in points)
    model, best, points = learning.boosted_regression_grid(rows, "p", "z", grid={"maxDepth": [2, 3], "maxIter": [2, 6]})
    error = math.sqrt(model.transform(rows).agg(F.avg((F.col("p") - F.col("z")) ** 2)).first()[0])
    assert abs(error - best["metricValue"]) < 1e-9 and best["metricValue"] == min(p["metricValue"] for p in points) and len(points) == 4
    model, best, points = learning.logistic_grid(rows, rows, "p", "y", threshold=None, grid={"regParam": [0.01, 5.0], "maxIter": [5, 20]})
    share = model.transform(rows).agg(F.avg((F.col("p") == F.col("y")).cast("int"))).first()[0]
    assert abs(share - best["metricValue"]) < 1e-12 and len(points) == 4


def test_ensemble_grid_stops_at_the_threshold(rows):
    _, best, points = learning.forest_grid(rows, "p", "y", threshold=0.5, grid={"maxDepth": [2, 4, 6], "numTrees": [2, 3]})
    assert len(points) == 1 and best == points[0]


def test_stack_has_25_outputs_of_full_models(spark, monkeypatch):
    monkeypatch.setattr(learning, "_boosted", lambda df, **params: params)
    models = learned.first_level(spark.createDataFrame([(1, [0.0])], "score int, features array<double>"))
    assert [len(m) for m in models] == [5, 10, 10] and not any(p for m in models for p in m.values())


def quick_first_level(seen):
    """A first level that learns each row by heart: by the key hidden in its features."""
    def fit(rows):
        known = {r.features[0]: r.score for r in rows.select("features", "score").collect()}
        seen.append(set(known))
        tree = DecisionTreeClassifier(featuresCol="features", labelCol="_y", predictionCol="_p", maxDepth=10)
        one = lambda of: tree.fit(rows.withColumn("_y", (F.col("score") == of).cast("double")))
        return {1: one(1), 2: one(2)}, {(1, 2): one(2)}, {(1, 2): one(1)}
    return fit


def test_cross_fitting_scores_no_row_by_a_model_that_saw_it(spark):
    r = random.Random(9)
    noise = spark.createDataFrame([(i, r.choice([1, 2]), Vectors.dense([float(i), r.random()])) for i in range(200)], ["id", "score", "features"]).coalesce(1)
    seen = []
    stacked = learning.cross_fitted_stack(noise, "id", "score", quick_first_level(seen), folds=2)
    rows = stacked.select("id", "_fold", "score", vector_to_array("features_2").alias("f")).collect()
    assert len(rows) == 200 and len(seen) == 2 and not seen[0] & seen[1]
    assert all(float(x.id) not in seen[x._fold] for x in rows)  # fold f is scored by the models of seen[f]
    guessed = sum((x.f[0] == 1.0) == (x.score == 1) for x in rows) / 200
    assert 0.35 < guessed < 0.65  # pure noise: chance
    leaky = learning.stack(noise, "id", *quick_first_level([])(noise))
    known = [(x.score, x.f) for x in leaky.select("score", vector_to_array("features_2").alias("f")).collect()]
    assert sum((f[0] == 1.0) == (s == 1) for s, f in known) / 200 > 0.65  # what the plain stack would report
    scores = learning.cross_fitted_scores(noise, "id", "score", quick_first_level([]), folds=2)
    both = scores.join(noise.select("id", F.col("score").alias("truth")), "id")
    assert scores.count() == 200 and 0.35 < both.filter("score = truth").count() / 200 < 0.65


def test_sentiment_learns_from_words_and_counts_tokens(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        good = i % 2
        rows.append((i, " ".join(r.choice(["good", "great"] if good else ["bad", "poor"]) if r.random() < 0.4 else r.choice(["film", "scene", "The", "a"]) for _ in range(12)) + ".", float(good)))
    df = spark.createDataFrame(rows + [(900, "", 1.0)], "id long, text string, label double")
    for form in ("bag_of_words", "tf_idf"):
        scored = learning.sentiment_flow(df.filter("id < 200"), df.filter("id >= 200"), "text", "label", "id", form, regParam=0.01)
        found = learning.test_metrics(scored, "label").first()
        pairs = [(x.score, x.label) for x in scored.collect()]
        good, bad = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
        by_pairs = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
        assert abs(found.auc - by_pairs) < 1e-9 and found.accuracy > 0.9
        assert {x.num_tokens for x in scored.filter("id < 900").collect()} == {12.0} and scored.filter("id = 900").first().num_tokens == 0


def test_side_by_side_keeps_order_and_stops(spark):
    begun = []
    fits = [lambda i=i: begun.append(i) or i for i in range(20)]
    assert list(learning.side_by_side(spark, fits)) == list(range(20))
    begun.clear()
    some = learning.side_by_side(spark, fits)
    assert next(some) == 0
    some.close()
    assert max(begun) < 4


def test_registry_holds_all_pairs(spark, folder):
    rows = plans.all_queries()["s11_model_registry"](spark, folder)
    labels = sorted(r.label for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("label").distinct().collect())
    assert len(labels) > 3 and rows.columns == ["vec_id", "label", *[f"p{a}{b}" for a, b in combinations(labels, 2)]]
    assert all(v in (0.0, 1.0) for r in rows.collect() for v in r[2:])


def test_regression_rows_are_spread_and_carry_no_slot_names(spark, monkeypatch):
    seen = []

    class Watched(learning.LogisticRegression):
        def fit(self, df):
            seen.append((df.rdd.getNumPartitions(), df.schema["features"].metadata))
            return super().fit(df)

    monkeypatch.setattr(learning, "LogisticRegression", Watched)
    df = spark.createDataFrame([(i, "good day" if i % 2 else "bad day", float(i % 2)) for i in range(40)], "id long, text string, label double").coalesce(1)
    for form in ("bag_of_words", "tf_idf"):
        learning.sentiment_flow(df.filter("id < 30"), df.filter("id >= 30"), "text", "label", "id", form, maxIter=2)
    assert seen == [(spark.sparkContext.defaultParallelism, {})] * 2
