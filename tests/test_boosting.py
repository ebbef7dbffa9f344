"""Boosted trees of the grids: those of MLlib, with small nodes finished in one task."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from wordtrail.operators import boosting, learning
from wordtrail.session import shared_base


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    made = []
    for i in range(360):
        x = [r.gauss(0, 1), float(r.randrange(3)), 7.0, r.choice([0.0, 0.0, r.random()])]
        z = x[0] * x[1] + x[3] + r.gauss(0, 0.5)
        made += [(Vectors.dense(x), z, float(z > 0.3))] * (1 + 3 * (i % 10 == 0))  # some rows come several times
    return spark.createDataFrame(made, ["features", "z", "y"]).coalesce(1).cache()


@pytest.mark.parametrize("small", [60, 10_000])
@pytest.mark.parametrize("kind, label", [(GBTRegressor, "z"), (GBTClassifier, "y")])
def test_trees_are_those_of_the_library(rows, monkeypatch, kind, label, small):
    monkeypatch.setattr(boosting, "SMALL_ROWS", (small, small))
    of = kind(labelCol=label, predictionCol="p", maxIter=3, maxDepth=7, seed=7)
    model = boosting.fit(of, rows.repartition(3, "z") if small < 10_000 else rows, [1, 3])
    theirs = of.fit(rows)
    for i, n in enumerate([1, 3]):
        both = learning.FirstTrees(model, n, "q").transform(learning.FirstTrees(theirs, n, "p").transform(rows))
        assert both.columns == [*rows.columns, "p", "q"]
        assert both.filter("abs(p - q) > 1e-9").isEmpty() and both.count() == rows.count()
        left = sorted((r[0], r[1]) for r in model.fitted.select(label, F.get("_predictions", F.lit(i))).collect())
        assert np.allclose(left, sorted((r[0], r[1]) for r in both.select(label, "p").collect()), atol=1e-9)
    model.forget()


def test_many_bins_and_pieces(rows, monkeypatch):
    monkeypatch.setattr(boosting, "SMALL_ROWS", (40, 40))
    for name, value in (("CELLS", 1), ("PIECE", 7), ("AT_ONCE", 2)):
        monkeypatch.setattr(boosting, name, value)
    of = GBTRegressor(labelCol="z", predictionCol="p", maxIter=2, maxDepth=6, maxBins=400, seed=7)
    both = learning.FirstTrees(boosting.fit(of, rows), 2, "q").transform(of.fit(rows).transform(rows))
    assert both.filter("abs(p - q) > 1e-9").isEmpty()


def test_grids_leave_deep_nodes_to_one_task(spark, rows, monkeypatch):
    """No sums of small nodes are sent: above them one job a level, none below, and no fit of MLlib's."""
    monkeypatch.setattr(GBTRegressor, "fit", None)
    monkeypatch.setattr(GBTClassifier, "fit", None)
    monkeypatch.setattr(boosting, "SMALL_ROWS", (100, 100))
    upper, seen = boosting._upper_levels, []
    base = f"{shared_base(spark).removeprefix('file://').removeprefix('file:')}/wordtrail"
    before = set(os.listdir(base)) if os.path.isdir(base) else set()

    def watched(*given):
        tree, small = upper(*given)
        seen.append((len(tree.value), [whole[0] for _, whole in small.values()]))
        return tree, small

    monkeypatch.setattr(boosting, "_upper_levels", watched)
    _, _, points = learning.boosted_regression_grid(rows, "p", "z", grid={"maxDepth": [3, 9], "maxIter": [1, 3]})
    assert len(points) == 4 and len(seen) == 6
    assert all(nodes < 40 and small and max(small) <= 100 for nodes, small in seen)
    _, _, points = learning.boosted_classifier_grid(rows, "p", "y", grid={"maxDepth": [3], "maxIter": [2]})
    assert len(points) == 1
    assert set(os.listdir(base)) == before  # no round's rows are left


def test_equal_rows_and_odd_sizes(spark):
    same = spark.createDataFrame([(Vectors.dense([1.0, 2.0]), float(i)) for i in range(4)], ["features", "z"])
    model = boosting.fit(GBTRegressor(labelCol="z", maxIter=2, maxDepth=4), same, [2])
    assert [r[0] for r in model.fitted.select("_predictions").collect()] == [[1.5]] * 4
    one = boosting.fit(GBTRegressor(labelCol="z", maxIter=2, maxDepth=0), same.limit(1), [1, 2])
    assert one.fitted.first()["_predictions"] == [0.0, 0.0]


def test_what_the_library_refuses_is_refused(spark):
    good = [(Vectors.dense([float(i)]), float(i % 2)) for i in range(6)]
    for bad in [(None, 1.0), (Vectors.dense([1.0]), None), (Vectors.dense([1.0]), 2.0), (Vectors.dense([math.nan]), 1.0), (Vectors.dense([1.0, 2.0]), 1.0)]:
        df = spark.createDataFrame([*good, bad], spark.createDataFrame(good, ["features", "y"]).schema)
        with pytest.raises(Exception, match="MUST"):
            boosting.fit(GBTClassifier(labelCol="y", maxIter=1), df)
    with pytest.raises(ValueError):
        boosting.fit(GBTRegressor(labelCol="y", subsamplingRate=0.5), spark.createDataFrame(good, ["features", "y"]))
    with pytest.raises(ValueError):
        boosting.fit(GBTRegressor(labelCol="y"), spark.createDataFrame(good, ["features", "y"]).limit(0))
