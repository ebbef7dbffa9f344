"""k-means for many k at once against numpy's own steps and the library's silhouette."""

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import functions as F

from wordtrail.operators import features, sweep


@pytest.fixture(scope="module")
def rows(spark):
    made = np.random.default_rng(2)
    x = np.concatenate([made.normal(c, 0.5, size=(60, 3)) for c in (0, 3, 7)])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, f array<double>").cache()


def lloyd(x, centres, rounds, tolerance):
    for n in range(1, rounds + 1):
        at = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[at == i].mean(axis=0) if (at == i).any() else centres[i] for i in range(len(centres))])
        moved = np.sqrt(((new - centres) ** 2).sum(axis=1)).max()
        centres = new
        if moved <= tolerance:
            break
    return centres, n


def silhouette(x, at):
    far, out = ((x[:, None] - x) ** 2).sum(axis=2), []
    for i in range(len(x)):
        means = {c: far[i][at == c].sum() / max((at == c).sum() - (c == at[i]), 1) for c in set(at)}
        a, b = means.pop(at[i]), min(means.values())
        out.append(0 if (at == at[i]).sum() == 1 else (b - a) / max(a, b))
    return np.mean(out)


def test_all_k_together_equal_separate_runs_and_numpy(spark, rows):
    x, df = rows
    together = {r.clusters: r for r in sweep.kmeans_sweep(df, [2, 3, 5], "f").collect()}
    start = sweep.first_centres(df.filter("f IS NOT NULL"), "f", [2, 3, 5])
    for k in (2, 3, 5):
        (alone,) = sweep.kmeans_sweep(df.repartition(3), [k], "f").collect()
        centres, rounds = lloyd(x, start[k], 20, 1e-4)
        far = ((x[:, None] - centres) ** 2).sum(axis=2)
        assert abs(together[k].cost - alone.cost) < 1e-6 and abs(together[k].cost - far.min(axis=1).sum()) < 1e-6
        assert together[k].rounds == alone.rounds == rounds
        assert abs(together[k].silhouette - silhouette(x, far.argmin(axis=1))) < 1e-9
    at = lloyd(x, start[3], 20, 1e-4)[0]
    labels = ((x[:, None] - at) ** 2).sum(axis=2).argmin(axis=1)
    said = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, labels)], "f array<double>, c int")
    theirs = ClusteringEvaluator(predictionCol="c", featuresCol="v").evaluate(said.select(features.to_vector("f").alias("v"), F.col("c").cast("double")))
    assert abs(theirs - together[3].silhouette) < 1e-9


def test_few_and_no_rows(spark, rows):
    _, df = rows
    same = spark.createDataFrame([([1.0, 2.0],)] * 5 + [([3.0, 4.0],)], "f array<double>")
    assert [r.clusters for r in sweep.kmeans_sweep(same, [2, 3], "f").collect()] == [2]
    assert sweep.kmeans_sweep(df.limit(0), [2], "f").count() == 0
