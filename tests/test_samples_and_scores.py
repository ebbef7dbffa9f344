"""Samplers, curves, coherence, lookups, sources, models."""

import itertools
import math
import random

import pytest
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from wordtrail import session
from wordtrail.functions.hashing import unit_hash
from wordtrail.operators import evaluate, features, learning, lookup, profile, sampling, tokens
from wordtrail.session import cut_lineage, shared_path
from wordtrail.sources import files, models, pages


@pytest.fixture(scope="module")
def scored(spark):
    return spark.range(6000).select("id", F.when(F.col("id") % 10 < 6, 1).when(F.col("id") % 10 < 9, 2)
                                    .otherwise(F.floor(F.col("id") / 10) % 4 + 3).cast("int").alias("score")).cache()


def counts(df, column="score"):
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


def test_samples_do_not_depend_on_partitions(scored):
    for sample in (lambda df: sampling.bernoulli(df, "id", 0.3),
                   lambda df: sampling.balanced_pair(df, "id", "score", (1, 2)),
                   lambda df: sampling.uniform_sets(df, "id", "score", 2, [1, 2, 3, 4, 5, 6], 0.2)):
        a, b = sample(scored), sample(scored.repartition(13))
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_seed_gives_another_draw(scored):
    a, b = sampling.bernoulli(scored, "id", 0.5), sampling.bernoulli(scored, "id", 0.5, seed="x")
    assert 0.2 < a.intersect(b).count() / 6000 < 0.3


def test_class_balancing(scored):
    pair = counts(sampling.balanced_pair(scored, "id", "score", (1, 2)))
    assert pair[2] == 1800 and abs(pair[1] - 1800) < 200
    loose = counts(sampling.loose_pair(scored, "id", "score", (1, 3)))
    assert abs(loose[1] - 2.2 * loose[3]) < 100
    binary = sampling.binary_against_rest(scored, "id", "score", 2, [1, 2, 3, 4, 5, 6])
    assert counts(binary)[2] == 1800 and abs(counts(binary)[1] - 360) < 80
    assert set(counts(binary, "binary_score")) == {0, 2}
    far = sampling.target_against_far(scored, "id", "score", 1, [1, 2, 3, 4, 5, 6])
    assert set(counts(far)) == {1, 3, 4, 5, 6} and counts(far, "score_1")[1] < 900


def test_uniform_sets_hold_target_and_cover_the_largest_class(scored):
    sets = sampling.uniform_sets(scored, "id", "score", 2, [1, 2, 3, 4, 5, 6], 0.2).cache()
    ids = [r[0] for r in sets.select("sample_id").distinct().collect()]
    targets = sets.filter("score = 2").groupBy("sample_id").count().collect()
    assert all(r["count"] == 1800 for r in targets) and len(targets) == len(ids) > 5
    assert sets.filter("score = 1").select("id").distinct().count() == sets.filter("score = 1").count() == 3600


def test_area_under_roc(spark):
    rng = random.Random(1)
    rows = [(float(rng.randrange(40)), rng.randrange(2)) for _ in range(400)] + [(7.0, 1)] * 200
    df = spark.createDataFrame(rows, "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    brute = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(evaluate.area_under_roc(df, "s", "y", piece_rows=40).first().auc - brute) < 1e-9
    points = evaluate.curve_points(df, "s", "y", piece_rows=40).orderBy("score").collect()
    for r in points:
        tp, fp = sum(p >= r.score for p in pos), sum(n >= r.score for n in neg)
        assert (r.recall, r.fpr, r.precision) == pytest.approx((tp / len(pos), fp / len(neg), tp / (tp + fp)))
    library = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0)
    assert abs(library.evaluate(df.withColumn("y", F.col("y").cast("double"))) - brute) < 1e-9


def test_confusion_matrix_with_missing_prediction(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (1, 1)], "t int, p int")
    matrix = evaluate.confusion_matrix(df, "t", "p", evaluate.true_labels(df, "t")).orderBy("t").collect()
    assert [tuple(r) for r in matrix] == [(0, 0, 1), (1, 0, 2)]
    assert evaluate.binary_metrics(df, "t", "p").first().precision_0 is None


def test_coherence_matches_all_pairs(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    vectors = {w: [rng.uniform(-1, 1) for _ in range(4)] for w in words}
    vectors["w3"] = [0.0] * 4
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 60])))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    stats = profile.statistics(profile.annotated_rows(df, "doc_id", "text", []), "doc_id", 10)
    table = spark.createDataFrame(list(vectors.items()), "word string, vector array<double>")
    got = {r.doc_id: (r.text_coherence_5, r.text_coherence_10)
           for r in profile.coherence(stats, "doc_id", table, sizes=[5, 10]).collect()}

    def cos(a, b):
        size = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    assert len(got) == len(docs)
    for doc_id, text in docs:
        ranked = sorted(set(text.split()), key=lambda w: (-text.split().count(w), w))
        for n, value in zip((5, 10), got[doc_id]):
            pairs = list(itertools.combinations(ranked[:n], 2))
            expected = sum(cos(vectors[a], vectors[b]) for a, b in pairs) / len(pairs) if pairs else 0.0
            assert value == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_salted_and_broadcast_lookups_agree(spark, how):
    rows = spark.range(500).select("id", F.when(F.col("id") < 300, "the").otherwise(F.concat(F.lit("w"), F.col("id"))).alias("token"))
    table = spark.createDataFrame([("the", 1), ("w350", 2)], "token string, n int")
    small = lookup.lookup_join(rows, table, "token", ["id"], how)
    salted = lookup.lookup_join(rows, table, "token", ["id"], how, limit=1)
    assert small.exceptAll(salted).isEmpty() and salted.exceptAll(small).isEmpty()


def test_top_items_ties_by_first_position(spark):
    df = spark.createDataFrame([(1, ["b", "a", "a", "b", "c"]), (2, ["z"])], "id int, v array<string>")
    got = tokens.top_items(df, "id", F.col("v"), 2).orderBy("id", "rank").collect()
    assert [(r.id, r.item, r.n) for r in got] == [(1, "b", 2), (1, "a", 2), (2, "z", 1)]


def test_csv_with_line_breaks_and_quotes(spark):
    rows = [("a", 'He said "no",\n\nthen left.'), ("b", "plain"), ("c", " spaced ")]
    path = shared_path(spark, "t")
    files.write_csv(spark.createDataFrame(rows, "essay_id string, full_text string"), path)
    back = files.read_csv(spark, path, "essay_id string, full_text string", multiline=True)
    assert sorted(map(tuple, back.collect())) == rows


def test_text_lines_and_first_lines(spark):
    path = shared_path(spark, "t")
    files.write_lines(spark.createDataFrame([("first\nsecond",)], "t string").coalesce(1), "t", path)
    files.write_lines(spark.createDataFrame([("third",)], "t string").coalesce(1), "t", path, append=True)
    assert sorted(r.value for r in files.read_lines(spark, path).collect()) == ["first", "second", "third"]
    assert sorted(r.line for r in files.first_lines(spark, path).collect()) == ["first", "third"]


def test_log_mean(spark):
    lines = spark.createDataFrame([("acc_12 : 0.5",), ("acc_13:0.7",), ("other: x",), ("",)], "value string")
    assert files.log_mean(lines, "acc").first().mean == pytest.approx(0.6)
    assert files.log_mean(lines, "none").first().mean is None


def test_empty_table(spark):
    table = files.empty_table(spark, ["a", "b"])
    assert table.count() == 0 and [t for _, t in table.dtypes] == ["float", "float"]


def test_pages(spark):
    df = spark.createDataFrame([(1, "one\ftwo\fthree"), (2, "only")], "id int, text string")
    assert [tuple(r) for r in pages.copy_pages(df, "id", "text", [1, 3]).orderBy("id", "page_no").collect()] == [
        (1, 1, "one"), (1, 2, "three"), (2, 1, "only")]
    assert [r.pages for r in pages.page_counts(df, "id", "text").orderBy("id").collect()] == [3, 1]


def test_checkpoint_keeps_rows(spark):
    assert cut_lineage(spark.range(10).filter("id > 3")).count() == 6


def test_model_registry(spark):
    rows = spark.createDataFrame([(Vectors.dense(float(i)), float(i > 4)) for i in range(10)], ["features", "label"])
    fitted = LogisticRegression(maxIter=5).fit(rows)
    base = shared_path(spark, "m")
    models.save_models(spark, base, {"sep_12_a": fitted, "sep_13_a": fitted, "other": fitted})
    assert sorted(models.load_models(spark, base, LogisticRegressionModel, "sep")) == ["sep_12_a", "sep_13_a"]
    models.save_models(spark, base, {"sep_12": fitted, "sep_13": fitted})
    pairs = models.load_pair_models(spark, base, LogisticRegressionModel, [(1, 2), (1, 3)], "sep")
    assert {k: len(v) for k, v in pairs.items()} == {(1, 2): 1, (1, 3): 1}


def test_shared_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_base", lambda _: f"file://{tmp_path}")
    spark.range(3).write.parquet(session.shared_path(spark, "some"))
    (tmp_path / "kept").mkdir()
    session.clear_shared(spark)
    assert [f.name for f in tmp_path.iterdir()] == ["kept"]
    session.clear_shared(spark)  # nothing left is no error


def test_sketched_curve_stays_within_its_error(spark):
    r = random.Random(8)
    rows = [(r.gauss(1.0 if y else 0.0, 1.0), y) for y in (int(r.random() < 0.2) for _ in range(20_000))] + [(None, 1), (0.5, None)]
    df = spark.createDataFrame(rows, "s double, y int")
    exact = evaluate.area_under_roc(df.filter("s IS NOT NULL AND y IS NOT NULL"), "s", "y").first().auc
    found = evaluate.sketched_curve(df.repartition(5), "s", "y").first()
    assert abs(found.auc - exact) < 2 * evaluate.sketch_error() + 1 / 500 and found.positives + found.negatives == 20_000
    bad = sorted(s for s, y in rows if y == 0)
    good = sorted(s for s, y in rows if y == 1 and s is not None)
    for p in found.curve[::100]:
        at = good[min(int((1 - p.recall) * len(good)), len(good) - 1)]
        assert abs(p.fpr - sum(b >= at for b in bad) / len(bad)) < 3 * evaluate.sketch_error() + 0.005
    assert evaluate.sketched_curve(df.filter("y = 1"), "s", "y").first().auc is None
    plan = evaluate.sketched_curve(df, "s", "y")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") <= 2  # the one pass, or its reuse


@pytest.mark.parametrize("bits", [2, 16])
def test_exact_samples_keep_the_wanted_number(spark, bits):
    sizes = {"a": 500, "b": 90, "c": 7}
    df = spark.createDataFrame([(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)] + [("none", None)], "k string, label string")
    asked = {"a": 123, "b": 90, "c": 20}

    def wanted(own):
        return own.withColumn("wanted", F.create_map(*[F.lit(x) for pair in asked.items() for x in pair])[F.col("label")])

    kept = sampling.exact_samples(df, "k", "label", wanted, bits=bits)
    assert dict(kept.groupBy("label").count().collect()) == {"a": 123, "b": 90, "c": 7} and kept.columns == ["k", "label"]
    again = sampling.exact_samples(df.repartition(7), "k", "label", wanted, bits=16)
    assert {r.k for r in kept.collect()} == {r.k for r in again.collect()}
    pair = sampling.exact_pair(df, "k", "label", ("a", "b"))
    assert dict(pair.groupBy("label").count().collect()) == {"a": 90, "b": 90}
    assert sampling.exact_pair(df, "k", "label", ("a", "missing")).count() == 0 and sampling.exact_pair(df.limit(0), "k", "label", ("a", "b")).count() == 0
    rest = sampling.exact_against_rest(df, "k", "label", "b")
    assert dict(rest.groupBy("label").count().collect()) == {"a": 45, "b": 90, "c": 7}


def test_grid_search_direction_and_early_stop(spark):
    rows = spark.createDataFrame([(Vectors.dense(float(i)), 2.0 * i) for i in range(20)], ["features", "label"])
    seen = []

    class Counting(RegressionEvaluator):
        def evaluate(self, dataset, params=None):
            seen.append(1)
            return super().evaluate(dataset, params)

    grid = {"regParam": [100.0, 0.0, 10.0]}
    model, best = learning.grid_search(LinearRegression(), grid, rows, rows, Counting(metricName="rmse"))
    assert best["regParam"] == 0.0 and len(seen) == 3
    seen.clear()
    learning.grid_search(LinearRegression(), grid, rows, rows, Counting(metricName="rmse"), threshold=1.0)
    assert len(seen) == 2


def test_tf_idf_matches_the_library(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "b")], "id int, text string")
    counts_ = tokens.term_counts(df, "id", F.split("text", " "))
    got = {(r.id, r.term): r.tf_idf for r in features.tf_idf(counts_, "id", df).collect()}
    assert got[1, "a"] == pytest.approx(2 * math.log(4 / 2)) and got[2, "b"] == pytest.approx(0.0)
    hashed = features.hashed_tf_idf(df.select("id", F.split("text", " ").alias("t")), "t", slots=1 << 18)
    weights = sorted(w for r in hashed.collect() for w in r.features.values)
    assert weights == pytest.approx(sorted(got.values()))


def test_unit_hash_range(spark):
    low, high = spark.range(5000).select(unit_hash("id").alias("u")).agg(F.min("u"), F.max("u")).first()
    assert 0 <= low < 0.01 and 0.99 < high < 1
