"""Document statistics in bounded tasks; coherence against numpy, with what travels."""

from itertools import combinations

import numpy as np

from wordtrail.operators import profile
from wordtrail.plans import texts
from wordtrail.plans.registry import Tables


def test_tasks_follow_the_pieces_of_the_documents(spark, tmp_path):
    rows = spark.range(400).selectExpr("id AS doc_id", "concat('the cat sat ', id) AS text")
    rows.repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    t = Tables(spark, str(tmp_path))
    pieces = t.documents.rdd.getNumPartitions()
    stats = texts.statistics(t)
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan and f"], {16 * pieces}" in plan
    assert stats.filter("num_words = 3").count() == 400


def test_coherence_gathers_stored_vectors_and_keeps_repeats(spark):
    table = {"a": [[1.0, 2.0]], "b": [[3.0, -1.0]], "c": [[0.5, 0.5], [0.0, 2.0]]}  # c stands twice
    vectors = spark.createDataFrame([(w, v) for w, vs in table.items() for v in vs], "word string, vector array<float>")
    docs = [(1, 10, ["a", "b", "c"]), (2, 20, ["a", "unknown"]), (3, 30, []), (None, 40, ["b", "a"])]
    stats = spark.createDataFrame([(k, n, [(-1, w) for w in words]) for k, n, words in docs], "id long, num_words long, top array<struct<negative:long,noun:string>>")
    found = profile.coherence(stats, "id", vectors, sizes=[2, 5])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sqrt" in plan.lower() and "sqrt" not in plan[plan.index("Join"):].lower()  # no unit vector of doubles travels
    got = {x.id: (x.num_words, x.text_coherence_2, x.text_coherence_5) for x in found.collect()}
    for key, n, words in docs:
        means = []
        for size in (2, 5):
            units = [np.array(v) / np.linalg.norm(v) for w in words[:size] for v in table.get(w, [])]
            means.append(np.mean([x @ y for x, y in combinations(units, 2)]) if len(units) > 1 else 0.0)
        assert got[key][0] == n and np.allclose(got[key][1:], means), key
