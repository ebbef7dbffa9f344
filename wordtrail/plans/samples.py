"""Sampling and class balancing (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordtrail.operators import sampling
from wordtrail.plans.registry import hash_sql, query, unit_sql

# The order priorities stand in for the classes 1..5.
SCORE = "cast(substr(o_orderpriority, 1, 1) AS integer)"
SCORED = f"s AS (SELECT o_orderkey, {SCORE} AS score, {unit_sql('o_orderkey')} AS u FROM orders)"
CLASSES = [1, 2, 3, 4, 5]


def scored(t):
    return t.orders.select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("score"))


@query("m1_bernoulli_sample", f"SELECT doc_id, lang FROM documents WHERE {unit_sql('doc_id')} < 0.25")
def bernoulli_sample(t):
    return sampling.bernoulli(t.documents.select("doc_id", "lang"), "doc_id", 0.25)


@query("m1_native_sample")
def native_sample(t):
    return t.documents.select("doc_id", "lang").sample(False, 0.25, 7)


@query("m2_train_test_split", f"""
SELECT doc_id, CASE WHEN {unit_sql('doc_id')} < 0.75 THEN 'train' ELSE 'test' END AS split FROM documents""")
def train_test_split(t):
    return sampling.with_split(t.documents.select("doc_id"), "doc_id")


@query("m2_native_split")
def native_split(t):
    train, test = t.documents.select("doc_id").randomSplit([0.75, 0.25], 7)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("m3_balanced_pair", """
WITH s AS (SELECT doc_id, quality, %s AS u FROM labels),
n AS (SELECT count(*) FILTER (quality = 0)::double AS a, count(*) FILTER (quality = 1)::double AS b FROM s)
SELECT doc_id, quality FROM s, n WHERE u < CASE WHEN quality = 0 THEN b / a ELSE a / b END""" % unit_sql("doc_id"))
def balanced_pair(t):
    return sampling.balanced_pair(t.labels.select("doc_id", "quality"), "doc_id", "quality", (0, 1))


@query("m3_exact_pair", f"""
WITH s AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {hash_sql('doc_id')}, doc_id) AS r FROM labels WHERE quality IN (0, 1)),
n AS (SELECT least(count(*) FILTER (quality = 0), count(*) FILTER (quality = 1)) AS n FROM s)
SELECT doc_id, quality FROM s, n WHERE r <= n""")
def exact_pair(t):
    return sampling.exact_pair(t.labels.select("doc_id", "quality"), "doc_id", "quality", (0, 1))


@query("m4_target_against_far", f"""
WITH {SCORED}, n AS (SELECT count(*) FILTER (score = 2)::double AS a, count(*) FILTER (score IN (4, 5))::double AS b FROM s)
SELECT o_orderkey, score, CASE WHEN score = 2 THEN 2 ELSE 0 END AS score_2 FROM s, n
WHERE score = 2 OR score IN (4, 5) AND u < CASE WHEN 1.5 * (a / b) < 1 THEN 1.5 * (a / b) ELSE a / b END""")
def target_against_far(t):
    return sampling.target_against_far(scored(t), "o_orderkey", "score", 2, CLASSES, 1.5)


@query("m5_loose_pair", """
WITH s AS (SELECT doc_id, quality, %s AS u FROM labels),
n AS (SELECT count(*) FILTER (quality = 0)::double AS a, count(*) FILTER (quality = 1)::double AS b FROM s)
SELECT doc_id, quality FROM s, n WHERE u < CASE WHEN quality = 0 THEN CASE WHEN a > 3 * b THEN 2.2::double * b / a ELSE 1 END
  ELSE CASE WHEN b > 3 * a THEN 2.2::double * a / b ELSE 1 END END""" % unit_sql("doc_id"))
def loose_pair(t):
    return sampling.loose_pair(t.labels.select("doc_id", "quality"), "doc_id", "quality", (0, 1))


@query("m6_binary_against_rest", f"""
WITH {SCORED}, n AS (SELECT score, count(*)::double AS n FROM s GROUP BY 1),
q AS (SELECT floor(n / 4) AS q FROM n WHERE score = 3)
SELECT o_orderkey, s.score, CASE WHEN s.score = 3 THEN 3 ELSE 0 END AS binary_score
FROM s JOIN n ON s.score = n.score, q WHERE s.score = 3 OR u < least(n, q) / n""")
def binary_against_rest(t):
    return sampling.binary_against_rest(scored(t), "o_orderkey", "score", 3, CLASSES)


@query("m6_exact_against_rest", f"""
WITH s AS (SELECT o_orderkey, {SCORE} AS score, row_number() OVER (PARTITION BY {SCORE} ORDER BY {hash_sql('o_orderkey')}, o_orderkey) AS r FROM orders),
q AS (SELECT count(*) FILTER (score = 3) // (count(DISTINCT score) - 1) AS q FROM s)
SELECT o_orderkey, score, CASE WHEN score = 3 THEN 3 ELSE 0 END AS binary_score FROM s, q WHERE score = 3 OR r <= q""")
def exact_against_rest(t):
    return sampling.exact_against_rest(scored(t), "o_orderkey", "score", 3)


@query("m6_native_stratified")
def native_stratified(t):
    return scored(t).sampleBy("score", {c: 0.25 for c in CLASSES} | {3: 1.0}, 7)


@query("m7_uniform_sets", f"""
WITH b AS (SELECT event_id, event_type AS label, {unit_sql('event_id')} AS u FROM events),
n AS (SELECT label, count(*) AS n FROM b GROUP BY 1),
t AS (SELECT count(*) AS tn FROM b WHERE label = 'purchase' AND u < 0.25),
g AS (SELECT label, CASE WHEN n > tn THEN floor(n / tn::double)::integer ELSE 1 END AS ng FROM n, t WHERE label <> 'purchase'),
mx AS (SELECT max(ng) AS mg FROM g),
ids AS (SELECT unnest(range(0, mg))::integer AS j FROM mx),
k AS (SELECT event_id, b.label, floor(u * ng)::integer AS bk, ng FROM b JOIN g ON b.label = g.label)
SELECT event_id, label, j AS sample_id FROM k, ids
WHERE bk = CASE WHEN j < ng THEN j ELSE floor({unit_sql("label || '#' || j")} * ng)::integer END
UNION ALL SELECT event_id, label, j FROM b, ids WHERE label = 'purchase'""")
def uniform_sets(t):
    events = t.events.select("event_id", F.col("event_type").alias("label"))
    return sampling.uniform_sets(events, "event_id", "label", "purchase",
                                 ["click", "error", "purchase", "signup", "view"], 0.25)


@query("m8_batches", f"""
SELECT floor({unit_sql('doc_id')} * 10)::integer AS batch, count(*) AS n, sum(n_chars)::bigint AS chars
FROM documents GROUP BY 1""")
def batches(t):
    batched = sampling.with_batch(t.documents.select("doc_id", "n_chars"), "doc_id", 10)
    return batched.groupBy("batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
