"""Votes, cascades and pairwise deciders (E).

The models are deterministic scorers over embedding components, so that SQL can follow them;
the fitted-model forms are in :mod:`wordtrail.plans.learned`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wordtrail.operators import votes
from wordtrail.plans.formulas import scorer, scorer_array, scorer_array_sql, scorer_sql
from wordtrail.plans.registry import query

PAIRS = [(1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)]


def component(k: int):
    return F.get("embedding", F.lit(k - 1)).cast("double")


def binary(k: int):
    """0/1 output of a pair or yes/no scorer."""
    return (component(k) > 0).cast("int")


def binary_sql(k: int) -> str:
    return f"(CASE WHEN embedding[{k}] > 0 THEN 1 ELSE 0 END)"


def picked_label_sql(array: str, order: str) -> str:
    """Top label per row of an array of labels, by an ORDER BY over (l, n, first)."""
    return f"""WITH u AS (SELECT vec_id, unnest(v) AS l, generate_subscripts(v, 1) AS p FROM (SELECT vec_id, {array} AS v FROM embeddings)),
c AS (SELECT vec_id, l, count(*) AS n, min(p) AS first FROM u GROUP BY 1, 2)
SELECT vec_id, l, n FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY {order}) AS r FROM c) WHERE r = 1"""


@query("e1_mean_vote", f"""
SELECT vec_id, round(({' + '.join(scorer_sql(k) for k in range(1, 5))}) / 4.0)::integer AS score FROM embeddings""")
def mean_vote(t):
    return t.embeddings.select("vec_id", votes.mean_vote(*[scorer(k) for k in range(1, 5)]).alias("score"))


@query("e2_cascade", f"""
SELECT vec_id, CASE WHEN {scorer_sql(1)} = 3 THEN 3 WHEN {scorer_sql(2)} = 2 THEN 2 WHEN {scorer_sql(3)} = 4 THEN 4 ELSE 1 END AS score
FROM embeddings""")
def cascade(t):
    return t.embeddings.select("vec_id", votes.cascade([scorer(1), scorer(2), scorer(3)], [3, 2, 4, 1]).alias("score"))


@query("e3_first_valid", f"""
WITH p AS (SELECT vec_id, {scorer_sql(1)} * {binary_sql(11)} AS a, {scorer_sql(2)} * {binary_sql(12)} AS b, {scorer_sql(3)} AS c FROM embeddings)
SELECT vec_id, CASE WHEN a BETWEEN 1 AND 6 THEN a WHEN b BETWEEN 1 AND 6 THEN b WHEN c = 4 THEN c ELSE 1 END AS score FROM p""")
def first_valid(t):
    predictions = [scorer(1) * binary(11), scorer(2) * binary(12), scorer(3)]
    return t.embeddings.select("vec_id", votes.first_valid(predictions, [3, 2, 4, 1]).alias("score"))


@query("e4_one_vs_rest", """
WITH p AS (SELECT vec_id, [embedding[2]::double, embedding[4]::double, embedding[6]::double] AS p FROM embeddings)
SELECT vec_id, [3, 1, 2][list_position(p, list_max(p))] AS label, round(list_max(p), 6) AS sure FROM p""")
def one_vs_rest(t):
    vectors = [F.array(component(2 * k - 1), component(2 * k)) for k in (1, 2, 3)]
    own = F.array(*[F.try_element_at(v, F.lit(-1)) for v in vectors])
    return t.embeddings.select("vec_id", votes.own_class_vote(vectors, [3, 1, 2]).alias("label"),
                               F.round(F.array_max(own), 6).alias("sure"))


def metadata(first: int, labels: list[str]):
    """Label-to-probability map as annotators keep it: strings, with a sentence entry."""
    entries = [F.lit("sentence"), F.lit("0")]
    for i, label in enumerate(labels):
        entries += [F.lit(label), component(first + i).cast("string")]
    return F.create_map(*entries)


@query("e5_one_vs_rest_metadata", """
WITH p AS (SELECT vec_id, [embedding[2]::double, embedding[4]::double, embedding[6]::double] AS p FROM embeddings)
SELECT vec_id, [1.0, 2.0, 5.0][list_position(p, list_max(p))]::double AS label FROM p""")
def one_vs_rest_metadata(t):
    maps = [metadata(first, ["0", label]) for first, label in ((1, "1"), (3, "2"), (5, "5"))]
    return t.embeddings.select("vec_id", votes.own_label_vote(maps).alias("label"))


@query("e6_map_soft_vote", """
WITH s AS (SELECT vec_id, [embedding[3]::double + embedding[6]::double + embedding[9]::double,
  embedding[1]::double + embedding[4]::double + embedding[7]::double, embedding[2]::double + embedding[5]::double + embedding[8]::double] AS s FROM embeddings)
SELECT vec_id, [1, 10, 2][list_position(s, list_max(s))] AS label FROM s""")
def map_soft_vote(t):
    maps = [metadata(first, ["10", "2", "1"]) for first in (1, 4, 7)]
    return t.embeddings.select("vec_id", votes.map_soft_vote(maps, ["10", "2", "1"]).alias("label"))


@query("e7_soft_vote", """
WITH s AS (SELECT vec_id, list_transform(range(1, 5), lambda k: embedding[k]::double + embedding[k + 4]::double + embedding[k + 8]::double) AS s FROM embeddings)
SELECT vec_id, (list_position(s, list_max(s)) - 1)::integer AS class FROM s""")
def soft_vote(t):
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", votes.soft_vote(*[F.slice(doubles, 1 + 4 * j, 4) for j in range(3)]).alias("class"))


NEIGHBOURS = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]


def _refine_sql() -> str:
    decide = lambda i: f"(CASE WHEN embedding[{20 + i}] > 0 THEN {NEIGHBOURS[i][0]} ELSE {NEIGHBOURS[i][1]} END)"
    whens = " ".join(f"WHEN s IN {NEIGHBOURS[i]} AND {decide(i)} = {NEIGHBOURS[i][0]} THEN {NEIGHBOURS[i][0]}" for i in range(4))
    return f"WITH p AS (SELECT *, {scorer_sql(1)} AS s FROM embeddings) SELECT vec_id, s, CASE {whens} ELSE {decide(4)} END AS score FROM p"


@query("e8_refine_neighbours", _refine_sql())
def refine_neighbours(t):
    decisions = [F.when(component(20 + i) > 0, pair[0]).otherwise(pair[1]) for i, pair in enumerate(NEIGHBOURS)]
    scored = t.embeddings.withColumn("s", scorer(1))
    return scored.select("vec_id", "s", votes.refine_neighbours("s", NEIGHBOURS, decisions).alias("score"))


@query("e9_hard_vote", f"SELECT vec_id, l AS score FROM ({picked_label_sql(scorer_array_sql(7), 'n DESC, l')})")
def hard_vote(t):
    return t.embeddings.select("vec_id", votes.hard_vote(scorer_array(7)).alias("score"))


@query("e10_weighted_hard_vote", f"""
SELECT vec_id, l::double AS label, round(n * 0.75, 4)::double AS weight FROM ({picked_label_sql(scorer_array_sql(7), 'n DESC, l')})""")
def weighted_hard_vote(t):
    best = t.embeddings.select("vec_id", votes.weighted_hard_vote(scorer_array(7), 0.75).alias("v"))
    return best.select("vec_id", "v.label", F.round("v.weight", 4).alias("weight"))


@query("e11_committee", f"""
SELECT vec_id, l::double AS label, n::double AS weight FROM ({picked_label_sql(scorer_array_sql(5, 30), 'n DESC, l')})""")
def committee(t):
    best = t.embeddings.select("vec_id", votes.committee_vote([scorer(k) for k in range(30, 35)]).alias("v"))
    return best.select("vec_id", "v.label", "v.weight")


@query("e12_vote_of_votes", f"""
WITH u AS (SELECT vec_id, unnest({scorer_array_sql(4)}) % 4 AS l, unnest([1, 2, 3, 4]) AS k, unnest([1.0, 0.5, 0.75, 0.25]) AS w FROM embeddings),
c AS (SELECT vec_id, l, sum(w) AS w FROM u WHERE l <> 0 GROUP BY 1, 2),
b AS (SELECT vec_id, l FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, l) AS r FROM c) WHERE r = 1)
SELECT e.vec_id, coalesce(b.l, 1)::double AS score FROM embeddings e LEFT JOIN b ON e.vec_id = b.vec_id""")
def vote_of_votes(t):
    pairs = F.array(*[F.struct((scorer(k) % 4).cast("double").alias("label"), F.lit(w).alias("weight"))
                      for k, w in zip(range(1, 5), (1.0, 0.5, 0.75, 0.25))])
    return t.embeddings.select("vec_id", votes.vote_of_votes(pairs).alias("score"))


@query("e13_mode", f"SELECT vec_id, l AS score FROM ({picked_label_sql(scorer_array_sql(7), 'n DESC, first')})")
def mode(t):
    return t.embeddings.select("vec_id", votes.mode_vote(scorer_array(7)).alias("score"))


def _winners_sql(first: int) -> str:
    return "[" + ", ".join(f"CASE WHEN embedding[{first + i}] > 0 THEN {b} ELSE {a} END" for i, (a, b) in enumerate(PAIRS)) + "]"


@query("e14_pairwise_vote", f"SELECT vec_id, l AS score FROM ({picked_label_sql(_winners_sql(11), 'n DESC, l')})")
def pairwise_vote(t):
    return t.embeddings.select("vec_id", votes.pairwise_vote([binary(11 + i) for i in range(10)], PAIRS).alias("score"))


@query("e15_pairs_for_key", f"""
WITH k AS (SELECT vec_id, CASE WHEN {scorer_sql(1)} = 6 THEN 0 ELSE {scorer_sql(1)} * 10 + {scorer_sql(2)} END AS key FROM embeddings),
p AS (SELECT unnest([{', '.join(f"'{a}-{b}'" for a, b in PAIRS)}]) AS pair)
SELECT k.vec_id, k.key, coalesce(string_agg(p.pair, ' ' ORDER BY p.pair), '') AS pairs FROM k
LEFT JOIN p ON k.key = 0 OR contains(k.key::varchar, p.pair[1]) OR contains(k.key::varchar, p.pair[3]) GROUP BY 1, 2""")
def pairs_for_key(t):
    key = F.when(scorer(1) == 6, F.lit(0)).otherwise(scorer(1) * 10 + scorer(2))
    keyed = t.embeddings.select("vec_id", key.alias("key"))
    shown = F.transform(votes.pairs_for("key", PAIRS), lambda p: F.concat_ws("-", F.transform(p, lambda x: x.cast("string"))))
    return keyed.select("vec_id", "key", F.array_join(shown, " ").alias("pairs"))


@query("e16_vote_share", f"""
SELECT vec_id, round(CASE WHEN l = 3 THEN n / 7.0 ELSE 1 - n / 7.0 END, 6)::double AS share FROM ({picked_label_sql(scorer_array_sql(7), 'n DESC, l')})""")
def vote_share(t):
    best = t.embeddings.select("vec_id", votes.weighted_hard_vote(scorer_array(7)).alias("v"))
    return best.select("vec_id", F.round(votes.vote_share("v.label", "v.weight", 3, 7), 6).alias("share"))


@query("e17_pair_labels", f"""
SELECT vec_id, CASE WHEN embedding[11] > 0 THEN 5 ELSE 2 END AS label, {binary_sql(11)} AS code FROM embeddings""")
def pair_labels(t):
    labelled = t.embeddings.select("vec_id", votes.pair_label(binary(11), (2, 5)).alias("label"))
    return labelled.withColumn("code", votes.pair_code("label", (2, 5)))


@query("e18_excluding_vote", f"""
WITH a AS (SELECT vec_id, {_winners_sql(11)} AS v, list_filter([1, 2, 3, 4, 5], lambda l: l = 3
    OR l = 1 AND embedding[30] > 0 OR l = 2 AND embedding[31] > 0 OR l = 4 AND embedding[32] > 0 OR l = 5 AND embedding[33] > 0) AS ok FROM embeddings),
k AS (SELECT vec_id, ok, list_filter(v, lambda x: list_contains(ok, x)) AS kept FROM a),
u AS (SELECT vec_id, unnest(CASE WHEN len(kept) > 0 THEN kept ELSE ok END) AS l FROM k),
c AS (SELECT vec_id, l, count(*) AS n FROM u GROUP BY 1, 2)
SELECT vec_id, l AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, l) AS r FROM c) WHERE r = 1""")
def excluding_vote(t):
    winners = F.array(*[votes.pair_label(binary(11 + i), pair) for i, pair in enumerate(PAIRS)])
    allowed = votes.allowed_labels([binary(k) for k in range(30, 34)], [1, 2, 4, 5])
    rows = t.embeddings.select("vec_id", winners.alias("winners"), allowed.alias("allowed"))
    return rows.select("vec_id", votes.vote_within("allowed", "winners").alias("score"))
