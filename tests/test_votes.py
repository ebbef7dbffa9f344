"""Votes and cascades against plain Python on random predictions."""

import random
from collections import Counter
from statistics import mode

import pytest
from pyspark.sql import functions as F

from wordtrail.functions import arrays
from wordtrail.operators import votes


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(i, [rng.randrange(1, 7) for _ in range(rng.choice([1, 2, 5, 7]))]) for i in range(200)]
    return spark.createDataFrame(data, "id int, v array<int>").cache()


def check(rows, expression, expected):
    for r in rows.select("v", expression.alias("x")).collect():
        assert r.x == expected(r.v), r


def top(v):
    return sorted(Counter(v).items(), key=lambda kv: (-kv[1], kv[0]))[0]


def test_hard_vote(rows, spark):
    check(rows, votes.hard_vote("v"), lambda v: top(v)[0])
    check(rows, votes.hard_vote(F.reverse("v")), lambda v: top(v)[0])
    assert spark.range(1).select(votes.hard_vote(F.array().cast("array<int>")).alias("x")).first().x == 0


def test_weighted_hard_vote(rows):
    check(rows, votes.weighted_hard_vote("v", 0.5), lambda v: (float(top(v)[0]), top(v)[1] * 0.5))


def test_mode_first_seen_wins(rows):
    check(rows, votes.mode_vote("v"), mode)


def test_first_if_repeated(rows):
    check(rows, arrays.first_if_repeated("v"), lambda v: v[0] if v[0] in v[1:] else v[-1])


def test_ascending_pairs(rows):
    def pairs(v):
        s = sorted(v)
        return [[a, b] for i, a in enumerate(s) for b in s[i + 1:]]
    check(rows, arrays.ascending_pairs("v"), pairs)


def test_vote_of_votes(spark):
    def run(*pairs):
        array = F.array(*[F.struct(F.lit(float(l)).alias("label"), F.lit(float(w)).alias("weight")) for l, w in pairs])
        return spark.range(1).select(votes.vote_of_votes(array).alias("x")).first().x
    assert run((2, 1), (3, 1)) == 2 and run((0, 9), (5, 1)) == 5 and run((0, 9)) == 0 and run((4, 1), (4, 1), (1, 1.5)) == 4


def test_cascades(spark):
    df = spark.createDataFrame([(1, 3, 0), (2, 1, 2), (3, 1, 0), (4, 3, 2)], "id int, a int, b int")
    claimed = df.select("id", votes.cascade(["a", "b"], [3, 2, 1]).alias("x"),
                        votes.first_valid([F.col("a") * (F.col("a") == 3).cast("int"), "b"], [3, 2, 1]).alias("y"))
    assert {r.id: (r.x, r.y) for r in claimed.collect()} == {1: (3, 3), 2: (2, 2), 3: (1, 1), 4: (3, 3)}


def test_refine_neighbours(spark):
    df = spark.createDataFrame([(1, 1, 1, 2), (2, 2, 2, 2), (3, 2, 2, 3), (4, 3, 1, 2)], "id int, s int, d12 int, d23 int")
    got = df.select("id", votes.refine_neighbours("s", [(2, 3), (1, 2)], ["d23", "d12"]).alias("x"))
    assert {r.id: r.x for r in got.collect()} == {1: 1, 2: 2, 3: 3, 4: 2}


def test_pairs_for(spark):
    pairs = [(1, 2), (3, 4), (1, 3)]
    df = spark.createDataFrame([(0,), (123456,), (24,), (5,)], "k int")
    got = {r.k: r.x for r in df.select("k", votes.pairs_for("k", pairs).alias("x")).collect()}
    assert got == {0: [[1, 2], [1, 3], [3, 4]], 123456: [[1, 2], [1, 3], [3, 4]], 24: [[1, 2], [3, 4]], 5: []}


def test_excluding_vote(spark):
    df = spark.createDataFrame([(0, 1, [1, 2, 2]), (0, 0, [1, 1, 2]), (1, 1, [2])], "b1 int, b2 int, v array<int>")
    allowed = votes.allowed_labels(["b1", "b2"], [1, 2], [1, 2])
    got = df.select(allowed.alias("ok"), votes.vote_within(allowed, "v").alias("x")).collect()
    assert [(r.ok, r.x) for r in got] == [([2], 2), ([1, 2], 1), ([1, 2], 2)]


def test_map_votes(spark):
    df = spark.createDataFrame([({"sentence": "0", "0": "0.4", "2": "0.6"}, {"sentence": "0", "0": "0.1", "5": "0.9"})],
                               "a map<string,string>, b map<string,string>")
    assert df.select(votes.own_label_vote(["a", "b"]).alias("x")).first().x == 5.0
    soft = spark.createDataFrame([({"1": "0.5", "2": "0.5"},)], "a map<string,string>")
    assert soft.select(votes.map_soft_vote(["a", "a"], ["2", "1"]).alias("x")).first().x == 1


def test_soft_vote_and_best_position(spark):
    df = spark.createDataFrame([([0.1, 0.5], [0.6, 0.2])], "a array<double>, b array<double>")
    assert df.select(votes.soft_vote("a", "b").alias("x")).first().x == 0
    assert spark.range(1).select(arrays.best_position(F.array(F.lit(None).cast("int"))).alias("x")).first().x is None


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    row = df.select(arrays.cosine("a", "b").alias("z"), arrays.cosine("b", "b").alias("o")).first()
    assert row.z == 0.0 and abs(row.o - 1) < 1e-12


def test_grades(spark):
    df = spark.createDataFrame([(-0.5,), (0.0,), (0.3,), (0.5,), (1.0,), (2.0,), (None,)], "s double")
    got = [[r[0] for r in df.select(arrays.grade_from_fraction("s", m)).collect()] for m in (1, 2, 3)]
    assert got[0] == [1, 1, 2, 4, 6, 6, None]
    assert got[1] == [1, 1, 2, 3, 6, 6, None]
    assert got[2] == [1, 1, 2, 3, 6, 6, None]
