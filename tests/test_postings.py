"""The stored index against plain dictionaries, its plans, and its limits."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wordtrail.operators import postings, stems, tokens
from wordtrail.plans import texts
from wordtrail.plans.registry import Tables

r = random.Random(4)
COUNTS = sorted({(r.choice([i, i + (1 << 17), i + (1 << 40)]), r.choice("abcdefgh")): r.randint(1, 9) for i in range(300) for _ in range(3)}.items())
ROWS = [(key, term, tf) for (key, term), tf in COUNTS] + [(-5, "a", 2), (None, "a", 1), (1, None, 1)]


@pytest.fixture(scope="module")
def index(spark):
    counts = spark.createDataFrame(ROWS, "id long, word string, tf long")
    return postings.read_index(spark, postings.write_index(counts, "id", "word", buckets=4)).cache()


def known():
    return [row for row in ROWS if None not in row]


def test_postings_come_back_whole(index):
    assert sorted((x.key, x.term, x.tf) for x in postings.postings(index).collect()) == sorted(known())
    assert index.filter("size(gaps) <> n OR size(tfs) <> n OR gaps[0] <> 0 OR exists(slice(gaps, 2, n), g -> g <= 0)").isEmpty()


def test_search_reads_one_bucket(spark, index):
    place = postings.write_index(spark.createDataFrame(ROWS, "id long, word string, tf long"), "id", "word", buckets=4)
    fresh = postings.read_index(spark, place)
    for term in "ah":
        found = postings.search(fresh, term, buckets=4)
        assert sorted((x.key, x.tf) for x in found.collect()) == sorted((k, n) for k, t, n in known() if t == term)
        scan = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
        assert len(scan) == 1 and "bucket" in scan[0].split("PartitionFilters")[1].split("PushedFilters")[0]
    assert postings.search(fresh, "zz", buckets=4).count() == 0


def test_frequencies_read_no_posting(index, spark):
    place = postings.write_index(spark.createDataFrame(ROWS, "id long, word string, tf long"), "id", "word")
    heads = postings.document_frequencies(postings.read_index(spark, place))
    want = defaultdict(int)
    for _, term, _ in known():
        want[term] += 1
    assert dict(heads.collect()) == want
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<term:string,n:int>" in plan


def test_tf_idf(index):
    m, df = 300, dict(postings.document_frequencies(index).collect())
    got = {(x.key, x.term): (x.tf, x.df, x.tf_idf) for x in postings.tf_idf(index, m, min_doc_freq=10).collect()}
    assert len(got) == len(known())
    for key, term, tf in known():
        idf = math.log((m + 1) / (df[term] + 1)) if df[term] >= 10 else 0.0
        assert got[key, term][:2] == (tf, df[term]) and abs(got[key, term][2] - tf * idf) < 1e-9


def test_a_frequent_term_has_many_blocks(spark):
    counts = spark.range(5000).selectExpr("id * 40 AS id", "'x' AS word", "1L AS tf")
    blocks = postings.read_index(spark, postings.write_index(counts, "id", "word", span_bits=10))
    assert blocks.count() > 100 and blocks.agg({"n": "max"}).first()[0] <= 1 << 10


def test_limits(spark):
    with pytest.raises(TypeError):
        postings.write_index(spark.createDataFrame([("a", "b", 1)], "id string, word string, tf long"), "id", "word")
    none = postings.write_index(spark.createDataFrame([], "id long, word string, tf long"), "id", "word")
    assert postings.read_index(spark, none).count() == 0


def test_stored_search_reads_no_text(spark, folder):
    t = Tables(spark, folder)
    place = stems.stored_index(texts.stem_counts(t), "doc_id")
    plan = stems.stored_search(postings.read_index(spark, place), "things")._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and plan.count("Scan parquet") == 1


def test_full_blocks_are_read_in_time_linear_in_their_postings(spark):
    counts = spark.range(1 << 17).selectExpr("id", "explode(array('x', 'y')) AS word", "id % 7 + 1 AS tf")
    index = postings.read_index(spark, postings.write_index(counts, "id", "word"))
    assert index.agg({"n": "max"}).first()[0] == 1 << 16
    decoded = postings.postings(index, "n")
    assert decoded.columns == ["term", "n", "key", "tf"] and "aggregate(" not in decoded._jdf.queryExecution().optimizedPlan().toString()
    assert decoded.filter("tf <> key % 7 + 1 OR n <> 65536").isEmpty()
    assert {(x.term, x.rows, x.keys, x.last) for x in decoded.groupBy("term").agg(
        F.count("*").alias("rows"), F.countDistinct("key").alias("keys"), F.max("key").alias("last")).collect()} == {(w, 1 << 17, 1 << 17, (1 << 17) - 1) for w in "xy"}


def test_words_are_stemmed_once_and_on_all_cores(spark, monkeypatch):
    words = spark.createDataFrame([("things",), ("thing",), ("running",)] * 50, "token string")
    vocabulary = stems.stem_vocabulary(words)
    assert vocabulary.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    # the words' distinct step must be below the stems even where a later step would not mind repeats
    plan = stems.variants(vocabulary)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.rindex("Aggregate [token") > plan.index("RepartitionByExpression")
    stemmed = []
    whole = stems.stem_vocabulary
    monkeypatch.setattr(stems, "stem_vocabulary", lambda *a: stemmed.append(whole(*a)) or stemmed[-1])
    counts = spark.createDataFrame([(i, w, 2) for i in range(9) for w in ("things", "thing", "ran")], "id long, token string, tf long")
    found = stems.stored_search(postings.read_index(spark, stems.stored_index(counts, "id")), "things")
    assert sorted((x.stem, x.key, x.tf) for x in found.collect()) == [("thing", i, 4) for i in range(9)]
    assert [x.count() for x in stemmed] == [3]


def test_a_search_stems_distinct_words_and_joins_only_the_wanted(spark):
    counts = spark.createDataFrame([(i % 9, w, 2) for i in range(18) for w in ("things", "thing", "ran", None)] + [(None, "thing", 1)], "id long, token string, tf long")
    plan = stems.stem_vocabulary(counts).filter("stem = 'thing'")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" in plan and "regexp" not in plan[plan.index("RepartitionByExpression"):]
    index = stems.stem_index(counts, "id")
    found = stems.search(index, "things")
    key = lambda rows: sorted(rows, key=str)
    assert key(found.collect()) == key(index.filter("stem = 'thing'").collect()) and found.count() == 10
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan and "regexp" not in plan
    stored = spark.createDataFrame([("thing", 1, 2), ("run", 1, 1)], "stem string, id long, tf long")
    assert [tuple(r) for r in stems.search(stored, "things").collect()] == [("thing", 1, 2)]


def test_items_are_counted_within_their_row(spark):
    rows = spark.createDataFrame([(1, ["b", "a", None, "b"]), (2, []), (3, None), (1, ["a"])], "id long, words array<string>")
    found = tokens.term_counts(rows, "id", F.col("words")).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, [(1, "b", 2), (1, "a", 1), (1, None, 1), (1, "a", 1)]))
    plan = tokens.term_counts(rows, "id", F.col("words"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "Aggregate" not in plan


def test_counts_of_a_stem_are_added_up_where_its_blocks_are_made(spark, monkeypatch):
    given, whole = [], postings.write_index
    monkeypatch.setattr(postings, "write_index", lambda counts, *a, **k: given.append(counts) or whole(counts, *a, **k))
    counts = spark.createDataFrame([(i % 9, w, 2) for i in range(18) for w in ("things", "thing", "ran", None)] + [(None, "thing", 1)], "id long, token string, tf long")
    found = stems.stored_search(postings.read_index(spark, stems.stored_index(counts, "id")), "things")
    assert sorted((x.stem, x.key, x.tf) for x in found.collect()) == [("thing", i, 8) for i in range(9)]
    assert "Aggregate [stem" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
