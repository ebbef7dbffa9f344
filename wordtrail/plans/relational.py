"""Projections, joins, aggregates, sorting and set operations (P, J, G, O, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordtrail.functions.arrays import sum_columns
from wordtrail.operators import tables, tokens
from wordtrail.operators.lookup import lookup_join
from wordtrail.operators.sampling import class_split_counts, with_split
from wordtrail.operators.tagging import WORD_TAGS
from wordtrail.plans.registry import query, unit_sql, words_sql


@query("p1_select", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def select(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")


@query("p2_add_columns", """
SELECT doc_id, length(text) AS length, n_chars + 1 AS n_chars FROM documents""")
def add_columns(t):
    added = t.documents.withColumns({"length": F.length("text").cast("bigint"), "n_chars": F.col("n_chars") + 1})
    return added.select("doc_id", "length", "n_chars")


@query("p3_rename", "SELECT doc_id AS essay_id, quality AS score FROM labels")
def rename(t):
    return t.labels.withColumnsRenamed({"doc_id": "essay_id", "quality": "score"}).drop("toxic")


@query("p4_keep_only", "SELECT o_orderkey, o_totalprice FROM orders")
def keep_only(t):
    return tables.keep_only(t.orders, ["o_orderkey", "o_totalprice"])


@query("p5_aggregate_alias", "SELECT event_type, max(value) AS time_spent_max, count(*) AS n FROM events GROUP BY 1")
def aggregate_alias(t):
    return t.events.groupBy("event_type").agg(F.max("value").alias("time_spent_max"), F.count("*").alias("n"))


@query("p6_casts", """
SELECT event_id, try_cast(regexp_extract(props, '[0-9]+') AS integer) AS k,
       round(try_cast(value AS decimal(18,4))::double, 4) AS amount, try_cast(event_type AS integer) AS bad
FROM events""")
def casts(t):
    raw = t.events.select("event_id", F.regexp_extract("props", "[0-9]+", 0).alias("k"),
                          F.col("value").alias("amount"), F.col("event_type").alias("bad"))
    cast = tables.safe_cast(raw, {"k": "int", "amount": "decimal(18,4)", "bad": "int"})
    return cast.withColumn("amount", F.round(F.col("amount").cast("double"), 4))


@query("p7_equality_filter", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'""")
def equality_filter(t):
    return t.orders.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "F")).select(
        "o_orderkey", "o_orderstatus")


@query("p8_boolean_predicates", """
SELECT doc_id, quality, toxic FROM labels WHERE (quality = 1 OR toxic = 1) AND NOT (quality = 1 AND toxic = 1)""")
def boolean_predicates(t):
    either = t.labels.filter((F.col("quality") == 1) | (F.col("toxic") == 1))
    return tables.excluding(either, (F.col("quality") == 1) & (F.col("toxic") == 1))


@query("p9_membership", "SELECT event_id, user_id FROM events WHERE event_type IN ('signup', 'purchase')")
def membership(t):
    return t.events.filter(F.col("event_type").isin("signup", "purchase")).select("event_id", "user_id")


@query("p10_conditional", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS band
FROM lineitem""")
def conditional(t):
    band = F.when(F.col("l_quantity") < 10, "low").when(F.col("l_quantity") < 30, "mid").otherwise("high")
    return t.lineitem.select("l_orderkey", "l_linenumber", band.alias("band"))


@query("p11_literal", "SELECT vec_id, label, 7 AS sample_id FROM embeddings")
def literal(t):
    return t.embeddings.select("vec_id", "label", F.lit(7).alias("sample_id"))


@query("p12_fill_nulls", """
SELECT d.doc_id, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def fill_nulls(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").fillna(0)


@query("p13_struct_field", f"""
SELECT doc_id, array_to_string({words_sql('text')}, ' ') AS result FROM documents""")
def struct_field(t):
    annotation = F.transform(tokens.word_tokens("text"), lambda w: F.struct(
        F.lit("token").alias("annotator"), w.alias("result"),
        F.create_map(F.lit("sentence"), F.lit("0")).alias("metadata")))
    annotated = t.documents.select("doc_id", annotation.alias("token"))
    return annotated.select("doc_id", F.array_join("token.result", " ").alias("result"))


@query("p14_sum_of_columns", """
SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount + l_tax, 4) AS total FROM lineitem""")
def sum_of_columns(t):
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             F.round(sum_columns("l_quantity", "l_discount", "l_tax"), 4).alias("total"))


@query("p15_substring_test", "SELECT page_id, contains(html, 'class=\"ad\"') AS has_ad FROM pages")
def substring_test(t):
    return t.pages.select("page_id", F.contains("html", F.lit('class="ad"')).alias("has_ad"))


@query("j1_split_distribution", f"""
WITH s AS (SELECT o_orderpriority AS label, {unit_sql('o_orderkey')} < 0.75 AS train FROM orders)
SELECT a.label, a.n AS count_train, b.n AS count_test
FROM (SELECT label, count(*) n FROM s WHERE train GROUP BY 1) a
JOIN (SELECT label, count(*) n FROM s WHERE NOT train GROUP BY 1) b ON a.label = b.label""")
def split_distribution(t):
    split = with_split(t.orders.select("o_orderkey", F.col("o_orderpriority").alias("label")), "o_orderkey", 0.75)
    counts = class_split_counts(split, "label", ["train", "test"])
    return counts.filter((F.col("count_train") > 0) & (F.col("count_test") > 0))


@query("j2_left_join_labels", """
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def left_join_labels(t):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")


J3_TAGS = {w: tag for tag in ("DT", "IN", "CC") for w in WORD_TAGS[tag]}


@query("j3_dictionary_join", f"""
SELECT v.tag, count(*) AS n, count(DISTINCT d.doc_id) AS docs
FROM (SELECT doc_id, unnest({words_sql('text')}) AS token FROM documents) d
JOIN (VALUES {', '.join(f"('{w}','{tag}')" for w, tag in J3_TAGS.items())}) v(token, tag) ON d.token = v.token
GROUP BY 1""")
def dictionary_join(t):
    lexicon = t.spark.createDataFrame(list(J3_TAGS.items()), "token string, tag string")
    counts = tokens.term_counts(t.documents, "doc_id", tokens.word_tokens("text")).withColumnRenamed("term", "token")
    per_doc = (lookup_join(counts, lexicon, "token", ["doc_id"], "inner")
               .groupBy("tag", "doc_id").agg(F.sum("tf").alias("tf")))
    return per_doc.groupBy("tag").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


@query("g1_count", "SELECT count(*) AS n FROM events")
def count(t):
    return t.events.agg(F.count("*").alias("n"))


@query("g2_group_count", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def group_count(t):
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("g3_group_mean", "SELECT lang, round(avg(length(text)), 4) AS mean_length FROM documents GROUP BY 1")
def group_mean(t):
    return t.documents.groupBy("lang").agg(F.round(F.avg(F.length("text")), 4).alias("mean_length"))


@query("g4_max_aggregates", """
SELECT user_id, max(event_type) AS page_max, max(value) AS time_max,
       max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS converted FROM events GROUP BY 1""")
def max_aggregates(t):
    bought = (F.col("event_type") == "purchase").cast("int")
    return t.events.groupBy("user_id").agg(*[
        F.max(c).alias(name) for c, name in
        ((F.col("event_type"), "page_max"), (F.col("value"), "time_max"), (bought, "converted"))])


@query("g5_distinct_count", """
SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS pages FROM events""")
def distinct_count(t):
    per_pair = t.events.select("user_id", "event_type").distinct()
    return per_pair.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("pages"))


@query("g5_distinct_values", "SELECT DISTINCT o_orderpriority AS label FROM orders")
def distinct_values(t):
    return t.orders.select(F.col("o_orderpriority").alias("label")).distinct()


@query("g6_pivot_count", """
SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1
FROM labels GROUP BY 1""")
def pivot_count(t):
    return tables.pivot_counts(t.labels, "quality", "toxic", [0, 1]).withColumnsRenamed({"0": "toxic_0", "1": "toxic_1"})


@query("g7_class_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def class_counts(t):
    return tables.class_counts(t.orders, "o_orderpriority")


@query("g8_item_frequency", f"""
SELECT doc_id, count(*) AS tokens, count(DISTINCT w) AS items, max(c) AS most FROM (
  SELECT doc_id, w, count(*) OVER (PARTITION BY doc_id, w) AS c
  FROM (SELECT doc_id, unnest({words_sql('text')}) AS w FROM documents)) GROUP BY 1""")
def item_frequency(t):
    counts = tokens.term_counts(t.documents, "doc_id", tokens.word_tokens("text"))
    return counts.groupBy("doc_id").agg(F.sum("tf").alias("tokens"), F.count("*").alias("items"),
                                        F.max("tf").alias("most"))


@query("o1_sort", """
SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, event_type, user_id""")
def sort(t):
    return t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "event_type", "user_id")


@query("o2_shuffled_preview", "SELECT doc_id, lang FROM documents ORDER BY md5(doc_id::varchar), doc_id LIMIT 10")
def shuffled_preview(t):
    return tables.shuffled_preview(t.documents.select("doc_id", "lang"), "doc_id", 10)


@query("o3_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def limit(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("o4_frequent_items", f"""
SELECT doc_id, rank, item, n FROM (
  SELECT doc_id, item, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(p)) AS rank
  FROM (SELECT doc_id, unnest(w) AS item, generate_subscripts(w, 1) AS p
        FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)) GROUP BY 1, 2) WHERE rank <= 5""")
def frequent_items(t):
    top = tokens.top_items(t.documents, "doc_id", tokens.word_tokens("text"), 5)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@query("u1_union", """
SELECT text, 'document' AS kind FROM documents UNION ALL SELECT text, 'benchmark' FROM benchmark
UNION ALL SELECT text, 'turn' FROM conversations""")
def union(t):
    parts = [t.documents.select("text", F.lit("document").alias("kind")),
             t.benchmark.select(F.lit("benchmark").alias("kind"), "text"),
             t.conversations.select("text", F.lit("turn").alias("kind"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("u2_drop_duplicates", f"""
SELECT DISTINCT lang, array_to_string({words_sql('text')}, ' ') AS words FROM documents""")
def drop_duplicates(t):
    lists = t.documents.select("lang", tokens.word_tokens("text").alias("tokens")).dropDuplicates()
    return lists.select("lang", F.array_join("tokens", " ").alias("words"))


@query("u3_array_distinct", f"""
SELECT doc_id, len(list_distinct({words_sql('text')})) AS unique_words FROM documents""")
def array_distinct(t):
    return t.documents.select("doc_id", F.size(F.array_distinct(tokens.word_tokens("text"))).cast("bigint").alias("unique_words"))
