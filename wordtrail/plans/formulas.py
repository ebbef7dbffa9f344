"""Scalar, regular-expression, array, map and vector functions (F)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from wordtrail.functions import arrays, regex, text
from wordtrail.functions.hashing import unit_hash
from wordtrail.operators.profile import mean_vectors
from wordtrail.plans.registry import WORD, query, unit_sql, words_sql

DOC_PHONE = r"(\d{3})\) (\d{3})-(\d{4})"


@query("f1_length", "SELECT doc_id, length(text) AS length, round(length(text) / 2072.0::double, 6) AS scaled FROM documents")
def length(t):
    return t.documents.select("doc_id", F.length("text").cast("bigint").alias("length"),
                              F.round(text.length_fraction("text"), 6).alias("scaled"))


@query("f2_paragraphs", """
SELECT doc_id, len(string_split(text, chr(10) || chr(10))) AS paragraphs, len(string_split(text, chr(10))) AS lines FROM documents""")
def paragraphs(t):
    return t.documents.select("doc_id", text.paragraph_count("text").cast("bigint").alias("paragraphs"),
                              text.paragraph_count("text", "\n").cast("bigint").alias("lines"))


@query("f3_mismatches", """
WITH w AS (SELECT c_custkey, c_name AS a, reverse(c_name) || c_mktsegment AS b FROM customer)
SELECT c_custkey, len(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1)))
  AS mismatches FROM w""")
def mismatches(t):
    words = t.customer.select("c_custkey", F.col("c_name").alias("a"),
                              F.concat(F.reverse("c_name"), "c_mktsegment").alias("b"))
    return words.select("c_custkey", text.mismatches("a", "b").cast("bigint").alias("mismatches"))


@query("f4_search", f"SELECT doc_id, regexp_matches(text, '{regex.EMAIL}') AS has_email, regexp_matches(text, '{DOC_PHONE}') AS has_phone FROM documents")
def search(t):
    return t.documents.select("doc_id", regex.matches("text", regex.EMAIL).alias("has_email"),
                              regex.matches("text", DOC_PHONE).alias("has_phone"))


@query("f5_first_span", r"""
WITH m AS (SELECT doc_id, text, regexp_extract(text, '[Tt]h[a-z]+') AS m FROM documents)
SELECT doc_id, instr(text, m) - 1 AS start_at, instr(text, m) - 1 + length(m) AS end_at FROM m WHERE m <> ''""")
def first_span(t):
    # the pattern starts with its own letters, so the first occurrence of the match is the match
    spans = t.documents.select("doc_id", regex.first_span("text", "[Tt]h[a-z]+").alias("s")).filter("s IS NOT NULL")
    return spans.select("doc_id", F.col("s.start").cast("bigint").alias("start_at"),
                        F.col("s.end").cast("bigint").alias("end_at"))


@query("f6_all_matches", """
SELECT doc_id, array_to_string(regexp_extract_all(text, 'th[a-z]*'), ' ') AS found,
  len(regexp_extract_all(text, 'th[a-z]*')) AS n FROM documents""")
def all_matches(t):
    return t.documents.select("doc_id", F.array_join(regex.all_matches("text", "th[a-z]*"), " ").alias("found"),
                              regex.count_matches("text", "th[a-z]*").cast("bigint").alias("n"))


@query("f7_all_spans", """
WITH p AS (SELECT doc_id, string_split_regex(text, 'th[a-z]*') AS gaps, regexp_extract_all(text, 'th[a-z]*') AS ms FROM documents),
u AS (SELECT doc_id, unnest(range(0, len(ms))) AS match_no, unnest(gaps[1:len(ms)]) AS gap, unnest(ms) AS match FROM p),
e AS (SELECT doc_id, match_no, match, sum(length(gap) + length(match)) OVER (PARTITION BY doc_id ORDER BY match_no)::bigint AS end_at FROM u)
SELECT doc_id, match_no, end_at - length(match) AS start_at, end_at, match FROM e""")
def all_spans(t):
    spans = regex.span_rows(t.documents, "doc_id", "text", "th[a-z]*")
    return spans.select("doc_id", F.col("match_no").cast("bigint").alias("match_no"),
                        F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"), "match")


@query("f8_groups", f"""
SELECT doc_id, regexp_extract(text, '{DOC_PHONE}', 1) AS area, regexp_extract(text, '{DOC_PHONE}', 2) AS exchange,
  regexp_extract(text, '{DOC_PHONE}', 3) AS line FROM documents WHERE regexp_matches(text, '{DOC_PHONE}')""")
def groups(t):
    names = {1: "area", 2: "exchange", 3: "line"}
    found = t.documents.select("doc_id", *[regex.group("text", DOC_PHONE, i).alias(n) for i, n in names.items()])
    return found.filter(F.col("area").isNotNull())


CLASS_PATTERNS = {"digits": r"[0-9]+", "words": WORD, "spaces": r"[ \t\n]+", "long_words": r"[A-Za-z]{12,}",
                  "short_numbers": r"[0-9]{2,4}", "plurals": r"[a-z]+tions?"}


@query("f9_classes_and_quantifiers", "SELECT doc_id, " + ", ".join(
    f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in CLASS_PATTERNS.items()) + " FROM documents")
def classes_and_quantifiers(t):
    return t.documents.select("doc_id", *[regex.count_matches("text", p).cast("bigint").alias(n)
                                          for n, p in CLASS_PATTERNS.items()])


@query("f10_alternation", "SELECT doc_id, regexp_extract(text, 'hand|than|that') AS found FROM documents WHERE regexp_matches(text, 'hand|than|that')")
def alternation(t):
    return t.documents.filter(regex.matches("text", "hand|than|that")).select(
        "doc_id", regex.first_match("text", "hand|than|that").alias("found"))


@query("f11_wildcards", r"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '.at'), '|') AS three,
  array_to_string(regexp_extract_all(text, '...at'), '|') AS five, array_to_string(regexp_extract_all(text, '[^ \t\n]+at'), '|') AS ending
FROM documents""")
def wildcards(t):
    return t.documents.select("doc_id", *[F.array_join(regex.all_matches("text", p), "|").alias(n) for n, p in
                                          (("three", ".at"), ("five", "...at"), ("ending", r"[^ \t\n]+at"))])


@query("f12_anchors", "SELECT p_partkey, regexp_matches(p_name, '[0-9]$') AS ends, regexp_matches(p_name, '^[0-9]') AS starts FROM part")
def anchors(t):
    return t.part.select("p_partkey", regex.matches("p_name", "[0-9]$").alias("ends"),
                         regex.matches("p_name", "^[0-9]").alias("starts"))


@query("f13_negated_class", """
SELECT doc_id, len(regexp_extract_all(text, '[^0-9]')) AS single, len(regexp_extract_all(text, '[^0-9]+')) AS runs,
  regexp_extract_all(text, '[^0-9]+')[1] AS first_run FROM documents""")
def negated_class(t):
    runs = regex.all_matches("text", "[^0-9]+")
    return t.documents.select("doc_id", regex.count_matches("text", "[^0-9]").cast("bigint").alias("single"),
                              F.size(runs).cast("bigint").alias("runs"), F.get(runs, F.lit(0)).alias("first_run"))


@query("f14_remove_punctuation", "SELECT doc_id, array_to_string(regexp_extract_all(text, '[^!.? ]+'), ' ') AS clean FROM documents")
def remove_punctuation(t):
    return t.documents.select("doc_id", regex.keep_and_join("text").alias("clean"))


@query("f15_hyphenated_words", f"""
SELECT doc_id, unnest(regexp_extract_all(text, '{regex.HYPHENATED}')) AS word FROM documents""")
def hyphenated_words(t):
    return t.documents.select("doc_id", F.explode(regex.all_matches("text", regex.HYPHENATED)).alias("word"))


@query("f16_optional_endings", """
SELECT doc_id, regexp_extract(text, 'th(ing|tion|er)', 1) AS ending FROM documents WHERE regexp_matches(text, 'th(ing|tion|er)')""")
def optional_endings(t):
    found = t.documents.select("doc_id", regex.group("text", "th(ing|tion|er)", 1).alias("ending"))
    return found.filter(F.col("ending").isNotNull())


@query("f17_templates", """
SELECT c_custkey, 'His name is ' || c_name || ' (' || c_mktsegment || ').' AS sentence, '''' || c_name || '''' AS quoted,
  'Address: ' || (c_custkey * 2)::varchar || ' Main Street' AS address FROM customer""")
def templates(t):
    book = F.create_map(F.lit("a"), F.col("c_custkey") * 2, F.lit("b"), F.col("c_custkey"))
    return t.customer.select(
        "c_custkey",
        text.template("His name is {name} ({segment}).", name=F.col("c_name"), segment=F.col("c_mktsegment")).alias("sentence"),
        text.quoted("c_name").alias("quoted"),
        text.template("Address: {number} Main Street", number=F.try_element_at(book, F.lit("a"))).alias("address"))


@query("f18_padding", """
SELECT p_partkey, rpad(p_brand, greatest(10, length(p_brand))::integer, ' ') || '|' || lpad(p_size::varchar, greatest(7, length(p_size::varchar))::integer, '_')
  || '|' || rpad(lpad(p_type, ((greatest(20, length(p_type)) - length(p_type)) // 2 + length(p_type))::integer, '*'),
                 greatest(20, length(p_type))::integer, '*') AS line FROM part""")
def padding(t):
    return t.part.select("p_partkey", F.concat_ws(
        "|", text.pad("p_brand", 10), text.pad("p_size", 7, ">", "_"), text.pad("p_type", 20, "^", "*")).alias("line"))


@query("f19_long_date", "SELECT o_orderkey, strftime(o_orderdate, '%B %d, %Y') AS day FROM orders")
def long_date(t):
    return t.orders.select("o_orderkey", text.long_date("o_orderdate").alias("day"))


@query("f20_ratio", """
SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS unit_price,
  l_tax / nullif(l_discount, 0) AS share FROM lineitem""")
def ratio(t):
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"),
                             F.try_divide("l_tax", "l_discount").alias("share"))


@query("f21_rounded_mean", "SELECT doc_id, round((quality + toxic + 1) / 2.0)::integer AS mean FROM labels")
def rounded_mean(t):
    mean = arrays.sum_columns(F.col("quality"), F.col("toxic"), F.lit(1)) / F.lit(2.0)
    return t.labels.select("doc_id", F.round(mean).cast("int").alias("mean"))


@query("f22_random_column", f"SELECT event_id, round({unit_sql('event_id')}, 6) AS random, floor({unit_sql('event_id')} * 10)::integer AS batch FROM events")
def random_column(t):
    return t.events.select("event_id", F.round(unit_hash("event_id"), 6).alias("random"),
                           F.floor(unit_hash("event_id") * 10).cast("int").alias("batch"))


@query("f23_size", f"""
SELECT doc_id, len({words_sql('text')}) AS tokens FROM documents""")
def size(t):
    return t.documents.select("doc_id", F.size(regex.all_matches(F.lower("text"), WORD)).cast("bigint").alias("tokens"))


@query("f23_vector_size", "SELECT vec_id, len(embedding) AS size FROM embeddings")
def vector_size(t):
    vector = array_to_vector(F.transform("embedding", lambda x: x.cast("double")))
    return t.embeddings.select("vec_id", F.size(vector_to_array(vector)).cast("bigint").alias("size"))


@query("f24_build_and_index", """
SELECT l_orderkey, l_linenumber, [l_quantity, l_discount, l_tax][2] AS second, [l_quantity][9] AS missing FROM lineitem""")
def build_and_index(t):
    values = F.array("l_quantity", "l_discount", "l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.get(values, F.lit(1)).alias("second"),
                             F.get(values, F.lit(8)).alias("missing"))


@query("f25_best_position", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def best_position(t):
    return t.embeddings.select("vec_id", arrays.best_position("embedding").alias("best"))


@query("f26_add_arrays", """
SELECT vec_id, round(embedding[1]::double + embedding[5]::double, 6) AS a, round(embedding[4]::double + embedding[8]::double, 6) AS b
FROM embeddings""")
def add_arrays(t):
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    total = arrays.add_arrays(F.slice(doubles, 1, 4), F.slice(doubles, 5, 4))
    return t.embeddings.select("vec_id", F.round(F.get(total, F.lit(0)), 6).alias("a"),
                               F.round(F.get(total, F.lit(3)), 6).alias("b"))


def scorer(k: int):
    """Score 1..6 from one embedding component."""
    return (F.floor(F.abs(F.get("embedding", F.lit(k - 1)).cast("double")) * 1000) % 6 + 1).cast("int")


def scorer_sql(k: int) -> str:
    return f"(floor(abs(embedding[{k}]::double) * 1000)::bigint % 6 + 1)::integer"


def scorer_array(count: int, first: int = 1):
    return F.array(*[scorer(k) for k in range(first, first + count)])


def scorer_array_sql(count: int, first: int = 1) -> str:
    return "[" + ", ".join(scorer_sql(k) for k in range(first, first + count)) + "]"


@query("f27_drop_zeros", f"""
SELECT vec_id, array_to_string(list_filter(list_transform({scorer_array_sql(6)}, lambda x: x % 3), lambda x: x <> 0), ',') AS kept FROM embeddings""")
def drop_zeros(t):
    kept = arrays.drop_zeros(F.transform(scorer_array(6), lambda x: x % 3))
    return t.embeddings.select("vec_id", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("kept"))


@query("f28_ascending_pairs", f"""
WITH v AS (SELECT vec_id, list_sort({scorer_array_sql(4)}) AS v FROM embeddings)
SELECT vec_id, concat_ws(' ', v[1]||'-'||v[2], v[1]||'-'||v[3], v[1]||'-'||v[4], v[2]||'-'||v[3], v[2]||'-'||v[4], v[3]||'-'||v[4])
  AS pairs FROM v""")
def ascending_pairs(t):
    shown = F.transform(arrays.ascending_pairs(scorer_array(4)),
                        lambda p: F.concat_ws("-", F.transform(p, lambda x: x.cast("string"))))
    return t.embeddings.select("vec_id", F.array_join(shown, " ").alias("pairs"))


@query("f29_same_array", f"SELECT vec_id, list_sort({scorer_array_sql(2)}) = {scorer_array_sql(2)} AS same FROM embeddings")
def same_array(t):
    return t.embeddings.select("vec_id", F.sort_array(scorer_array(2)).eqNullSafe(scorer_array(2)).alias("same"))


@query("f30_first_if_repeated", f"""
WITH v AS (SELECT vec_id, {scorer_array_sql(4)} AS v FROM embeddings)
SELECT vec_id, CASE WHEN list_contains(v[2:], v[1]) THEN v[1] ELSE v[4] END AS score FROM v""")
def first_if_repeated(t):
    return t.embeddings.select("vec_id", arrays.first_if_repeated(scorer_array(4)).alias("score"))


@query("f31_map_lookup", """
SELECT event_id, 'k' AS first_key, regexp_extract(props, '[0-9]+')::integer AS k, CAST(NULL AS integer) AS missing FROM events""")
def map_lookup(t):
    props = F.map_concat(F.create_map(F.lit("sentence"), F.lit("0")), F.from_json("props", "map<string,string>"))
    return t.events.select("event_id", arrays.first_key_except(props, ["sentence", "0"]).alias("first_key"),
                           F.try_element_at(props, F.lit("k")).try_cast("int").alias("k"),
                           F.try_element_at(props, F.lit("none")).try_cast("int").alias("missing"))


@query("f32_vector_round_trip", "SELECT vec_id, round(list_sum(embedding::double[]), 4) AS total FROM embeddings")
def vector_round_trip(t):
    vector = array_to_vector(F.transform("embedding", lambda x: x.cast("double")))
    total = F.aggregate(vector_to_array(vector), F.lit(0.0), lambda s, x: s + x)
    return t.embeddings.select("vec_id", F.round(total, 4).alias("total"))


@query("f33_mean_vector", """
WITH p AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::double AS x FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY 1, 2)
SELECT label, string_agg(round(m * 10000)::bigint::varchar, ',' ORDER BY i) AS vector FROM m GROUP BY 1""")
def mean_vector(t):
    means = mean_vectors(t.embeddings, "label", "embedding")
    shown = F.transform("vector", lambda x: F.round(x * 10000).cast("bigint").cast("string"))
    return means.select("label", F.array_join(shown, ",").alias("vector"))


@query("f34_cosine", """
SELECT vec_id, round(list_cosine_similarity(embedding[1:32]::double[], embedding[33:64]::double[]), 5) AS similarity FROM embeddings""")
def cosine(t):
    halves = arrays.cosine(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    return t.embeddings.select("vec_id", F.round(halves, 5).alias("similarity"))


def _first_step(steps: list[float], test: str) -> str:
    whens = " ".join(f"WHEN round_even(s, 1) {test} {v!r}::double THEN {i}" for i, v in enumerate(steps, start=1))
    return f"CASE {whens} ELSE 6 END"


@query("f35_grade", f"""
WITH v AS (SELECT event_id, least(value / 50, 1.2) AS s FROM events)
SELECT event_id, CASE WHEN 5 * s + 1 <= 1 THEN 1 WHEN 5 * s + 1 >= 6 THEN 6 ELSE round_even(5 * s + 1, 0) END::integer AS clamped,
  {_first_step([0.2, 0.4, 0.6, 0.8, 1.0], '<')} AS limits,
  {_first_step([(a + b) / 2 for a, b in zip([0.0, 0.2, 0.4, 0.6, 0.8], [0.2, 0.4, 0.6, 0.8, 1.0])], '<=')} AS nearest FROM v""")
def grade(t):
    s = F.least(F.col("value") / 50, F.lit(1.2))
    return t.events.select("event_id", *[arrays.grade_from_fraction(s, mode).alias(name)
                                         for mode, name in ((1, "clamped"), (2, "limits"), (3, "nearest"))])
