"""Text operators over documents (T)."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from wordtrail.functions import regex
from wordtrail.functions.hashing import hash32
from wordtrail.functions.stopwords import ENGLISH
from wordtrail.operators import postings, profile, stems, tagging, tokens
from wordtrail.operators.lookup import lookup_join, salted_join, word_table
from wordtrail.plans.registry import WORD, hash_sql, query, quoted_list, words_sql
from wordtrail.plans.stem_sql import porter2_ctes, porter_ctes
from wordtrail.session import cut_lineage

STOP_SQL = quoted_list(ENGLISH)


def token_cte(text: str = "text", lower: bool = True) -> str:
    source = f"lower({text})" if lower else text
    return f"""tok AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS p, unnest(w) AS token
  FROM (SELECT doc_id, regexp_extract_all({source}, '{WORD}') AS w FROM documents))"""


def tagged_ctes(source: str) -> str:
    """CTEs from ``source(doc_id, p, token)`` to ``tagged(doc_id, p, token, tag)``."""
    known = " ".join(f"WHEN lower(token) IN ({quoted_list(words)}) THEN '{tag}'"
                     for tag, words in tagging.WORD_TAGS.items())
    forms = {tagging.SYMBOL: "SYM", tagging.NUMBER: "CD"}
    forms |= {f"({'|'.join(endings)})$": tag for tag, endings in tagging.ENDING_TAGS.items()}
    guess = " ".join(f"WHEN regexp_matches(lower(token), '{p}') THEN '{tag}'" for p, tag in forms.items())
    nominal, verbal = quoted_list(tagging.AFTER_NOMINAL), quoted_list(tagging.AFTER_VERBAL)
    return rf"""
prv AS (SELECT *, lag(token) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM {source}),
gss AS (SELECT *, CASE {known} END AS known, CASE {guess}
  WHEN regexp_matches(token, '^\p{{Lu}}\p{{L}}+$') THEN 'NNP' ELSE 'NN' END AS guess FROM prv),
tagged AS (SELECT doc_id, p, token, coalesce(known,
  CASE WHEN lower(prev) IN ({nominal}) AND guess IN ('VBG', 'VBD', 'NN') THEN 'NN'
       WHEN lower(prev) IN ({verbal}) AND guess IN ('NN', 'NNP') THEN 'VB'
       WHEN prev IS NULL AND guess = 'NNP' THEN 'NN' ELSE guess END) AS tag FROM gss)"""


NOUNS, VERBS = quoted_list(tagging.NOUN_TAGS), quoted_list(tagging.VERB_TAGS)
LEMMA_ROWS = ", ".join(f"('{a}','{b}','{c}')" for a, b, c in tagging.LEMMAS)
LEMMA_CTES = f"""
cls AS (SELECT *, CASE WHEN tag IN ({NOUNS}) THEN 'NOUN' WHEN tag IN ({VERBS}) THEN 'VERB' ELSE tag END AS class FROM tagged),
lemmas AS (SELECT cls.*, coalesce(v.lemma, lower(token)) AS lemma FROM cls
  LEFT JOIN (VALUES {LEMMA_ROWS}) v(form, class, lemma) ON lower(token) = v.form AND cls.class = v.class)"""


def rule_token_sql(text: str) -> str:
    return (rf"regexp_extract_all(regexp_replace({text}, '(\p{{L}})(n''t)\b', '\1 \2', 'g'), '"
            + tokens.RULE_TOKEN.replace("'", "''") + "')")


@query("t1_whitespace_tokens", r"""
SELECT doc_id, array_to_string(regexp_split_to_array(regexp_replace(lower(text), '\s+$', ''), '\s'), '|') AS tokens FROM documents""")
def whitespace_tokens(t):
    split = Tokenizer(inputCol="text", outputCol="tokens").transform(t.texts)
    return split.select("doc_id", F.array_join("tokens", "|").alias("tokens"))


@query("t2_word_tokens", f"SELECT doc_id, array_to_string({words_sql('text')}, '|') AS tokens FROM documents")
def word_tokens(t):
    return t.texts.select("doc_id", F.array_join(tokens.word_tokens("text"), "|").alias("tokens"))


@query("t3_rule_tokens", f"SELECT doc_id, array_to_string({rule_token_sql('text')}, ' ') AS tokens FROM documents")
def rule_tokens(t):
    return t.texts.select("doc_id", F.array_join(tokens.rule_tokens("text"), " ").alias("tokens"))


@query("t4_normalize", r"""
SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[^ \t\n]+'),
  lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}_\s]', '', 'g')), lambda x: x <> ''), ' ') AS tokens FROM documents""")
def normalize(t):
    clean = tokens.normalize(regex.all_matches("text", r"[^ \t\n]+"))
    return t.texts.select("doc_id", F.array_join(clean, " ").alias("tokens"))


@query("t5_stop_words_removed", f"""
SELECT doc_id, array_to_string(list_filter({words_sql('text')}, lambda x: x NOT IN ({STOP_SQL})), ' ') AS refined FROM documents""")
def stop_words_removed(t):
    split = t.texts.select("doc_id", tokens.word_tokens("text").alias("tokens"))
    refined = StopWordsRemover(inputCol="tokens", outputCol="refined").transform(split)
    return refined.select("doc_id", F.array_join("refined", " ").alias("refined"))


@query("t5_stop_words_anti_join", f"""
SELECT term AS token, sum(tf)::bigint AS n FROM (SELECT unnest({words_sql('text')}) AS term, 1 AS tf FROM documents)
WHERE term NOT IN ({STOP_SQL}) GROUP BY 1""")
def stop_words_anti_join(t):
    counts = tokens.term_counts(t.texts, "doc_id", tokens.word_tokens("text")).withColumnRenamed("term", "token")
    kept = tokens.stop_rows_removed(counts, word_table(t.spark, ENGLISH), ["doc_id"])
    return kept.groupBy("token").agg(F.sum("tf").alias("n"))


@query("t6_stop_list", f"""
WITH base AS (SELECT unnest([{STOP_SQL}]) AS token),
edited AS (SELECT token FROM base UNION SELECT 'btw'), cut AS (SELECT token FROM edited WHERE token <> 'into'),
freq AS (SELECT unnest({words_sql('text')}) AS token FROM documents)
SELECT freq.token, count(*) AS n, max(cut.token) IS NOT NULL AS is_stop, (SELECT count(*) FROM cut) AS stop_words
FROM freq LEFT JOIN cut ON freq.token = cut.token GROUP BY 1""")
def stop_list(t):
    stops = tokens.edit_stop_table(word_table(t.spark, ENGLISH), add=["btw"], remove=["into"])
    flagged = stops.withColumn("_stop", F.lit(True))
    freq = tokens.word_frequency(t.texts, tokens.word_tokens("text"))
    size = stops.agg(F.count("*").alias("n")).scalar()
    return lookup_join(freq, flagged, "token", ["n"]).select(
        "token", "n", F.coalesce("_stop", F.lit(False)).alias("is_stop"), size.alias("stop_words"))


SENTENCES = r"""list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""


@query("t7_sentences", f"""
SELECT doc_id, unnest(range(0, len(s))) AS sent_id, unnest(s) AS sentence FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)""")
def sentences(t):
    return tokens.sentence_rows(t.texts, "doc_id", "text").withColumn("sent_id", F.col("sent_id").cast("bigint"))


@query("t7_sentence_starts", f"""
WITH s AS (SELECT doc_id, unnest(range(0, len(s))) AS sent_id, unnest(s) AS sentence FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)),
w AS (SELECT doc_id, sent_id, regexp_extract_all(sentence, '{WORD}') AS w FROM s)
SELECT doc_id, count(*) FILTER (len(w) > 0) AS starts, sum(len(w))::bigint AS tokens, max(len(w)) AS longest FROM w
GROUP BY 1 HAVING sum(len(w)) > 0""")
def sentence_starts(t):
    rows = tokens.sentence_tokens(t.texts, "doc_id", "text")
    per_sentence = rows.groupBy("doc_id", "sent_id").agg(F.count_if("is_sent_start").alias("s"), F.count("*").alias("n"))
    return per_sentence.groupBy("doc_id").agg(F.sum("s").alias("starts"), F.sum("n").alias("tokens"), F.max("n").alias("longest"))


@query("t8_token_counts", f"SELECT doc_id, len({words_sql('text')}) AS tokens FROM documents")
def token_counts(t):
    return t.texts.select("doc_id", F.size(tokens.word_tokens("text")).cast("bigint").alias("tokens"))


@query("t8_vocabulary_size", f"SELECT count(DISTINCT w) AS words FROM (SELECT unnest({words_sql('text')}) AS w FROM documents)")
def vocabulary_size(t):
    return tokens.word_frequency(t.texts, tokens.word_tokens("text")).agg(F.count("*").alias("words"))


@query("t9_token_access", f"""
WITH w AS (SELECT doc_id, {words_sql('text')} AS w FROM documents)
SELECT doc_id, w[3] AS third, array_to_string(w[3:5], ' ') AS middle, array_to_string(w[greatest(len(w) - 3, 1):], ' ') AS last_four,
  w[len(w)] AS last FROM w""")
def token_access(t):
    words = t.texts.select("doc_id", tokens.word_tokens("text").alias("w"))
    return words.select("doc_id", tokens.token_at("w", 2).alias("third"),
                        F.array_join(tokens.span("w", 2, 5), " ").alias("middle"),
                        F.array_join(tokens.last_tokens("w", 4), " ").alias("last_four"),
                        tokens.token_at("w", -1).alias("last"))


@query("t10_token_attributes", rf"""
WITH f AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \t\n]+')) AS token FROM documents) GROUP BY 1)
SELECT token, n, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(token,
  '\p{{Lu}}', 'X', 'g'), '\p{{Ll}}', 'x', 'g'), '[0-9]', 'd', 'g'), 'X{{5,}}', 'XXXX', 'g'), 'x{{5,}}', 'xxxx', 'g'), 'd{{5,}}', 'dddd', 'g') AS shape,
  regexp_matches(token, '^\p{{L}}+$') AS is_alpha, lower(token) IN ({STOP_SQL}) AS is_stop FROM f""")
def token_attributes(t):
    freq = tokens.word_frequency(t.texts, regex.all_matches("text", r"[^ \t\n]+"))
    return tokens.with_attributes(freq, ENGLISH)


@query("t11_lemmas", f"""
WITH {token_cte()}, {tagged_ctes('tok')}, {LEMMA_CTES}
SELECT token, tag, lemma, count(*) AS n FROM lemmas GROUP BY 1, 2, 3""")
def lemmas(t):
    rows = tagging.tagged_rows(t.texts, "doc_id", tokens.word_tokens("text"))
    per_word = rows.filter(F.col("token").isNotNull()).groupBy("token", "tag").agg(F.count("*").alias("n"))
    return tagging.with_lemmas(per_word, tagging.lemma_table(t.spark), ["n"]).select("token", "tag", "lemma", "n")


@query("t12_learned_tags", f"""
WITH {token_cte(lower=False)}, {tagged_ctes('tok')}
SELECT word, tag FROM (SELECT lower(token) AS word, tag, row_number() OVER (PARTITION BY lower(token) ORDER BY count(*) DESC, tag) AS r
FROM tagged GROUP BY 1, 2) WHERE r = 1""")
def learned_tags(t):
    rows = tagging.tagged_rows(t.texts, "doc_id", tokens.word_tokens("text", lower=False))
    return tagging.learn_tags(rows)


@query("t12_applied_tags", f"""
WITH {token_cte(lower=False)}, {tagged_ctes('tok')},
lex AS (SELECT word, tag FROM (SELECT lower(token) AS word, tag, row_number() OVER (PARTITION BY lower(token) ORDER BY count(*) DESC, tag) AS r
  FROM tagged GROUP BY 1, 2) WHERE r = 1)
SELECT c.conv_id, lex.tag, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(text, '{WORD}')) AS token FROM conversations) c
JOIN lex ON lower(c.token) = lex.word GROUP BY 1, 2""")
def applied_tags(t):
    # only words the lexicon knows are compared; the fallback by ending is covered by unit tests
    lexicon = learned_tags(t)
    words = t.conversations.select("conv_id", "turn", F.posexplode(tokens.word_tokens("text", lower=False)).alias("pos", "token"))
    known = lexicon.withColumn("_known", F.lit(True))
    tagged = tagging.apply_tags(words, known, ["conv_id", "turn", "pos"]).filter("_known")
    return tagged.groupBy("conv_id", "tag").agg(F.count("*").alias("n"))


@query("t12_tagged_words", f"""
WITH {token_cte(lower=False)}, {tagged_ctes('tok')},
cnt AS (SELECT lower(token) AS word, tag, count(*) AS n FROM tagged GROUP BY 1, 2),
lex AS (SELECT word, tag FROM (SELECT word, tag, row_number() OVER (PARTITION BY word ORDER BY n DESC, tag) AS r FROM cnt) WHERE r = 1),
fin AS (SELECT right(word, k) AS ending, tag, n FROM cnt, range(1, 5) e(k) WHERE k < length(word)),
sfx AS (SELECT ending, tag FROM (SELECT ending, tag, row_number() OVER (PARTITION BY ending ORDER BY sum(n) DESC, tag) AS r FROM fin GROUP BY 1, 2) WHERE r = 1),
c AS (SELECT conv_id, unnest(regexp_extract_all(text, '{WORD}')) AS token FROM conversations),
new AS (SELECT DISTINCT lower(token) AS word FROM c WHERE lower(token) NOT IN (SELECT word FROM lex)),
gss2 AS (SELECT word, max_by(sfx.tag, k) AS tag FROM new, range(1, 5) e(k), sfx WHERE sfx.ending = right(word, k) AND k < length(word) GROUP BY 1)
SELECT c.conv_id, coalesce(lex.tag, gss2.tag, 'NN') AS tag, count(*) AS n, count(*) FILTER (lex.tag IS NULL) AS guessed
FROM c LEFT JOIN lex ON lower(c.token) = lex.word LEFT JOIN gss2 ON lower(c.token) = gss2.word GROUP BY 1, 2""")
def tagged_words(t):
    """Every word of the conversations with a tag learned from the documents, new words by their ending."""
    seen = tagging.tagged_rows(t.texts, "doc_id", tokens.word_tokens("text", lower=False))
    counts = cut_lineage(seen.filter(F.col("token").isNotNull()).groupBy(F.lower("token").alias("token"), "tag").agg(F.count("*").alias("n")))
    lexicon = counts.groupBy(F.col("token").alias("word")).agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("tag"))
    per_conversation = t.conversations.select("conv_id", F.explode(tokens.word_tokens("text")).alias("word")).groupBy("conv_id", "word").agg(F.count("*").alias("n"))
    known = lexicon.withColumn("known", F.lit(True))
    words = per_conversation.select("word").distinct()
    tagged = tagging.tag_words(words, lexicon, tagging.learn_endings(counts, weight="n")).join(known.select("word", "known"), "word", "left")
    return salted_join(per_conversation, tagged, "word", ["conv_id"]).groupBy("conv_id", "tag").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("guessed"))


@query("t13_tag_glossary", f"""
WITH {token_cte(lower=False)}, {tagged_ctes('tok')}
SELECT t.tag, t.n, v.meaning FROM (SELECT tag, count(*) AS n FROM tagged GROUP BY 1) t
LEFT JOIN (VALUES {', '.join(f"('{k}','{v}')" for k, v in tagging.TAG_NAMES.items())}) v(tag, meaning) ON t.tag = v.tag""")
def tag_glossary(t):
    rows = tagging.tagged_rows(t.texts, "doc_id", tokens.word_tokens("text", lower=False))
    return tagging.explain(rows.filter(F.col("tag").isNotNull()).groupBy("tag").agg(F.count("*").alias("n"))).select("tag", "n", "meaning")


@query("t14_tag_counts", f"""
WITH {token_cte(lower=False)}, {tagged_ctes('tok')}
SELECT d.doc_id, count(*) FILTER (tag IN ({NOUNS})) AS nouns, count(*) FILTER (tag IN ({VERBS})) AS verbs,
  count(*) FILTER (tag NOT IN ({NOUNS}, {VERBS})) AS others FROM documents d LEFT JOIN tagged ON d.doc_id = tagged.doc_id GROUP BY 1""")
def tag_counts(t):
    rows = tagging.tagged_rows(t.texts, "doc_id", tokens.word_tokens("text", lower=False))
    noun, verb = F.col("tag").isin(tagging.NOUN_TAGS), F.col("tag").isin(tagging.VERB_TAGS)
    return rows.groupBy("doc_id").agg(F.count_if(noun).alias("nouns"), F.count_if(verb).alias("verbs"),
                                      F.count_if(~noun & ~verb).alias("others"))


@query("t15_pattern_entities", " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, unnest(regexp_extract_all(text, '{p}')) AS entity FROM "
    f"(SELECT doc_id, text FROM documents UNION ALL SELECT page_id, html || ' ' || url FROM pages)"
    for label, p in tagging.ENTITY_PATTERNS))
def pattern_entities(t):
    texts = t.texts.select("doc_id", "text").unionByName(
        t.pages.select(F.col("page_id").alias("doc_id"), F.concat_ws(" ", "html", "url").alias("text")))
    return tagging.pattern_entities(texts, "doc_id", "text")


# Names that occur in the generated prose.
NAMES = [("of the", "PLACE"), ("in the of", "PLACE"), ("la", "PERSON"), ("que des", "GROUP"), ("und der", "GROUP")]


@query("t15_name_entities", f"""
WITH {token_cte(lower=False)}, g AS (SELECT doc_id, token AS a, lead(token, 1) OVER w AS b, lead(token, 2) OVER w AS c FROM tok
  WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
ph AS (SELECT doc_id, a AS entity FROM g UNION ALL SELECT doc_id, a || ' ' || b FROM g WHERE b IS NOT NULL
  UNION ALL SELECT doc_id, a || ' ' || b || ' ' || c FROM g WHERE c IS NOT NULL)
SELECT doc_id, label, entity, count(*) AS n FROM ph
JOIN (VALUES {', '.join(f"('{p}','{l}')" for p, l in NAMES)}) v(phrase, label) ON lower(entity) = phrase GROUP BY 1, 2, 3""")
def name_entities(t):
    names = t.spark.createDataFrame(NAMES, "phrase string, label string")
    found = tagging.name_entities(t.texts, "doc_id", tokens.word_tokens("text", lower=False), names)
    return found.groupBy("doc_id", "label", "entity").agg(F.count("*").alias("n"))


@query("t16_noun_chunks", f"""
WITH rt AS (SELECT doc_id, {rule_token_sql('text')} AS w FROM documents),
rtok AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS p, unnest(w) AS token FROM rt), {tagged_ctes('rtok')},
codes AS (SELECT doc_id, string_agg(CASE WHEN tag = 'DT' THEN 'D' WHEN tag = 'JJ' THEN 'J' WHEN tag IN ({NOUNS}) THEN 'N' ELSE '-' END, '' ORDER BY p) AS c
  FROM tagged GROUP BY 1),
parts AS (SELECT doc_id, string_split_regex(c, 'D?J*N+') AS gaps, regexp_extract_all(c, 'D?J*N+') AS ms FROM codes),
u AS (SELECT doc_id, unnest(range(0, len(ms))) AS chunk_no, unnest(gaps[1:len(ms)]) AS gap, unnest(ms) AS m FROM parts),
e AS (SELECT doc_id, chunk_no, m, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY chunk_no)::bigint AS stop_at FROM u)
SELECT e.doc_id, chunk_no, stop_at - length(m) AS start_at, stop_at, array_to_string(rt.w[stop_at - length(m) + 1:stop_at], ' ') AS chunk
FROM e JOIN rt ON e.doc_id = rt.doc_id""")
def noun_chunks(t):
    chunks = tagging.noun_chunk_rows(t.texts, "doc_id", tokens.rule_tokens("text"))
    return chunks.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"),
                         F.col("start").cast("bigint").alias("start_at"), F.col("stop").cast("bigint").alias("stop_at"), "chunk")


VOCABULARY = f"voc AS (SELECT DISTINCT unnest({words_sql('text')}) AS token FROM documents)"
STEM_INDEX = f"""tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({words_sql('text')}) AS token FROM documents) GROUP BY 1, 2),
idx AS (SELECT stem, doc_id, sum(tf)::bigint AS tf FROM tf JOIN stems ON tf.token = stems.token GROUP BY 1, 2)"""


@query("t17_porter_stems", f"WITH {VOCABULARY}, {porter_ctes('voc')} SELECT token, stem FROM stems")
def porter_stems(t):
    words = tokens.word_frequency(t.texts, tokens.word_tokens("text"))
    return stems.stem_vocabulary(words, "porter")


@query("t17_porter2_stems", f"WITH {VOCABULARY}, {porter2_ctes('voc')} SELECT token, stem FROM stems")
def porter2_stems(t):
    words = tokens.word_frequency(t.texts, tokens.word_tokens("text"))
    return stems.stem_vocabulary(words, "porter2")


def stem_counts(t):
    return tokens.term_counts(t.texts, "doc_id", tokens.word_tokens("text")).withColumnRenamed("term", "token")


@query("t18_stem_index", f"WITH {VOCABULARY}, {porter_ctes('voc')}, {STEM_INDEX} SELECT stem, doc_id, tf FROM idx")
def stem_index(t):
    return stems.stem_index(stem_counts(t), "doc_id")


@query("t18_variant_search", f"WITH {VOCABULARY}, {porter_ctes('voc')}, {STEM_INDEX} SELECT stem, doc_id, tf FROM idx WHERE stem = 'thing'")
def variant_search(t):
    return stems.search(stems.stem_index(stem_counts(t), "doc_id"), "things")


@query("t18_stored_search", f"WITH {VOCABULARY}, {porter_ctes('voc')}, {STEM_INDEX} SELECT stem, doc_id, tf FROM idx WHERE stem = 'thing'")
def stored_search(t):
    place = stems.stored_index(stem_counts(t), "doc_id")
    found = stems.stored_search(postings.read_index(t.spark, place), "things")
    return found.select("stem", F.col("key").alias("doc_id"), "tf")


@query("t18_variants", f"""
WITH {VOCABULARY}, {porter_ctes('voc')} SELECT stem, string_agg(token, ' ' ORDER BY token) AS words FROM stems GROUP BY 1""")
def variants(t):
    vocabulary = stems.stem_vocabulary(tokens.word_frequency(t.texts, tokens.word_tokens("text")))
    return stems.variants(vocabulary).select("stem", F.array_join("words", " ").alias("words"))


PROFILE_CTES = f"""{token_cte(lower=True)}, words AS (SELECT * FROM tok WHERE token NOT IN ({STOP_SQL})),
{tagged_ctes('words')}, {LEMMA_CTES},
st AS (SELECT d.doc_id, length(d.text) AS raw_length, len({SENTENCES.replace('text', 'd.text')}) AS num_sentences,
  (SELECT count(*) FROM (SELECT unnest({words_sql('d.text')}))) AS num_tokens FROM documents d),
wc AS (SELECT doc_id, count(*) AS num_words, count(DISTINCT lemma) AS unique_words, count(*) FILTER (tag IN ({NOUNS})) AS nouns,
  count(*) FILTER (tag IN ({VERBS})) AS verbs, count(*) FILTER (tag NOT IN ({NOUNS}, {VERBS})) AS others FROM lemmas GROUP BY 1),
stats AS (SELECT st.doc_id, raw_length, num_sentences, coalesce(unique_words, 0) AS unique_words, coalesce(nouns, 0) AS nouns,
  coalesce(verbs, 0) AS verbs, coalesce(others, 0) AS others, coalesce(num_words, 0) AS num_words, num_tokens
  FROM st LEFT JOIN wc ON st.doc_id = wc.doc_id)"""


COUNTS = ["raw_length", "num_sentences", "unique_words", "nouns", "verbs", "others", "num_words", "num_tokens"]
RATIOS = {"words_fraction": "num_words / nullif(num_tokens, 0)", "nouns_fraction": "nouns / nullif(num_words, 0)",
          "verbs_fraction": "verbs / nullif(num_words, 0)", "others_fraction": "others / nullif(num_words, 0)",
          "uniqwd_fraction": "unique_words / nullif(num_words, 0)",
          "toksxsent_fraction": "num_tokens / nullif(num_sentences, 0) / 25.0::double",
          "raw_length_fraction": "raw_length / 2072.0::double"}


def statistics(t, top_nouns: int = 0):
    # texts meet by document before they are cut into words: one shuffle of texts instead of two of words
    # a task counts all lemmas of its documents at once, so the tasks' number follows the input's pieces
    docs = t.documents.select("doc_id", "text")
    parts = max(t.spark.sparkContext.defaultParallelism, 16 * docs.rdd.getNumPartitions())
    texts = docs.repartition(parts, "doc_id")
    rows = profile.annotated_rows(texts, "doc_id", "text", ENGLISH)
    return profile.statistics(rows, "doc_id", top_nouns)


@query("t19_density_features", f"WITH {PROFILE_CTES} SELECT doc_id, " + ", ".join(
    f"round({e}, 6) AS {n}" for n, e in RATIOS.items()) + " FROM stats")
def density_features(t):
    ratios = profile.density_features(statistics(t))
    return ratios.select("doc_id", *[F.round(n, 6).alias(n) for n in RATIOS])


COHERENCE_CTES = f"""
nc AS (SELECT doc_id, lemma AS noun, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, lemma) AS r
  FROM lemmas WHERE tag IN ({NOUNS}) GROUP BY 1, 2),
tv AS (SELECT doc_id, r, e.embedding::double[] AS v FROM nc JOIN embeddings e
  ON e.vec_id = {hash_sql('noun')} % (SELECT count(*) FROM embeddings) WHERE r <= 25),
co AS (SELECT a.doc_id, {', '.join(f'avg(list_cosine_similarity(a.v, b.v)) FILTER (b.r <= {n}) AS c{n}' for n in profile.NOUN_COUNTS)}
  FROM tv a JOIN tv b ON a.doc_id = b.doc_id AND a.r < b.r GROUP BY 1)"""
COHERENCE_COLUMNS = ", ".join(f"round(coalesce(c{n}, 0), 5) + 0.0 AS text_coherence_{n}" for n in profile.NOUN_COUNTS)


def with_coherence(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector"))
    count = t.embeddings.agg(F.count("*").alias("n")).scalar()
    scores = profile.coherence(statistics(t, max(profile.NOUN_COUNTS)), "doc_id", vectors,
                               lambda noun: hash32(noun) % count)
    return scores.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in scores.columns if c.startswith("text_coherence")})


@query("t20_document_statistics", f"""
WITH {PROFILE_CTES}, {COHERENCE_CTES} SELECT stats.doc_id, {', '.join(COUNTS)}, {COHERENCE_COLUMNS}
FROM stats LEFT JOIN co ON stats.doc_id = co.doc_id""")
def document_statistics(t):
    stats = with_coherence(t)
    return stats.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in COUNTS],
                        *[c for c in stats.columns if c.startswith("text_coherence")])


@query("t21_text_coherence", f"""
WITH {PROFILE_CTES}, {COHERENCE_CTES} SELECT d.doc_id, {COHERENCE_COLUMNS} FROM documents d LEFT JOIN co ON d.doc_id = co.doc_id""")
def text_coherence(t):
    stats = with_coherence(t)
    return stats.select("doc_id", *[c for c in stats.columns if c.startswith("text_coherence")])


@query("t22_length_profile", f"""
SELECT lang, round(avg(length(text)), 4) AS mean_length, round(avg(len({words_sql('text')})), 4) AS mean_tokens, count(*) AS n
FROM documents GROUP BY 1""")
def length_profile(t):
    means = profile.length_profile(t.texts, "lang", "text", tokens.word_tokens("text"))
    return means.select("lang", F.round("mean_length", 4).alias("mean_length"), F.round("mean_tokens", 4).alias("mean_tokens"), "n")


@query("t23_word_frequency", f"""
SELECT token, count(*) AS n FROM (SELECT unnest({words_sql('text')}) AS token FROM documents) GROUP BY 1 ORDER BY n DESC, token""")
def word_frequency(t):
    return tokens.word_frequency(t.texts, tokens.word_tokens("text")).orderBy(F.desc("n"), "token")
