"""Regular expressions, tokens, tags, lemmas, stems and formatting on the lesson sentences."""

import pytest
from pyspark.sql import functions as F

from wordtrail.functions import regex, stemming, text
from wordtrail.operators import stems, tagging, tokens
from wordtrail.operators.lookup import word_table


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression.alias("x")).first().x


def test_phone_number(spark):
    phrase = "The agent's phone number is 408-555-1234. Call soon!"
    assert one(spark, phrase, F.contains("t", F.lit("phone")))
    assert [one(spark, phrase, regex.group("t", regex.PHONE, i)) for i in range(4)] == ["408-555-1234", "408", "555", "1234"]
    assert one(spark, "no number", regex.group("t", regex.PHONE, 1)) is None


def test_spans(spark):
    df = spark.createDataFrame([(1, "my phone is a new phone"), (2, "none"), (3, "phone")], "id int, t string")
    spans = [(r.id, r.match_no, r.start, r.end) for r in regex.span_rows(df, "id", "t", "phone").orderBy("id", "start").collect()]
    assert spans == [(1, 0, 3, 8), (1, 1, 18, 23), (3, 0, 0, 5)]
    assert one(spark, "my phone is a new phone", regex.first_span("t", "phone")) == (3, 8)
    assert one(spark, "none", regex.first_span("t", "phone")) is None


def test_span_text_is_the_match(spark):
    phrase = "thé thin thing, then nothing — the end"
    rows = regex.span_rows(spark.createDataFrame([(1, phrase)], "id int, t string"), "id", "t", "th[a-z]*").collect()
    assert rows and all(phrase[r.start:r.end] == r.match for r in rows)


@pytest.mark.parametrize("pattern, phrase, found", [
    (r"[^\d]+", "there are 3 numbers 34 inside 5 this sentence.", ["there are ", " numbers ", " inside ", " this sentence."]),
    (regex.HYPHENATED, "Only find the hypen-words in this sentence. But you do not know how long-ish they are", ["hypen-words", "long-ish"]),
    (".at", "The cat in the hat sat here.", ["cat", "hat", "sat"]),
    ("...at", "The bat went splat", ["e bat", "splat"]),
    (r"\S+at", "The bat went splat", ["bat", "splat"]),
    (r"cat(?:fish|nap|claw)", "catfish catnap caterpillar", ["catfish", "catnap"]),
])
def test_all_matches(spark, pattern, phrase, found):
    assert one(spark, phrase, regex.all_matches("t", pattern)) == found


def test_punctuation_removed(spark):
    phrase = "This is a string! But it has punctuation. How can we remove it?"
    assert one(spark, phrase, regex.keep_and_join("t")) == "This is a string But it has punctuation How can we remove it"


@pytest.mark.parametrize("phrase, expected", [
    ("We're here to help! Send snail-mail, email support@oursite.com or visit us at http://www.oursite.com!",
     ["We", "'re", "here", "to", "help", "!", "Send", "snail", "-", "mail", ",", "email", "support@oursite.com", "or",
      "visit", "us", "at", "http://www.oursite.com", "!"]),
    ("A 5km NYC cab ride costs $10.30", ["A", "5", "km", "NYC", "cab", "ride", "costs", "$", "10.30"]),
    ("Let's visit St. Louis in the U.S. next year.",
     ["Let", "'s", "visit", "St.", "Louis", "in", "the", "U.S.", "next", "year", "."]),
    ("It isn't", ["It", "is", "n't"]),
])
def test_rule_tokens(spark, phrase, expected):
    assert one(spark, phrase, tokens.rule_tokens("t")) == expected


def test_sentences_and_starts(spark):
    phrase = "This is the first sentence. This is another sentence. This is the last sentence."
    df = spark.createDataFrame([(1, phrase)], "id int, t string")
    assert tokens.sentence_rows(df, "id", "t").count() == 3
    starts = tokens.sentence_tokens(df, "id", "t").filter("is_sent_start").collect()
    assert [r.token for r in starts] == ["This"] * 3


def test_token_access(spark):
    words = tokens.word_tokens("t", lower=False)
    phrase = "It is better to give than to receive"
    assert one(spark, phrase, tokens.token_at(words, 2)) == "better"
    assert one(spark, phrase, tokens.token_at(words, 99)) is None
    assert one(spark, phrase, tokens.span(words, 2, 5)) == ["better", "to", "give"]
    assert one(spark, phrase, tokens.last_tokens(words, 3)) == ["than", "to", "receive"]
    assert one(spark, "two words", tokens.last_tokens(words, 4)) == ["two", "words"]


def test_stop_list(spark):
    base = word_table(spark, ["the", "beyond", "into"])
    longer = tokens.edit_stop_table(base, add=["btw"])
    assert longer.count() == 4 and tokens.edit_stop_table(longer, remove=["beyond"]).count() == 3
    assert one(spark, "The cat", tokens.remove_stop_words(tokens.word_tokens("t", lower=False), ["the"])) == ["cat"]


STEMS = {  # word: (Porter, Porter2)
    "run": ("run", "run"), "runner": ("runner", "runner"), "running": ("run", "run"), "ran": ("ran", "ran"),
    "runs": ("run", "run"), "easily": ("easili", "easili"), "fairly": ("fairli", "fair"),
    "consolingly": ("consolingli", "consol"), "caresses": ("caress", "caress"), "ponies": ("poni", "poni"),
    "generously": ("gener", "generous"), "generation": ("gener", "generat"), "relational": ("relat", "relat"),
    "hopping": ("hop", "hop"), "agreed": ("agre", "agre"), "electrical": ("electr", "electr"),
    "meeting": ("meet", "meet"), "controll": ("control", "control"), "sky": ("sky", "sky"), "by": ("by", "by"),
    "skies": ("sky", "sky"), "cement": ("cement", "cement"), "proceed": ("proceed", "proceed"),
    "knightly": ("knightli", "knight"), "cries": ("cri", "cri"), "say": ("say", "say"), "sized": ("size", "size"),
}


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "w string")
    rows = df.select("w", stemming.porter("w").alias("p"), stemming.porter2("w").alias("q")).collect()
    assert {r.w: (r.p, r.q) for r in rows} == STEMS


def test_variant_search(spark):
    counts = spark.createDataFrame([(1, "boats", 2), (2, "boating", 1), (2, "boat", 4), (3, "goat", 1)],
                                   "doc_id int, token string, tf long")
    hits = stems.search(stems.stem_index(counts, "doc_id"), "boat").collect()
    assert {(r.doc_id, r.tf) for r in hits} == {(1, 2), (2, 5)}


def tagged(spark, phrase):
    words = tokens.rule_tokens("t")
    tags = one(spark, phrase, tagging.tag_tokens(words))
    lemmas = one(spark, phrase, tagging.lemmatize(words, tagging.tag_tokens(words)))
    return list(zip(one(spark, phrase, words), tags, lemmas))


def test_meeting_as_verb_and_noun(spark):
    found = [(tag, lemma) for word, tag, lemma in tagged(spark, "I am meeting him tomorrow at the meeting.") if word == "meeting"]
    assert found == [("VBG", "meet"), ("NN", "meeting")]


def test_irregular_lemmas(spark):
    lemmas = {word: lemma for word, _, lemma in tagged(spark, "I saw eighteen mice today! I am running since I ran")}
    assert lemmas["saw"] == "see" and lemmas["mice"] == "mouse" and lemmas["eighteen"] == "eighteen"
    assert lemmas["running"] == lemmas["ran"] == "run"


def test_row_tags_equal_in_place_tags(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    words = tokens.rule_tokens("text")
    in_place = docs.select("doc_id", F.posexplode(tagging.tag_tokens(words)).alias("pos", "tag"))
    rows = tagging.tagged_rows(docs, "doc_id", words).select("doc_id", "pos", "tag")
    assert in_place.exceptAll(rows).isEmpty() and rows.exceptAll(in_place).isEmpty()


def test_text_without_words_keeps_a_row(spark):
    df = spark.createDataFrame([(1, ""), (2, "a word")], "id int, t string")
    rows = tagging.tagged_rows(df, "id", tokens.word_tokens("t")).orderBy("id", "pos").collect()
    assert [(r.id, r.token) for r in rows] == [(1, None), (2, "a"), (2, "word")]


def test_learned_tags_and_fallback(spark):
    rows = spark.createDataFrame([("Run", "NN"), ("run", "VB"), ("run", "VB"), ("tie", "VB"), ("tie", "NN")], "token string, tag string")
    lexicon = tagging.learn_tags(rows)
    assert {r.word: r.tag for r in lexicon.collect()} == {"run": "VB", "tie": "NN"}
    words = spark.createDataFrame([(0, "Run"), (1, "walking"), (2, "quickly")], "pos int, token string")
    assert [r.tag for r in tagging.apply_tags(words, lexicon, ["pos"]).orderBy("pos").collect()] == ["VB", "VBG", "RB"]


def test_noun_chunks(spark):
    df = spark.createDataFrame([(1, "the old house of a friend , some red"), (2, "")], "id int, t string")
    rows = tagging.noun_chunk_rows(df, "id", F.split("t", " ")).orderBy("start").collect()
    assert [(r.start, r.stop, r.chunk) for r in rows if r.chunk] == [(0, 3, "the old house"), (4, 6, "a friend")]


def test_very_long_noun_chunk(spark):
    df = spark.createDataFrame([(1, "stone " * 50000)], "id int, t string")
    row = tagging.noun_chunk_rows(df, "id", tokens.word_tokens("t")).first()
    assert (row.start, row.stop) == (0, 50000)


def test_entities(spark):
    df = spark.createDataFrame([(1, "Apple to build a Hong Kong factory for $6 million")], "id int, t string")
    money = tagging.pattern_entities(df, "id", "t").collect()
    names = tagging.name_entities(df, "id", tokens.rule_tokens("t"), tagging.gazetteer_table(spark)).collect()
    assert [(r.label, r.entity) for r in money] == [("MONEY", "$6 million")]
    assert {(r.label, r.entity) for r in names} == {("ORG", "Apple"), ("GPE", "Hong Kong")}


def test_formatting(spark):
    assert one(spark, "Fred", text.template("His name is {n}.", n=F.col("t"))) == "His name is Fred."
    assert one(spark, "Fred", text.quoted("t")) == repr("Fred") and one(spark, "it's", text.quoted("t")) == repr("it's")
    for align in "<>^":
        for value in ("95", "Mythology", "Mythologically"):
            assert one(spark, value, text.pad("t", 10, align, "_")) == f"{value:_{align}10}"
    assert one(spark, "2023-09-15", text.long_date(F.to_date("t"))) == "September 15, 2023"
    assert one(spark, "Tesla-2024", text.shape("t")) == "Xxxxx-dddd"
    assert one(spark, "a\n\nb\n\n", text.paragraph_count("t")) == 3 and one(spark, "", text.paragraph_count("t")) == 1


@pytest.mark.parametrize("a, b, n", [("word", "ward", 1), ("word", "wo", 2), ("wo", "word", 0), ("", "x", 0)])
def test_mismatches(spark, a, b, n):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(text.mismatches("a", "b").alias("n")).first()
    assert row.n == n


def test_chunk_marks_inside_tokens_are_removed(spark):
    df = spark.createDataFrame([(1, ["the", "old\u0002\u0001", "house\u0003"])], "id int, t array<string>")
    row = tagging.noun_chunk_rows(df, "id", F.col("t")).first()
    assert (row.start, row.stop, row.chunk) == (0, 3, "the old house")


def test_counts_within_a_row_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None)], "id int, t string")
    counts = tokens.term_counts(df, "id", tokens.word_tokens("t"))
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 1), (1, "b", 2)]
    assert [tuple(r) for r in tokens.top_items(df, "id", tokens.word_tokens("t"), 1).collect()] == [(1, 1, "b", 2)]


def test_chunk_letters_are_those_of_the_tags(spark):
    import random

    r = random.Random(4)
    pool = [w for words in tagging.WORD_TAGS.values() for w in words] + [f"x{e}" for ends in tagging.ENDING_TAGS.values() for e in ends]
    pool += ["dog", "Paris", "PARIS", "To", "THE", "3.5", "3ing", "--", "\u00fcber", "\u00c9ly", "\u0130ng", "'", "ing", "ed", "", None, "al", "\u4e2d", "7th"]
    rows = [(i, [r.choice(pool) for _ in range(200)]) for i in range(60)] + [(60, []), (61, None)]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    letters = F.transform(tagging.tag_tokens("words"), lambda t: F.when(t == "DT", "D").when(t.isin("JJ", "JJR", "JJS"), "J").when(t.isin(tagging.NOUN_TAGS), "N").otherwise("-"))
    assert df.filter(~letters.eqNullSafe(tagging.chunk_letters("words"))).count() == 0


def test_marks_in_a_text_do_not_cut_chunks(spark):
    df = spark.createDataFrame([(1, ["the", "\u0002red\u0001", "dog\u0003", "ran"])], "id long, words array<string>")
    assert [tuple(r) for r in tagging.noun_chunk_rows(df, "id", F.col("words")).collect()] == [(1, 0, 0, 3, "the red dog")]
