"""Per-document statistics, density features and text coherence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from wordtrail.functions.arrays import dot, let, unit_vector
from wordtrail.functions.text import LENGTH_SCALE
from wordtrail.operators import tagging
from wordtrail.operators.lookup import salted_join
from wordtrail.operators.tokens import normalize, remove_stop_words, sentences, word_tokens

# Fixed value: tokens per sentence are scaled by this.
SENTENCE_SCALE = 25.0
# How many frequent nouns the coherence measures look at.
NOUN_COUNTS = [5, 10, 15, 20, 25]


def annotated_rows(df: DataFrame, key: str, text: str, stop_words: list[str]) -> DataFrame:
    """One row per word (normalized, no stop word) with ``tag`` and ``lemma``; the document's own
    measures ride along. A document without words keeps one row with nulls. No shuffle."""
    measured = df.select(key, F.length(text).alias("raw_length"), F.size(sentences(text)).alias("num_sentences"),
                         word_tokens(text, lower=False).alias("_tokens"))
    counted = measured.withColumn("num_tokens", F.size("_tokens"))
    words = remove_stop_words(normalize("_tokens"), stop_words)
    rows = tagging.tagged_rows(counted, key, words, *MEASURES)
    return rows.withColumn("lemma", tagging.lemma_of(F.col("token"), F.col("tag")))


# Per-document measures that are known before the words are looked at.
MEASURES = ["raw_length", "num_sentences", "num_tokens"]


def statistics(rows: DataFrame, key: str, top_nouns: int = 0) -> DataFrame:
    """Counts per document from :func:`annotated_rows`; with ``top_nouns`` also ``top``, its most
    frequent nouns as ``array<struct<negative, noun>>`` (ties alphabetical).

    Words are first counted per (document, lemma); the noun list is bounded by one document's
    vocabulary. Rows of a table that was dealt out by its key stay where they are.
    """
    is_noun, is_verb = F.col("tag").isin(tagging.NOUN_TAGS), F.col("tag").isin(tagging.VERB_TAGS)
    per_lemma = rows.groupBy(key, "lemma").agg(
        F.count_if(is_noun).alias("nouns"), F.count_if(is_verb).alias("verbs"),
        F.count_if(~is_noun & ~is_verb).alias("others"), *[F.max(m).alias(m) for m in MEASURES])
    top = []
    if top_nouns:
        nouns = F.collect_list(F.when(F.col("nouns") > 0, F.struct((-F.col("nouns")).alias("negative"),
                                                                   F.col("lemma").alias("noun"))))
        top = [F.slice(F.array_sort(nouns), 1, top_nouns).alias("top")]
    return per_lemma.groupBy(key).agg(
        *[F.max(m).alias(m) for m in MEASURES], F.count("lemma").alias("unique_words"),
        *[F.sum(c).alias(c) for c in ("nouns", "verbs", "others")], *top,
    ).withColumns({"num_words": F.col("nouns") + F.col("verbs") + F.col("others"),
                   "raw_length_fraction": F.col("raw_length") / F.lit(LENGTH_SCALE)})


def density_features(stats: DataFrame) -> DataFrame:
    """Ratios of the counts; null where the denominator is zero."""
    def ratio(a: str, b: str) -> Column:
        return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return stats.withColumns({
        "words_fraction": ratio("num_words", "num_tokens"),
        "nouns_fraction": ratio("nouns", "num_words"),
        "verbs_fraction": ratio("verbs", "num_words"),
        "others_fraction": ratio("others", "num_words"),
        "uniqwd_fraction": ratio("unique_words", "num_words"),
        "toksxsent_fraction": ratio("num_tokens", "num_sentences") / SENTENCE_SCALE})


def coherence(stats: DataFrame, key: str, vectors: DataFrame,
              vector_key: Callable[[Column], Column] = lambda noun: noun,
              sizes: list[int] = NOUN_COUNTS) -> DataFrame:
    """Statistics with ``text_coherence_<n>``: the mean cosine over all pairs of the document's n
    most frequent nouns.

    ``stats`` carries ``top`` for at least ``max(sizes)`` nouns, ``vectors`` is ``(word, vector)``
    and ``vector_key`` maps a noun to its ``word``. No pairs are formed: with unit vectors u the
    pair sum is ``(|sum u|^2 - sum |u|^2) / 2``. Fewer than two nouns give 0.0.
    """
    # the counts ride with the first noun only, and vectors as they are stored: a noun's row is its vector and little more
    carried = [c for c in stats.columns if c not in (key, "top")]
    exploded = stats.select(key, F.struct(*carried).alias("_stats"), F.posexplode_outer("top").alias("rank", "_n"))
    nouns = exploded.select(key, F.when(F.coalesce("rank", F.lit(0)) == 0, F.col("_stats")).alias("_stats"), "rank",
                            vector_key(F.col("_n.noun")).alias("word"))
    found = salted_join(nouns, vectors.select("word", "vector"), "word", [key], "left")
    kept = F.collect_list(F.when(F.col("vector").isNotNull(), F.struct("rank", "vector")))
    gathered = found.groupBy(key).agg(F.max("_stats").alias("_stats"), F.array_sort(kept).alias("_found"))

    def measured(noun: Column) -> Column:
        return let(unit_vector(noun.vector), lambda unit: F.struct(
            noun["rank"].alias("rank"), unit.alias("unit"), F.round(dot(unit, unit)).alias("square")))

    per_doc = gathered.select(key, *[F.col("_stats")[c].alias(c) for c in carried], F.transform("_found", measured).alias("top"))
    scored = per_doc.select(key, *carried, _mean_cosines(sizes).alias("_scores"))
    return scored.select(key, *carried, *[F.get("_scores", F.lit(i)).alias(f"text_coherence_{n}")
                                          for i, n in enumerate(sizes)])


def _mean_cosines(sizes: list[int]) -> Column:
    """Mean pair cosine of the first n vectors for every n in ascending ``sizes``; the vector sum
    grows from one size to the next."""
    def step(i: int, total: Column, means: list[Column]) -> Column:
        if i == len(sizes):
            return F.array(*means)
        start, stop = (sizes[i - 1] if i else 0), sizes[i]
        block = F.filter("top", lambda t: (t["rank"] >= start) & (t["rank"] < stop))
        grown = F.aggregate(block, total, lambda s, v: F.zip_with(s, v.unit, lambda x, y: x + y))
        upto = F.filter("top", lambda t: t["rank"] < stop)
        squares = F.aggregate(upto, F.lit(0.0), lambda s, v: s + v.square)
        pairs = F.size(upto) * (F.size(upto) - 1)
        return let(grown, lambda t: step(i + 1, t, [*means, F.when(pairs > 0, (dot(t, t) - squares) / pairs)
                                                    .otherwise(0.0)]))

    zeros = F.transform(F.get("top", F.lit(0)).unit, lambda x: F.lit(0.0))
    return step(0, zeros, [])


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, vector)``: element-wise mean of all vectors of a group.

    One summary a task and group travels; null vectors do not count.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(
        key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    return rows.groupBy(key).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(key, vector_to_array("_m").alias("vector"))


def length_profile(df: DataFrame, label: str, text: str, tokens: Column) -> DataFrame:
    """Mean text length and mean token count per label."""
    return df.groupBy(label).agg(F.avg(F.length(text)).alias("mean_length"),
                                 F.avg(F.size(tokens)).alias("mean_tokens"), F.count("*").alias("n"))
