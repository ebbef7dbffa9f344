"""Stemming over the distinct vocabulary, and a stem index for variant search."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, functions as F

from wordtrail.functions.stemming import porter, porter2
from wordtrail.operators import postings
from wordtrail.operators.lookup import fits_broadcast, salted_join
from wordtrail.session import cut_lineage

STEMMERS = {"porter": porter, "porter2": porter2}
# Counts, stems and key of the indexes planned here.
_MADE_OF: WeakKeyDictionary[DataFrame, tuple[DataFrame, DataFrame, str]] = WeakKeyDictionary()


def stem_vocabulary(tokens: DataFrame, algorithm: str = "porter") -> DataFrame:
    """``(token, stem)``, each distinct word stemmed once.

    A stem costs far more than its word's few bytes tell, by which adaptive execution would join the
    words into one or two tasks; so they are dealt out by number. A condition on the stem stays above
    the generator, as Spark would otherwise move it, and the stemming, below the distinct step.
    """
    context = tokens.sparkSession.sparkContext
    parts = max(context.defaultParallelism, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return tokens.select("token").distinct().repartition(parts, "token").select("token", F.explode(F.array(STEMMERS[algorithm]("token"))).alias("stem"))


def stem_index(counts: DataFrame, key: str, algorithm: str = "porter") -> DataFrame:
    """Inverted index ``(stem, key, tf)`` from ``(key, token, tf)`` counts."""
    stems, joined = _stemmed(counts, key, algorithm)
    index = _by_stem(joined, key)
    _MADE_OF[index] = counts, stems, key
    return index


def _stemmed(counts: DataFrame, key: str, algorithm: str) -> tuple[DataFrame, DataFrame]:
    """The stems of the distinct words, and the counts with them."""
    # reading tf here keeps both uses of the counts alike, so their shuffle is done once
    stems = stem_vocabulary(counts.filter(F.col("tf") > 0), algorithm)
    return stems, salted_join(counts, stems, "token", [key])


def _by_stem(joined: DataFrame, key: str) -> DataFrame:
    return joined.groupBy("stem", key).agg(F.sum("tf").alias("tf"))


def stored_index(counts: DataFrame, key: str, algorithm: str = "porter", place: str | None = None) -> str:
    """Write the stem index as blocks of postings; returns its folder.

    Each distinct word is stemmed once, not once a text that holds it. The counts of a stem's words are
    added up where its blocks are made, so they are not shuffled for that alone.
    """
    _, joined = _stemmed(counts, key, algorithm)
    return postings.write_index(joined, key, "stem", place, added_up=True)


def stored_search(blocks: DataFrame, word: str, algorithm: str = "porter") -> DataFrame:
    """``(stem, key, tf)`` of the texts with any word of the query word's stem; reads one bucket, no text."""
    wanted = blocks.sparkSession.range(1).select(STEMMERS[algorithm](F.lit(word))).first()[0]
    return postings.search(blocks, wanted).withColumnRenamed("term", "stem")


def variants(vocabulary: DataFrame) -> DataFrame:
    """All words sharing a stem, as a sorted list (bounded by the words of one stem)."""
    return vocabulary.groupBy("stem").agg(F.array_sort(F.collect_set("token")).alias("words"))


def search(index: DataFrame, word: str, algorithm: str = "porter") -> DataFrame:
    """Texts with any word that has the query word's stem.

    Of an index that ``stem_index`` has planned, the words of the stem are looked up first, and only
    their counts are joined: no other word leaves its text's row.
    """
    wanted = F.lit(index.sparkSession.range(1).select(STEMMERS[algorithm](F.lit(word))).first()[0])
    if index in _MADE_OF:
        counts, stems, key = _MADE_OF[index]
        words = cut_lineage(stems.filter(F.col("stem") == wanted))
        if fits_broadcast(words):
            return _by_stem(counts.join(F.broadcast(words), "token"), key)
    return index.filter(F.col("stem") == wanted)
