"""Tokens, sentences, stop words and token tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wordtrail.functions import regex
from wordtrail.functions.arrays import counted_items, item_counts
from wordtrail.functions.hashing import _col
from wordtrail.functions.text import is_alpha, shape
from wordtrail.operators.lookup import lookup_join, word_table

# Abbreviations kept as one token.
ABBREVIATIONS = ["Dr", "Jr", "Mr", "Mrs", "Ms", "Prof", "Sr", "St", "etc", "vs"]
# Fixed value: contraction endings that become tokens of their own.
CONTRACTIONS = r"n't|'(?:s|re|ve|ll|d|m)\b"

# Alternatives in order: first hit wins at every position. No look-around, so that other regular
# expression engines read it the same way.
RULE_TOKEN = "|".join([
    regex.URL,
    regex.EMAIL,
    r"(?:[A-Z]\.){2,}",
    "(?:" + "|".join(ABBREVIATIONS) + r")\.",
    r"[0-9][0-9.,]*[0-9]|[0-9]",
    CONTRACTIONS,
    r"[\p{L}_]+",
    r"[^ \t\r\n\p{L}\p{N}_]",
    r"\p{N}",
])
SENTENCE = r"[^.!?]+[.!?]*"


def whitespace_tokens(text: Column | str) -> Column:
    """Lower-case tokens between single white spaces; trailing empty tokens are not kept."""
    lowered = F.lower(_col(text))
    return F.split(F.regexp_replace(lowered, r"\s+$", ""), r"\s", -1)


def word_tokens(text: Column | str, lower: bool = True) -> Column:
    """Runs of letters, digits and underscores."""
    text = _col(text)
    return regex.all_matches(F.lower(text) if lower else text, regex.WORD)


def rule_tokens(text: Column | str) -> Column:
    """Words, numbers, punctuation marks; URLs, e-mail addresses and abbreviations kept whole.

    ``isn't`` becomes ``is`` and ``n't``: the break before ``n't`` is set first.
    """
    opened = F.regexp_replace(_col(text), r"(\p{L})(n't)\b", "$1 $2")
    return regex.all_matches(opened, RULE_TOKEN)


def normalize(tokens: Column | str) -> Column:
    """Lower-case tokens without punctuation; tokens left empty are dropped."""
    clean = F.transform(_col(tokens), lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s]", ""))
    return F.filter(clean, lambda t: t != "")


def remove_stop_words(tokens: Column | str, words: list[str]) -> Column:
    """Tokens not in the list, case-insensitive, in place (no shuffle)."""
    lowered = [w.lower() for w in words]
    return F.filter(_col(tokens), lambda t: ~F.lower(t).isin(lowered))


def stop_rows_removed(tokens: DataFrame, stops: DataFrame, spread: list[str]) -> DataFrame:
    """Token table without the words of a one-column stop table."""
    return lookup_join(tokens, stops, "token", spread, "left_anti")


def edit_stop_table(stops: DataFrame, add: list[str] = (), remove: list[str] = ()) -> DataFrame:
    """Stop table with words added and removed."""
    spark = stops.sparkSession
    if add:
        stops = stops.unionByName(word_table(spark, list(add))).distinct()
    return stops.filter(~F.col("token").isin(list(remove))) if remove else stops


def sentences(text: Column | str) -> Column:
    """Pieces ending in ``. ! ?``, trimmed, blank ones dropped."""
    pieces = F.transform(regex.all_matches(text, SENTENCE), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(pieces, lambda s: s != "")


def sentence_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(sentences(text)).alias("sent_id", "sentence"))


def sentence_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, sent_id, pos, token, is_sent_start)``; ``pos`` counts within the sentence."""
    return (sentence_rows(df, key, text)
            .select(key, "sent_id", F.posexplode(word_tokens("sentence", lower=False)).alias("pos", "token"))
            .withColumn("is_sent_start", F.col("pos") == 0))


def token_rows(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """Long form ``(key, pos, token)``."""
    return df.select(key, F.posexplode(tokens).alias("pos", "token"))


def token_at(tokens: Column | str, index: int) -> Column:
    """Token by 0-based index (negative counts from the end), null outside."""
    tokens = _col(tokens)
    return F.try_element_at(tokens, F.lit(index + 1 if index >= 0 else index))


def span(tokens: Column | str, start: int, stop: int) -> Column:
    """Tokens ``start`` to ``stop`` (exclusive)."""
    return F.slice(_col(tokens), start + 1, stop - start)


def last_tokens(tokens: Column | str, count: int) -> Column:
    """The last ``count`` tokens, or all when there are fewer."""
    tokens = _col(tokens)
    return F.slice(tokens, F.greatest(F.size(tokens) - count, F.lit(0)) + 1, count)


def with_attributes(tokens: DataFrame, stop_words: list[str]) -> DataFrame:
    """Token table with ``shape``, ``is_alpha`` and ``is_stop``."""
    return tokens.withColumns({"shape": shape("token"), "is_alpha": is_alpha("token"),
                               "is_stop": F.lower("token").isin([w.lower() for w in stop_words])})


def word_frequency(df: DataFrame, tokens: Column) -> DataFrame:
    """``(token, n)`` over the corpus; counts are combined before the shuffle."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def term_counts(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``(key, term, tf)``, counted within each row: no shuffle. Rows of the same key are counted apart."""
    counts = df.select(key, F.explode(item_counts(tokens)).alias("_c"))
    return counts.select(key, F.col("_c.item").alias("term"), F.col("_c.n").alias("tf"))


def top_items(df: DataFrame, key: str, items: Column, limit: int = 5) -> DataFrame:
    """The most frequent items of each row's list, most frequent first; ties by first position.

    Counted and ranked within each row: no shuffle.
    """
    ranked = F.transform(counted_items(items), lambda c: F.struct(
        (-c["n"]).alias("order"), c["first"].alias("first"), c["item"].alias("item"), c["n"].alias("n")))
    rows = df.select(key, F.posexplode(F.slice(F.array_sort(ranked), 1, limit)).alias("_i", "_c"))
    return rows.select(key, (F.col("_i") + 1).alias("rank"), F.col("_c.item").alias("item"), F.col("_c.n").alias("n"))
