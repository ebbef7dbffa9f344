"""Regular-expression column functions with 0-based spans.

Patterns are Java regular expressions. ``\\w`` and ``\\d`` are ASCII there; use ``\\p{L}`` and
``\\p{N}`` for letters and digits of any script.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wordtrail.functions.hashing import _col

# Portable patterns.
WORD = r"[\p{L}\p{N}_]+"
PHONE = r"(\d{3})-(\d{3})-(\d{4})"
EMAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]"
URL = r"https?://[^ \t\n<>\"]+[^ \t\n<>\".,!?]"
MONEY = r"[$][0-9][0-9.,]*(?: (?:thousand|million|billion))?"
HYPHENATED = r"[\p{L}\p{N}_]+-[\p{L}\p{N}_]+"
NOT_PUNCTUATION = r"[^!.? ]+"


def matches(text: Column | str, pattern: str) -> Column:
    """True when the pattern occurs anywhere in the text."""
    return _col(text).rlike(pattern)


def first_match(text: Column | str, pattern: str) -> Column:
    """The first matching piece, null when there is none."""
    return F.regexp_substr(_col(text), F.lit(pattern))


def first_span(text: Column | str, pattern: str) -> Column:
    """``struct<start, end>`` of the first match (end exclusive), null when there is none."""
    text = _col(text)
    start = F.length(F.get(F.split(text, pattern, 2), F.lit(0)))
    match = first_match(text, pattern)
    return F.when(match.isNotNull(),
                  F.struct(start.alias("start"), (start + F.length(match)).alias("end")))


def all_matches(text: Column | str, pattern: str) -> Column:
    """Array of all matching pieces in order."""
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0))


def count_matches(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(_col(text), F.lit(pattern))


def group(text: Column | str, pattern: str, index: int = 0) -> Column:
    """Numbered group of the first match (0 = whole match), null when nothing matches."""
    text = _col(text)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, index))


def keep_and_join(text: Column | str, pattern: str = NOT_PUNCTUATION, glue: str = " ") -> Column:
    """The matching pieces joined again, e.g. the text without its punctuation."""
    return F.array_join(all_matches(text, pattern), glue)


def span_rows(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """One row per match: ``(key, match_no, start, end, match)``.

    The running offset is a window over the pieces of one text, which all come from one row,
    so a window partition never grows with the table.
    """
    pieces = F.arrays_zip(F.split(F.col(text), pattern, -1).alias("gap"),
                          all_matches(text, pattern).alias("match"))
    rows = df.select(key, F.posexplode(pieces).alias("match_no", "piece"))
    before = Window.partitionBy(key).orderBy("match_no").rowsBetween(Window.unboundedPreceding, 0)
    piece_end = F.length("piece.gap") + F.coalesce(F.length("piece.match"), F.lit(0))
    end = F.sum(piece_end).over(before).cast("int")
    return (rows.select(key, "match_no", end.alias("end"), F.col("piece.match").alias("match"))
                .filter(F.col("match").isNotNull())
                .select(key, "match_no", (F.col("end") - F.length("match")).alias("start"),
                        "end", "match"))
