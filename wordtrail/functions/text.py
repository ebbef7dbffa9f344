"""String measures, templates, padding and token shapes."""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import Column, functions as F

from wordtrail.functions.hashing import _col

# Fixed value: the length by which scored documents are scaled.
LENGTH_SCALE = 2072.0


def paragraph_count(text: Column | str, separator: str = "\n\n") -> Column:
    """Number of pieces between separators; an empty text counts as one."""
    return F.size(F.split(_col(text), re.escape(separator), -1))


def length_fraction(text: Column | str) -> Column:
    return F.length(_col(text)) / F.lit(LENGTH_SCALE)


def mismatches(word: Column | str, other: Column | str) -> Column:
    """Positions of ``word`` whose character differs in ``other``; a missing one counts too."""
    wrong = F.zip_with(_letters(word), _letters(other), lambda a, b: a.isNotNull() & ~a.eqNullSafe(b))
    return F.size(F.filter(wrong, lambda w: w))


def _letters(word: Column | str) -> Column:
    return F.filter(F.split(_col(word), ""), lambda c: c != "")


def template(pattern: str, **values: Column) -> Column:
    """``template("His name is {name}.", name=col)`` as one string column."""
    parts = []
    for literal, field, _, _ in Formatter().parse(pattern):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(values[field].cast("string"))
    return F.concat(*parts)


def quoted(text: Column | str) -> Column:
    """Text in quotes the way a programmer would write it: single quotes unless it holds some."""
    text = _col(text)
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return (F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"')))
             .otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))))


def pad(value: Column | str, width: int, align: str = "<", fill: str = " ") -> Column:
    """Fixed-width text: ``<`` left, ``>`` right, ``^`` centre. Longer values are kept whole."""
    text = _col(value).cast("string")
    target = F.greatest(F.lit(width), F.length(text))
    if align == "<":
        return F.rpad(text, target, F.lit(fill))
    if align == ">":
        return F.lpad(text, target, F.lit(fill))
    left = F.floor((target - F.length(text)) / 2).cast("int") + F.length(text)
    return F.rpad(F.lpad(text, left, F.lit(fill)), target, F.lit(fill))


def long_date(value: Column | str) -> Column:
    """``September 15, 2023``"""
    return F.date_format(_col(value), "MMMM dd, yyyy")


def shape(token: Column | str) -> Column:
    """Token shape such as ``Xxxxx``, ``ddd`` or ``xxx-``; runs of one class stop at four."""
    out = F.regexp_replace(_col(token), r"\p{Lu}", "X")
    out = F.regexp_replace(out, r"\p{Ll}", "x")
    out = F.regexp_replace(out, r"[0-9]", "d")
    for mark in "Xxd":
        out = F.regexp_replace(out, mark + "{5,}", mark * 4)
    return out


def is_alpha(token: Column | str) -> Column:
    return _col(token).rlike(r"^\p{L}+$")
