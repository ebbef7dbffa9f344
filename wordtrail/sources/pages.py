"""Paged documents: one row per page, page lookups and copying of pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def split_pages(text: Column | str, delimiter: str = "\f") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.split(text, re.escape(delimiter), -1)


def page_rows(df: DataFrame, key: str, text: str, delimiter: str = "\f") -> DataFrame:
    """``(key, page_no, text)``, pages counted from 1."""
    return (df.select(key, F.posexplode(split_pages(text, delimiter)).alias("_p", "text"))
              .select(key, (F.col("_p") + 1).alias("page_no"), "text"))


def page_counts(df: DataFrame, key: str, text: str, delimiter: str = "\f") -> DataFrame:
    return df.select(key, F.size(split_pages(text, delimiter)).alias("pages"))


def page_at(df: DataFrame, key: str, text: str, number: int, delimiter: str = "\f") -> DataFrame:
    """One page of every document (1-based), null where the document is shorter."""
    return df.select(key, F.get(split_pages(text, delimiter), F.lit(number - 1)).alias("text"))


def copy_pages(df: DataFrame, key: str, text: str, numbers: list[int], delimiter: str = "\f") -> DataFrame:
    """Selected pages as a new document, numbered from 1; in place, without a window."""
    wanted = F.filter(split_pages(text, delimiter), lambda page, i: (i + 1).isin(numbers))
    return (df.select(key, F.posexplode(wanted).alias("_p", "text"))
              .select(key, (F.col("_p") + 1).alias("page_no"), "text"))


def full_text(df: DataFrame, key: str, text: str, delimiter: str = "\f", glue: str = "\n") -> DataFrame:
    """All pages of a document joined again."""
    return df.select(key, F.array_join(split_pages(text, delimiter), glue).alias("text"))
