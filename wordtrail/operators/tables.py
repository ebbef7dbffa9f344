"""Small relational helpers with fixed semantics for nulls and order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def keep_only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop every column that is not listed, keeping the table's order."""
    return df.select(*[c for c in df.columns if c in set(columns)])


def safe_cast(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast several columns at once; values that do not fit become null."""
    return df.withColumns({name: F.col(name).try_cast(kind) for name, kind in types.items()})


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """First rows by key: a top-k report, the same on every run."""
    return df.orderBy(key).limit(n)


def shuffled_preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Rows in random but repeatable order."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def excluding(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true (rows where it is null stay)."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def pivot_counts(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Counts per row label and listed column value, 0 where none."""
    return df.groupBy(rows).pivot(columns, list(values)).agg(F.count(F.lit(1))).fillna(0)
