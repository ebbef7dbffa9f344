"""Key hashes that do not depend on partition layout, seed state or engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash32(*keys: Column | str) -> Column:
    """First 32 bits of the md5 of the key (several keys are joined with ``#``)."""
    text = F.concat_ws("#", *[_col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def unit_hash(*keys: Column | str) -> Column:
    """Key hash scaled to [0, 1)."""
    return hash32(*keys) / F.lit(4294967296.0)


def bucket_of(buckets: int | Column, *keys: Column | str) -> Column:
    """Bucket number 0..buckets-1, in proportion to the unit hash."""
    return F.floor(unit_hash(*keys) * buckets).cast("int")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
