"""Joining long token tables with word tables without trusting the word table to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Word tables up to this many rows are broadcast.
BROADCAST_ROWS = 100_000


def fits_broadcast(table: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Size check that reads no more than ``limit + 1`` rows."""
    return table.limit(limit + 1).count() <= limit


def default_salts(df: DataFrame) -> int:
    """Copies per key: more on a session set up for more shuffle partitions."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(64, max(2, partitions // 16))


def salted_join(rows: DataFrame, table: DataFrame, on: str, spread: list[Column | str],
                how: str = "inner", salts: int | None = None) -> DataFrame:
    """Equi-join for a frequent-word-heavy left side.

    Every key of ``table`` is repeated ``salts`` times and the rows of one key are spread over
    those copies by a hash of ``spread``, so the rows of one word go to several tasks.
    """
    salts = salts or default_salts(rows)
    # never null, so that no filter on the salt is pushed into just one use of ``rows``
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"), F.lit(0))
    salted = rows.withColumn("_salt", salt)
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")


def lookup_join(rows: DataFrame, table: DataFrame, on: str, spread: list[Column | str],
                how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast join when the table passes the size check, salted join otherwise."""
    if fits_broadcast(table, limit):
        return rows.join(F.broadcast(table), on, how)
    return salted_join(rows, table, on, spread, how)


def word_table(spark: SparkSession, words: list[str], column: str = "token") -> DataFrame:
    """One-column table of distinct words."""
    return spark.createDataFrame([(w,) for w in sorted(set(words))], f"{column} string")
