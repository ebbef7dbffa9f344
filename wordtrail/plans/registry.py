"""Registration of queries and the SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordtrail.session import widen

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """``t.events`` is the parquet table ``events`` of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @property
    def texts(self) -> DataFrame:
        """The documents, spread over the cores when they come in fewer pieces."""
        return widen(self.documents, "doc_id")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its comparison SQL if any."""
    def add(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = sql
        return fn
    return add


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)


WORD = r"[\p{L}\p{N}_]+"


def hash_sql(key: str) -> str:
    return f"('0x'||substr(md5(({key})::varchar),1,8))::bigint"


def unit_sql(key: str) -> str:
    return f"({hash_sql(key)}/4294967296.0::double)"


def words_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}),'{WORD}')"


def quoted_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
