"""Small helpers that the operators of this package share."""

from __future__ import annotations

import re
import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtrail.session import shared_path

WORD_BYTES = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back, so that nothing before it runs again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a URI; tasks use it for files that Spark has no writer for."""
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(path)


def columns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.to_pydict()


def task_name() -> str:
    """A name no other attempt of this or any other task uses."""
    context = TaskContext.get()
    return f"{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex[:12]}"


def running_sum(df: DataFrame, order: list[str], weight: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over all rows that sort before the row by ``order``.

    One range partitioning, in which every task sums its own rows, and a window over one total a
    partition. The result is written below the shared folder. Rows equal in ``order`` get sums in
    an arbitrary order among themselves.
    """
    schema = f"{df.select(*order, *[c for c in df.columns if c not in order])._jdf.schema().toDDL()}"
    ordered = df.select(*order, *[c for c in df.columns if c not in order])

    def sums(batches):
        task, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            weights = np.asarray(batch.column(weight).to_numpy(zero_copy_only=False), dtype=np.int64)
            ends = total + np.cumsum(weights)
            arrays = [*batch.columns, pa.array(ends - weights), pa.array(np.full(len(weights), task, np.int64))]
            if len(ends):
                total = int(ends[-1])
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "_before", "_task"])

    local = stored(ordered.repartitionByRange(*order).sortWithinPartitions(*order)
                   .mapInArrow(sums, f"{schema}, _before BIGINT, _task BIGINT"), "running-sum")
    totals = local.groupBy("_task").agg(F.sum(weight).alias("_total")).selectExpr(
        "_task", "sum(_total) OVER (ORDER BY _task) - _total AS _base")
    return (local.join(F.broadcast(totals), "_task")  # one row a partition
            .withColumn(out, F.col("_before") + F.col("_base")).drop("_before", "_base", "_task"))


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the length of a block; names are written with ``__`` for ``.``."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
