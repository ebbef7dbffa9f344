"""Session settings and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wordtrail", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, skew-join splitting and a fixed time zone.

    Shuffle partitions are left to the cluster's own setting unless passed in ``conf``;
    adaptive execution coalesces them to the data.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def widen(df: DataFrame, key: str) -> DataFrame:
    """Spread a table that is stored in fewer pieces than there are cores.

    For tables as they are read, before any shuffle. A large table has more pieces than there are
    cores and passes through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def shared_base(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a part of the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return (base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_base(spark)}/wordtrail/{name}-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Delete the tables, archives and files that this library has left below the shared folder.

    Results are read from them, so call it when none is needed any more. Spark's own checkpoints are
    not touched: ``spark.cleaner.referenceTracking.cleanCheckpoints`` clears those.
    """
    removed(spark, f"{shared_base(spark)}/wordtrail")


def removed(spark: SparkSession, folder: str) -> None:
    """Delete one folder of this library's below the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a parquet table in the shared folder: as reliable as a checkpoint, and packed."""
    return kept(df, name)[0]


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written``, and the folder, for those who delete it when its rows are used up."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action in this block go when it ends. For steps that write what others read:
    what is left of them otherwise stays until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
