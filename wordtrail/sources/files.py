"""CSV, parquet and text files, inline tables and score logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, multiline: bool = False) -> DataFrame:
    """Header, comma, ``"`` as quote and as escape; the schema is given, never inferred.

    ``multiline`` allows line breaks inside quotes; such a file is read by one task, so large
    inputs should come as many files.
    """
    reader = spark.read.schema(schema).options(
        header=True, sep=",", quote='"', escape='"', multiLine=multiline,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return reader.csv(path) if multiline else reader.option("lineSep", "\n").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV files with header, written by all tasks."""
    (df.write.mode(mode)
       .options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                ignoreTrailingWhiteSpace=False, emptyValue='""')
       .csv(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row ``value`` per line."""
    return spark.read.text(path, lineSep="\n")


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line)``: the first line of every file.

    Only the split that starts a file is looked at; rows of one split keep the file's order.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"))
    opening = lines.filter(F.col("start") == 0).withColumn("_n", F.monotonically_increasing_id())
    return opening.groupBy("path").agg(F.min_by("value", "_n").alias("line"))


def write_lines(df: DataFrame, column: str, path: str, append: bool = False) -> None:
    df.select(column).write.mode("append" if append else "overwrite").text(path, lineSep="\n")


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def empty_table(spark: SparkSession, columns: list[str]) -> DataFrame:
    """No rows; every column a nullable float."""
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.FloatType(), True) for c in columns]))


def log_entries(lines: DataFrame) -> DataFrame:
    """``(key, number)`` from ``key: value`` lines; number is null when it is none."""
    parts = F.split("value", ":", -1)
    return lines.select(F.trim(F.get(parts, F.lit(0))).alias("key"),
                        F.trim(F.get(parts, F.lit(1))).try_cast("double").alias("number"))


def log_mean(lines: DataFrame, expression: str) -> DataFrame:
    """Mean of the values whose key contains the expression; null when there is none."""
    hits = log_entries(lines).filter(F.contains("key", F.lit(expression)))
    return hits.agg(F.avg("number").alias("mean"))
