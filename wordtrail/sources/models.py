"""Fitted models on shared storage, found by a small registry table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordtrail.operators.learning import side_by_side

REGISTRY = "registry"


def save_models(spark: SparkSession, base: str, models: dict[str, object]) -> DataFrame:
    """Save each model below ``base``, some side by side, and write the registry ``(key, path)``."""
    rows = [(key, f"{base}/{key}") for key in models]
    list(side_by_side(spark, [partial(models[key].write().overwrite().save, path) for key, path in rows], at_once=8))
    registry = spark.createDataFrame(rows, "key string, path string")
    registry.write.mode("overwrite").parquet(f"{base}/{REGISTRY}")
    return spark.read.parquet(f"{base}/{REGISTRY}")


def load_models(spark: SparkSession, base: str, model_class, word: str = "") -> dict[str, object]:
    """Models whose registered key contains ``word``, by key."""
    rows = spark.read.parquet(f"{base}/{REGISTRY}").filter(F.contains("key", F.lit(word))).orderBy("key")
    found = rows.collect()
    loaded = side_by_side(spark, [partial(model_class.load, r.path) for r in found], at_once=8)
    return {r.key: model for r, model in zip(found, loaded)}


def load_pair_models(spark: SparkSession, base: str, model_class, pairs: list[tuple], word: str = "") -> dict:
    """Lists of models by pair: their key contains the pair's digits in a row, and ``word``."""
    found = load_models(spark, base, model_class, word)
    return {pair: [m for key, m in found.items() if "".join(map(str, pair)) in key] for pair in pairs}
