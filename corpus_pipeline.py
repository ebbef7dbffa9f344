"""Five stages that turn raw documents into token statistics of a clean corpus.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. ``run``
applies them in order to the table ``documents``; between two stages the rows are written as
Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordtrail.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from wordtrail.llm.common import stored
from wordtrail.llm.queries import remainder, tokenizer
from wordtrail.llm.registry import query, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose score is above that of 95 % of the ordinary texts it was calibrated on."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0))
    return toxicity.keep_ordinary(docs, model, threshold=model.cut)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document of the smallest id stays."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, digest of the ids and of the decoded text of every document left."""
    return bpe.encode_and_decode(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("decontaminate", drop_benchmark), ("bpe", encode)]
ORACLE_SQL = None  # scores, fingerprints and encodings are outside SQL


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
