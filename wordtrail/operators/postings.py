"""A stored inverted index: postings in delta-coded blocks, kept by bucket of their term.

A block holds the postings of one term in one span of keys, so a term found in every document
has many blocks and no task ever holds all of its postings. The table is written once, in a
folder a bucket; a search opens the folder of its term, and document frequencies are sums over the
blocks' heads, for which no posting is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from wordtrail.session import shared_path

BUCKETS, SPAN_BITS = 64, 16
WHOLE = {"tinyint", "smallint", "int", "bigint"}


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(counts: DataFrame, key: str, term: str, place: str | None = None, buckets: int = BUCKETS, span_bits: int = SPAN_BITS, added_up: bool = False) -> str:
    """Write the index of ``(key, term, tf)`` counts, one a key and term; returns its folder.
    ``added_up``: a key and term may have several counts, which are added up on the way.

    Columns ``term, span, n, first, gaps, tfs``: ``n`` postings of keys that share their higher
    bits (``span``), the smallest key, the gap of each to the one before (0 for the first), and the
    counts. Keys are whole numbers; postings without a key or term are left out.
    """
    if dict(counts.dtypes)[key] not in WHOLE:
        raise TypeError(f"{key} is {dict(counts.dtypes)[key]}: postings are coded by gaps of whole numbers")
    place = place or shared_path(counts.sparkSession, "index")
    whole = F.col(key).cast("long")
    rows = counts.filter(F.col(key).isNotNull() & F.col(term).isNotNull()).select(
        bucket_of(F.col(term), buckets).alias("bucket"), F.shiftright(whole, span_bits + 4).alias("spans"), F.shiftright(whole, span_bits).alias("span"),
        F.col(term).alias("term"), whole.alias("key"), F.col("tf"))
    # dealt out once, as the files are: a bucket's blocks may come from several tasks, by span, so a frequent term is no single one's
    rows = rows.repartition("bucket", "spans")
    if added_up:
        rows = rows.groupBy("bucket", "spans", "span", "term", "key").agg(F.sum("tf").alias("tf"))
    blocks = rows.select("bucket", "spans", "span", "term", F.struct("key", F.col("tf").cast("int").alias("tf")).alias("p")).groupBy(
        "bucket", "spans", "term", "span").agg(F.sort_array(F.collect_list("p")).alias("p"))  # a span has at most 2 ** span_bits keys
    keys = F.col("p.key")
    gaps = F.zip_with(keys, F.concat(F.slice(keys, 1, 1), F.slice(keys, 1, F.size(keys) - 1)), lambda k, before: (k - before).cast("int"))
    coded = blocks.select("term", "span", F.size("p").alias("n"), F.get(keys, F.lit(0)).alias("first"), gaps.alias("gaps"), F.col("p.tf").alias("tfs"), "bucket")
    coded.sortWithinPartitions("bucket", "term", "span").write.partitionBy("bucket").parquet(place)
    return place


def read_index(spark: SparkSession, place: str) -> DataFrame:
    schema = "term string, span long, n int, first long, gaps array<int>, tfs array<int>, bucket int"
    return spark.read.schema(schema).parquet(place)


def postings(blocks: DataFrame, *carried: str) -> DataFrame:
    """``(term, *carried, key, tf)`` of the blocks; gaps are added up within each block, all blocks
    of an Arrow batch at once, so the cost is linear in the postings."""
    def added_up(batches):
        for batch in batches:
            gaps = batch.column(batch.num_columns - 2)
            size = gaps.value_lengths().to_numpy(zero_copy_only=False)
            flat = gaps.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.concatenate([[0], np.cumsum(flat)])[np.cumsum(size) - size]  # the gaps of all blocks before
            keys = np.cumsum(flat) + np.repeat(batch.column(batch.num_columns - 3).to_numpy(zero_copy_only=False) - before, size)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            columns = [*(batch.column(i) for i in range(batch.num_columns - 3)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)), batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "keys", "tfs"])

    kept = blocks.select("term", *carried)
    names = kept.columns
    kinds = StructType([*kept.schema.fields, StructField("keys", ArrayType(LongType())), StructField("tfs", ArrayType(IntegerType()))])
    decoded = blocks.select("term", *carried, "first", "gaps", "tfs").mapInArrow(added_up, kinds)
    pairs = decoded.select("term", *carried, F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("tfs").alias("tf"))).alias("p"))
    return pairs.select("term", *carried, F.col("p.key").alias("key"), F.col("p.tf").cast("long").alias("tf"))


def document_frequencies(blocks: DataFrame) -> DataFrame:
    """``(term, df)`` from the heads of the blocks alone."""
    return blocks.groupBy("term").agg(F.sum("n").alias("df"))


def search(blocks: DataFrame, term: str | Column, buckets: int = BUCKETS) -> DataFrame:
    """The postings of one term, from the folder of its bucket."""
    wanted = F.lit(term) if isinstance(term, str) else term
    return postings(blocks.filter((F.col("bucket") == bucket_of(wanted, buckets)) & (F.col("term") == wanted)))


def tf_idf(blocks: DataFrame, documents: int | Column, min_doc_freq: int = 0) -> DataFrame:
    """``(key, term, tf, df, tf_idf)`` with ``idf = ln((m + 1) / (df + 1))``, 0 below ``min_doc_freq``.

    Blocks, not postings, meet the frequencies; they are taken apart afterwards.
    """
    total = F.lit(float(documents)) if isinstance(documents, int) else documents
    idf = F.when(F.col("df") >= min_doc_freq, F.ln((total + 1.0) / (F.col("df") + 1.0))).otherwise(0.0)
    weighted = blocks.join(document_frequencies(blocks), "term").withColumn("_idf", idf)
    return postings(weighted, "df", "_idf").select("key", "term", "tf", "df", (F.col("tf") * F.col("_idf")).alias("tf_idf"))
