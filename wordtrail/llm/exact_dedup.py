"""Exact duplicates by a stateful stream: disk-backed state keyed by digest, with no expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtrail.llm.common import lower_ascii, settings, stored, text_or_empty
from wordtrail.session import shared_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _normal(text: str) -> Column:
    return lower_ascii(text_or_empty(text))


def sha256(normal: Column) -> Column:
    return F.sha2(normal, 256)


def arrivals(docs: DataFrame, text: str = "text", key: str = "doc_id", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """What the stream reads of a row: digest, stable key and the content's place (file, byte length)."""
    normal = _normal(text)
    return docs.select(digest(normal).alias("digest"), F.col(key).alias("key"), sha256(normal).alias("text_sha256"),
                       F.octet_length(normal).alias("n_bytes"), F.input_file_name().alias("locator"))


def first_seen(source: DataFrame, batch_bytes: int = 64 << 30, checkpoint: str | None = None) -> DataFrame:
    """The state after the stream has read everything: one row a digest with
    ``n``, ``keep_key`` (largest key), ``n_bytes`` and ``locator`` (of the row that stays).

    ``source`` is a table of ``arrivals``. The state lives in RocksDB on the executors' disks with
    change logs in the shared folder, is never dropped and grows with the number of digests.
    Rows are summed up before the shuffle, so a digest of a third of all rows sends one row a
    task. Given a ``checkpoint`` folder, a later call goes on from its state and reads new files
    only. Every micro-batch writes the digests it changed; a repeated batch replaces its own.
    """
    spark = source.sparkSession
    place = checkpoint or shared_path(spark, "dedup-stream")
    paths = sorted({f.rsplit("/", 1)[0] for f in source.inputFiles()})
    if len(paths) != 1:
        raise ValueError("arrivals are read from one folder")
    stream = spark.readStream.schema(source.schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(paths[0])
    state = stream.groupBy("digest").agg(
        F.count("*").alias("n"), F.max(F.struct("key", "n_bytes", "locator")).alias("kept"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/changed/batch={number}")

    with settings(spark, **{"spark__sql__streaming__stateStore__providerClass": ROCKS,
                            "spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage": "true",
                            "spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB": "256",
                            "spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled": "true",
                            "spark__sql__streaming__stateStore__rocksdb__allowFAllocate": "false",
                            "spark__sql__streaming__noDataMicroBatches__enabled": "false"}):
        query = (state.writeStream.outputMode("update").foreachBatch(put).trigger(availableNow=True)
                 .option("checkpointLocation", f"{place}/state").start())
        query.awaitTermination()
    kept = state.schema["kept"].dataType.simpleString()
    changed = spark.read.schema(f"digest string, n long, kept {kept}, batch int").parquet(f"{place}/changed")
    last = changed.groupBy("digest").agg(F.max(F.struct("n", "kept")).alias("s"))  # counts only grow
    return last.select("digest", "s.n", F.col("s.kept.key").alias("keep_key"), F.col("s.kept.n_bytes").alias("n_bytes"),
                       F.col("s.kept.locator").alias("locator"))


def compared(docs: DataFrame, seen: DataFrame, text: str = "text", key: str = "doc_id",
             digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The different texts behind every digest that was met again: ``digest, normal, n, keep_key``.

    The full bytes are compared: rows are grouped by digest and whole text, equal texts being
    summed up in their task before they travel. Spark's own bloom filter on the digests met again
    (of a few MB at most) keeps most other texts out of the shuffle; the join behind it is exact.
    """
    normal = _normal(text)
    again = seen.filter("n > 1").select("digest")
    texts = (docs.select(digest(normal).alias("digest"), normal.alias("normal"), F.col(key).alias("key"))
             .groupBy("digest", "normal").agg(F.count("*").alias("n"), F.max("key").alias("keep_key")))
    return texts.join(again, "digest", "left_semi")


def duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", batch_bytes: int = 64 << 30,
               digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` for each row.

    Texts are equal when identical after lower-casing A to Z; null counts as empty. Of equal
    texts the row with the largest key stays. Rows that repeat the largest key all stay: they
    can't be told apart. A null key stays only if no row of the group has one. Where a digest
    stands for different texts, these are told apart by their bytes.
    """
    spark = docs.sparkSession
    rows = stored(arrivals(docs, text, key, digest), "arrivals")
    seen = stored(first_seen(rows, batch_bytes), "dedup-state")
    with settings(spark, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0",
                  spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold="1g"):
        texts = compared(docs, seen, text, key, digest).select(
            "digest", sha256(F.col("normal")).alias("text_sha256"), "normal", "n", "keep_key")
        several = texts.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest")
        clash = stored(several, "digest-clashes")
    met = rows.select("digest", "key", "text_sha256").join(
        seen.select("digest", "n", "keep_key"), "digest").select("digest", "key", "text_sha256", "n", "keep_key")
    if not clash.isEmpty():
        normal = _normal(text)
        apart = docs.select(digest(normal).alias("digest"), normal.alias("normal"), F.col(key).alias("key")).join(clash, "digest", "left_semi")
        own = apart.groupBy("digest", "normal").agg(F.count("*").alias("n"), F.max("key").alias("keep_key"))
        again = apart.join(own, ["digest", "normal"]).select(
            "digest", "key", sha256(F.col("normal")).alias("text_sha256"), "n", "keep_key")
        met = met.join(clash, "digest", "left_anti").unionByName(again)
    return met.select(F.col("key").alias(key), F.col("keep_key").alias("keep_id"), F.col("n").alias("group_size"),
                      F.col("key").eqNullSafe(F.col("keep_key")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", batch_bytes: int = 64 << 30) -> DataFrame:
    """The rows that ``duplicates`` keeps, columns as they came; rows without a key stay."""
    gone = (duplicates(docs, text, key, batch_bytes).filter(~F.col("kept")).filter(F.col(key).isNotNull())
            .select(F.col(key).alias("_gone"), F.col("text_sha256").alias("_sha256")).distinct())
    # a key may stand for several texts, of which only the copies go
    return docs.join(gone, (F.col(key) == F.col("_gone")) & (sha256(_normal(text)) == F.col("_sha256")), "left_anti").select(docs.columns)
