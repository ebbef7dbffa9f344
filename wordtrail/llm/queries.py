"""The registered queries, one an operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtrail.llm import bpe, decontaminate, divergence, exact_dedup, interpolation, licenses, phrases, pii, simhash, suffix_dedup, token_files, toxicity, warc
from wordtrail.llm.registry import QUERIES, SQL, query, table
from wordtrail.session import shared_path

__all__ = ["QUERIES", "SQL"]


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file on this machine (the same on all executors)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(key: str, n: int):
    return F.crc32(F.col(key).cast("string")) % n


@query("op1_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS s FROM p),
    b AS (SELECT s, max(page_id) AS best FROM d WHERE n >= 1000 GROUP BY s)
    SELECT page_id, n::bigint AS payload_bytes, d.s AS payload_digest,
           CASE WHEN best IS NULL OR best = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN best <> page_id THEN best END AS refers_to
    FROM d LEFT JOIN b ON d.s = b.s AND d.n >= 1000""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    place = shared_path(spark, "warc")
    manifest = warc.write_warc(table(spark, folder, "pages"), place)
    return warc.read_warc(manifest, place).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_bpe")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


@query("op3_licenses", licenses.SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.find(table(spark, folder, "documents")).select("doc_id", "license_id", "scope", "n_places")


@query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.filter(remainder("doc_id", 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_pii")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymise(table(spark, folder, "documents"), pii.DEMO_KEY)


@query("op6_simhash")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op7_exact_dedup", """
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, s AS text_sha256
    FROM d WINDOW w AS (PARTITION BY s)""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, folder, "documents"))


@query("op8_decontaminate")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_token_files")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    place = shared_path(spark, "tokens")
    manifest = token_files.write_tokens(table(spark, folder, "documents"), place, tokenizer("byte_bpe_50k.json"))
    return token_files.read_tokens(manifest, place)


@query("op10_interpolation")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return interpolation.score(table(spark, folder, "documents"), remainder("doc_id", 7) == 2)


@query("op11_divergence", """
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
    f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint AS n, k.total::hugeint AS total
          FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    s AS (SELECT *, sum(n) OVER w AS own, sum(total) OVER w AS whole, count(*) OVER w AS v FROM f WINDOW w AS (PARTITION BY lang, source)),
    p AS (SELECT lang, source, term, n, (1 + 1000000000 * (n + 5) // (own + 5 * v))::bigint AS p,
                 (1 + 1000000000 * (total + 5) // (whole + 5 * v))::bigint AS q FROM s),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::bigint AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
              GROUP BY ALL),
    r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, rank FROM (
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::integer AS rank FROM r)
    WHERE part = 'pair' OR rank <= 50""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


@query("op12_phrases")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@query("op13_suffix_dedup")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, folder, "documents"))
