"""Sources, sinks and materialization (S)."""

from __future__ import annotations

from functools import partial
from itertools import combinations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.sql import functions as F

from wordtrail.operators.features import to_vector
from wordtrail.operators.learning import side_by_side
from wordtrail.operators.tables import preview
from wordtrail.operators.votes import apply_models
from wordtrail.plans.registry import query
from wordtrail.session import cut_lineage, shared_path
from wordtrail.sources import files, models, pages


@query("s1_csv_scan", "SELECT doc_id::varchar AS doc_id, replace(text, chr(10), ' ') AS review, lang FROM documents")
def csv_scan(t):
    path = shared_path(t.spark, "reviews")
    files.write_csv(t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("review"), "lang"), path)
    return files.read_csv(t.spark, path, "doc_id string, review string, lang string")


@query("s2_csv_scan_multiline", "SELECT doc_id, text, length(text) AS n FROM documents")
def csv_scan_multiline(t):
    path = shared_path(t.spark, "essays")
    files.write_csv(t.documents.select("doc_id", "text"), path)
    essays = files.read_csv(t.spark, path, "doc_id bigint, text string", multiline=True)
    return essays.withColumn("n", F.length("text").cast("bigint"))


@query("s3_parquet_scan", "SELECT event_id, user_id, event_type FROM events")
def parquet_scan(t):
    events = files.read_table(t.spark, f"{t.folder}/events.parquet")
    return events.select("event_id", "user_id", "event_type")


@query("s4_parquet_sink", """
SELECT doc_id, quality FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id, quality FROM labels WHERE toxic = 1""")
def parquet_sink(t):
    path = shared_path(t.spark, "scores")
    rows = t.labels.select("doc_id", "quality", "toxic")
    files.write_table(rows.filter("toxic = 0").drop("toxic"), path)
    files.write_table(rows.filter("toxic = 1").drop("toxic"), path, append=True)
    return files.read_table(t.spark, path)


@query("s5_score_file", "SELECT doc_id, quality + 1 AS score FROM labels")
def score_file(t):
    path = shared_path(t.spark, "submission")
    files.write_csv(t.labels.select("doc_id", (F.col("quality") + 1).alias("score")), path)
    return files.read_csv(t.spark, path, "doc_id bigint, score int")


LANGUAGES = [("en", "English"), ("fr", "French"), ("de", "German"), ("es", "Spanish")]


@query("s6_inline_table", """
SELECT v.name AS language, count(*) AS n FROM documents d
JOIN (VALUES ('en','English'),('fr','French'),('de','German'),('es','Spanish')) v(lang, name) ON d.lang = v.lang
GROUP BY 1""")
def inline_table(t):
    names = files.inline_table(t.spark, LANGUAGES, "lang string, language string")
    counts = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(names), "lang").select("language", "n")


@query("s7_empty_table", "SELECT n_chars::float AS n_chars, length(text)::float AS counted FROM documents")
def empty_table(t):
    filled = t.documents.select(F.col("n_chars").cast("float"), F.length("text").cast("float").alias("counted"))
    return files.empty_table(t.spark, ["n_chars", "counted"]).unionByName(filled)


@query("s8_text_lines", """
SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""")
def text_lines(t):
    path = shared_path(t.spark, "text")
    files.write_lines(t.documents, "text", path)
    return files.read_lines(t.spark, path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("s8_first_line", "SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents")
def first_line(t):
    return pages.page_at(t.documents, "doc_id", "text", 1, "\n").withColumnRenamed("text", "line")


@query("s8_first_lines_of_files", """
WITH d AS (SELECT part, min(c_custkey) AS least FROM (SELECT c_custkey, c_custkey % 3 AS part FROM customer) GROUP BY part)
SELECT least::varchar AS line FROM d""")
def first_lines_of_files(t):
    path = shared_path(t.spark, "first-lines")
    customers = t.customer.select(F.col("c_custkey").cast("string").alias("line"), F.col("c_custkey"), (F.col("c_custkey") % 3).alias("part"))
    dealt = customers.repartition(3, "part").sortWithinPartitions("part", "c_custkey")
    dealt.select("part", "line").write.partitionBy("part").text(path)
    return files.first_lines(t.spark, f"{path}/*").select("line")


@query("s9_write_and_append_lines", """
SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark
UNION ALL SELECT unnest(string_split(text, chr(10))) FROM conversations) GROUP BY 1""")
def write_and_append_lines(t):
    path = shared_path(t.spark, "lines")
    files.write_lines(t.benchmark, "text", path)
    files.write_lines(t.conversations, "text", path, append=True)
    return files.read_lines(t.spark, path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("s10_log_mean", "SELECT round(avg(value), 6) AS mean FROM events WHERE contains(event_type, 'c')")
def log_mean(t):
    path = shared_path(t.spark, "log")
    entries = t.events.select(F.concat("event_type", F.lit(" : "), F.col("value").cast("string")).alias("entry"))
    files.write_lines(entries, "entry", path)
    return files.log_mean(files.read_lines(t.spark, path), "c").select(F.round("mean", 6).alias("mean"))


@query("s11_registered_pairs", """
WITH c AS (SELECT label, count(*) AS n, max(len(embedding)) AS size FROM embeddings WHERE label IS NOT NULL GROUP BY 1)
SELECT a.label AS lower, b.label AS upper, a.n + b.n AS rows, greatest(a.size, b.size) AS size, a.n + b.n AS classified
FROM c a JOIN c b ON a.label < b.label""")
def registered_pairs(t):
    """Every pair of labels: its separator is fitted in full, saved, found by its key, and applied to the pair's rows."""
    base = shared_path(t.spark, "models")
    rows = cut_lineage(t.embeddings.filter("label IS NOT NULL").select("label", to_vector("embedding").alias("features")))
    labels = sorted(r.label for r in rows.select("label").distinct().collect())
    pairs = list(combinations(labels, 2))
    fits = [partial(LogisticRegression(labelCol="y", regParam=0.01).fit, rows.filter(F.col("label").isin(a, b)).withColumn("y", (F.col("label") == b).cast("int")))
            for a, b in pairs]
    key = lambda a, b: f"separator_{a}_{b}_"
    models.save_models(t.spark, base, {key(a, b): m for (a, b), m in zip(pairs, side_by_side(t.spark, fits))})
    loaded = models.load_models(t.spark, base, LogisticRegressionModel, "separator")
    sizes = t.spark.createDataFrame([(a, b, len(loaded[key(a, b)].coefficients)) for a, b in pairs], "lower int, upper int, size long")
    scored = apply_models(rows, [loaded[key(a, b)] for a, b in pairs], "p", [f"{a}_{b}" for a, b in pairs])
    said = F.array(*[F.struct(F.lit(a).cast("int").alias("lower"), F.lit(b).cast("int").alias("upper"), F.col(f"p{a}_{b}").alias("p")) for a, b in pairs])
    each = scored.select("label", F.explode(said).alias("s")).filter((F.col("label") == F.col("s.lower")) | (F.col("label") == F.col("s.upper")))
    counted = each.groupBy("s.lower", "s.upper").agg(F.count("*").alias("rows"), F.count_if(F.col("s.p").isin(0.0, 1.0)).alias("classified"))
    return counted.join(F.broadcast(sizes), ["lower", "upper"]).select("lower", "upper", "rows", "size", "classified")  # a row a pair


@query("s11_model_registry")
def model_registry(t):
    base = shared_path(t.spark, "models")
    rows = t.embeddings.select("vec_id", "label", to_vector("embedding").alias("features"))
    labels = sorted(r.label for r in rows.filter("label IS NOT NULL").select("label").distinct().collect())
    width = max((len(str(x)) for x in labels), default=1)
    # labels of one width, so that a pair's digits are in no other pair's key
    pairs = [(str(a).rjust(width, "0"), str(b).rjust(width, "0")) for a, b in combinations(labels, 2)]
    fits = []
    for (a, b), (x, y) in zip(combinations(labels, 2), pairs):
        pair = rows.filter(F.col("label").isin(a, b)).withColumn("y", (F.col("label") == b).cast("int"))
        fits.append(partial(LogisticRegression(labelCol="y", maxIter=10, predictionCol=f"p{x}{y}").fit, pair))
    fitted = {f"separator_{x}{y}": m for (x, y), m in zip(pairs, side_by_side(t.spark, fits))}
    models.save_models(t.spark, base, fitted)
    loaded = models.load_pair_models(t.spark, base, LogisticRegressionModel, pairs, "separator")
    names = [f"{x}{y}" for x, y in loaded]
    scored = apply_models(rows, [model for (model,) in loaded.values()], "p", names)
    return scored.select("vec_id", "label", *[F.col(f"p{n}").cast("double").alias(f"p{n}") for n in names])


PAGES_SQL = """SELECT doc_id, unnest(range(1, len(p) + 1)) AS page_no, unnest(p) AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)"""


@query("s12_page_rows", PAGES_SQL)
def page_rows(t):
    return pages.page_rows(t.documents, "doc_id", "text", "\n").withColumn("page_no", F.col("page_no").cast("bigint"))


@query("s12_page_counts", "SELECT doc_id, len(string_split(text, chr(10))) AS pages FROM documents")
def page_counts(t):
    return pages.page_counts(t.documents, "doc_id", "text", "\n").withColumn("pages", F.col("pages").cast("bigint"))


@query("s12_page_by_number", "SELECT doc_id, string_split(text, chr(10))[3] AS text FROM documents")
def page_by_number(t):
    return pages.page_at(t.documents, "doc_id", "text", 3, "\n")


@query("s12_full_text", "SELECT doc_id, replace(text, chr(10), ' / ') AS text FROM documents")
def full_text(t):
    return pages.full_text(t.documents, "doc_id", "text", "\n", " / ")


@query("s13_copy_pages", f"""
WITH p AS ({PAGES_SQL})
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS page_no, text FROM p WHERE page_no IN (1, 3)
UNION ALL SELECT doc_id + 1000000, 1, text FROM p WHERE page_no = 2""")
def copy_pages(t):
    path = shared_path(t.spark, "copied")
    files.write_table(pages.copy_pages(t.documents, "doc_id", "text", [1, 3], "\n"), path)
    second = pages.copy_pages(t.documents, "doc_id", "text", [2], "\n")
    files.write_table(second.withColumn("doc_id", F.col("doc_id") + 1000000), path, append=True)
    return files.read_table(t.spark, path).withColumn("page_no", F.col("page_no").cast("bigint"))


@query("s14_checkpoint", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def checkpoint(t):
    per_user = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return cut_lineage(per_user)


@query("s15_preview", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 10")
def first_rows(t):
    return preview(t.events.select("event_id", "user_id", "event_type"), "event_id", 10)
