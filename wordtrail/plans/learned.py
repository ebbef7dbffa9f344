"""Feature engineering (V) and models, evaluation and clustering (L)."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (Bucketizer, IndexToString, MaxAbsScaler, MinMaxScaler,
                                QuantileDiscretizer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from wordtrail.functions.stopwords import ENGLISH
from wordtrail.operators import evaluate, factors, features, journey, learning, postings, skipgram, sweep, tokens, votes
from wordtrail.operators.sampling import with_split
from wordtrail.plans.registry import query, quoted_list, unit_sql, words_sql
from wordtrail.session import cut_lineage, written

TF_SQL = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({words_sql('text')}) AS term FROM documents) GROUP BY 1, 2)"


def term_counts(t):
    return tokens.term_counts(t.texts, "doc_id", tokens.word_tokens("text"))


def refined(t):
    words = tokens.remove_stop_words(tokens.word_tokens("text"), ENGLISH)
    return t.texts.select("doc_id", "lang", words.alias("tokens"))


def vectors(t):
    return t.embeddings.select("vec_id", "label", features.to_vector("embedding").alias("features"))


def labelled(t):
    """Binary task: does a vector carry an even label?"""
    return vectors(t).withColumn("y", (F.col("label") % 2).cast("double"))


def _stored(vector: str):
    """Number of entries a sparse vector stores, without spelling out its zeros."""
    indices = F.regexp_extract(F.col(vector).cast("string"), r"\[([^\]]*)\]", 1)
    return F.when(indices == "", F.lit(0)).otherwise(F.size(F.split(indices, ","))).cast("bigint")


@query("v1_term_counts", f"WITH {TF_SQL} SELECT doc_id, term, tf FROM tf")
def bag_of_words(t):
    return term_counts(t)


@query("v1_count_vectors", f"""
SELECT doc_id, len(list_distinct(list_filter({words_sql('text')}, lambda x: x NOT IN ({quoted_list(ENGLISH)}))))  AS terms FROM documents""")
def count_vectors(t):
    counted = features.count_vectors(refined(t), "tokens", vocabSize=2**31 - 1, minDF=1.0)
    return counted.select("doc_id", _stored("features").alias("terms"))


@query("v2_hashed_tf", f"""
SELECT doc_id, len(list_filter({words_sql('text')}, lambda x: x NOT IN ({quoted_list(ENGLISH)}))) AS total FROM documents""")
def hashed_tf(t):
    # which slot a term falls into is Spark's own hash; the counts in all slots must add up
    values = F.split(F.regexp_extract(F.col("tf").cast("string"), r"\],\[([^\]]*)\]", 1), ",")
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    return features.hashed_tf(refined(t), "tokens").select("doc_id", total.cast("bigint").alias("total"))


TF_IDF_SQL = f"""
WITH {TF_SQL}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), m AS (SELECT count(*)::double AS m FROM documents)
SELECT tf.doc_id, tf.term, tf, df, round(CASE WHEN df >= 2 THEN tf * ln((m + 1.0) / (df + 1.0)) ELSE 0 END, 4) + 0.0 AS tf_idf
FROM tf JOIN df ON tf.term = df.term, m"""


@query("v3_tf_idf", TF_IDF_SQL)
def tf_idf(t):
    counts = written(term_counts(t), "counts")  # texts are cut into words once
    weighted = features.tf_idf(counts, "doc_id", t.documents, min_doc_freq=2)
    return weighted.withColumn("tf_idf", F.round("tf_idf", 4) + F.lit(0.0))


@query("v3_stored_tf_idf", TF_IDF_SQL)
def stored_tf_idf(t):
    """From the stored index: texts are cut into words once."""
    index = postings.read_index(t.spark, postings.write_index(term_counts(t), "doc_id", "term"))
    total = t.documents.agg(F.count("*").cast("double").alias("m")).scalar()
    weighted = postings.tf_idf(index, total, min_doc_freq=2)
    return weighted.select(F.col("key").alias("doc_id"), "term", "tf", "df", (F.round("tf_idf", 4) + F.lit(0.0)).alias("tf_idf"))


@query("v3_hashed_tf_idf")
def hashed_tf_idf(t):
    return features.hashed_tf_idf(refined(t), "tokens").select("doc_id", F.col("features").cast("string").alias("features"))


@query("v4_label_index", """
WITH i AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS idx FROM documents GROUP BY 1)
SELECT d.doc_id, d.lang, i.idx::double AS lang_index FROM documents d JOIN i ON d.lang = i.lang""")
def label_index(t):
    docs = t.documents.select("doc_id", "lang")
    return features.label_index(docs, "lang", "lang_index").transform(docs)


@query("v5_assembled", """
SELECT doc_id, n_chars::double AS first, length(text)::double AS second FROM documents""")
def assembled(t):
    docs = t.documents.select("doc_id", "n_chars", F.length("text").alias("length"))
    slots = vector_to_array("features")
    return features.assemble(docs, ["n_chars", "length"]).select(
        "doc_id", F.get(slots, F.lit(0)).alias("first"), F.get(slots, F.lit(1)).alias("second"))


@query("v6_stacked_vector", """
SELECT doc_id, quality::double AS first, toxic::double AS second FROM labels""")
def stacked_vector(t):
    stacked = t.labels.select("doc_id", features.stacked_vector(["quality", "toxic"]))
    slots = vector_to_array("features")
    return stacked.select("doc_id", F.get(slots, F.lit(0)).alias("first"), F.get(slots, F.lit(1)).alias("second"))


def finite(vector: str):
    """Whether all numbers of an array are finite."""
    return F.forall(vector, lambda x: F.abs(x) < float("inf"))


def event_journeys(t):
    return journey.user_journeys(t.events, "user_id", "event_type", "value",
                                 F.col("event_type") == "purchase", ["ts", "event_id"])


@query("v7_journey_word2vec", "SELECT DISTINCT user_id, 100 AS size, true AS finite FROM events")
def journey_word2vec(t):
    lists = event_journeys(t)
    # a page without a name is a word too
    lists = lists.withColumn("pages", F.transform("pages", lambda p: F.coalesce(F.concat(F.lit("p"), p), F.lit(""))))
    rows = factors.list_vectors(lists, "user_id", "pages", skipgram.word_vectors(lists, "pages"), over_all=True)
    return rows.select("user_id", F.size("vector").alias("size"), finite("vector").alias("finite"))


@query("v8_word_vectors", """
WITH m AS (SELECT event_type, lag(event_type, 1, 'started') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_type AS word, 100 AS size, true AS finite FROM m WHERE event_type <> p GROUP BY 1 HAVING count(*) >= 5""")
def word_vector_table(t):
    vectors = skipgram.word_vectors(event_journeys(t), "pages")
    return vectors.select("word", F.size("vector").alias("size"), finite("vector").alias("finite"))


@query("v9_document_vectors", "SELECT doc_id, 100 AS size, true AS finite FROM documents")
def document_vectors(t):
    docs = written(refined(t).select("doc_id", "tokens", F.monotonically_increasing_id().alias("row")), "lists")  # a row may come twice
    means = factors.list_vectors(docs, "row", "tokens", skipgram.word_vectors(docs, "tokens"), over_all=True)
    rows = docs.select("doc_id", "row").join(means, "row").select("doc_id", F.col("vector").alias("doc2vec"))
    return rows.select("doc_id", F.size("doc2vec").alias("size"), finite("doc2vec").alias("finite"))


@query("v7_page_associations", """
WITH m AS (SELECT *, lag(event_type, 1, 'started') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
r AS (SELECT user_id, event_type AS page, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m WHERE event_type <> p),
k AS (SELECT page FROM r GROUP BY 1 HAVING count(*) >= 5),
o AS (SELECT a.page AS a, b.page AS b FROM r a JOIN r b ON a.user_id = b.user_id AND (a.run - 1) // 10000 = (b.run - 1) // 10000 AND b.run - a.run BETWEEN 1 AND 5),
c AS (SELECT word, context, count(*) AS n FROM (SELECT a AS word, b AS context FROM o UNION ALL SELECT b, a FROM o)
      WHERE word IN (SELECT page FROM k) AND context IN (SELECT page FROM k) GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER () AS total, sum(n) OVER (PARTITION BY word) AS w, sum(n) OVER (PARTITION BY context) AS x FROM c)
SELECT word, context, n, round(ln(n::double * total / (w::double * x)), 6) AS ppmi FROM s WHERE ln(n::double * total / (w::double * x)) > 1e-12""")
def page_associations(t):
    found = factors.associations(factors.cooccurrences(event_journeys(t), "pages"))
    return found.withColumn("ppmi", F.round("ppmi", 6))


def page_factors(t):
    return factors.word_factors(factors.associations(factors.cooccurrences(event_journeys(t), "pages")))


@query("v7_journey_factors")
def journey_factors(t):
    return factors.list_vectors(event_journeys(t), "user_id", "pages", page_factors(t))


@query("v8_word_factors")
def word_factors(t):
    return page_factors(t)


@query("v9_document_factors")
def document_factors(t):
    docs = refined(t)
    return factors.list_vectors(docs, "doc_id", "tokens", factors.word_factors(factors.associations(factors.cooccurrences(docs, "tokens"))))


@query("v10_joined_embeddings", """
SELECT d.doc_id, len(e.embedding) AS size, round(e.embedding[1]::double, 6) AS first
FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id""")
def joined_embeddings(t):
    stored = t.embeddings.select(F.col("vec_id").alias("doc_id"), features.to_vector("embedding").alias("p_features"))
    slots = vector_to_array("p_features")
    return t.documents.select("doc_id").join(stored, "doc_id").select(
        "doc_id", F.size(slots).cast("bigint").alias("size"), F.round(F.get(slots, F.lit(0)), 6).alias("first"))


@query("v11_pca", "SELECT vec_id, 2 AS size, true AS finite FROM embeddings")
def pca(t):
    rows = features.project(t.embeddings, "embedding", 2).select("vec_id", vector_to_array("pca").alias("pca"))
    return rows.select("vec_id", F.size("pca").alias("size"), finite("pca").alias("finite"))


@query("v11_pca_positions")
def pca_positions(t):
    rows = features.project(t.embeddings, "embedding", 2).select("vec_id", vector_to_array("pca").alias("p"))
    return rows.select("vec_id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


@query("v12_text_stages")
def text_stages(t):
    docs = t.documents.select("doc_id", "text")
    fitted = features.text_stages("text", 1 << 18).fit(docs)
    return fitted.transform(docs).select("doc_id", F.size("terms").alias("terms"), F.col("features").cast("string").alias("features"))


@query("v13_bucketizer", """
SELECT event_id, CASE WHEN value < 10 THEN 0 WHEN value < 50 THEN 1 ELSE 2 END::double AS band FROM events""")
def bucketizer(t):
    cut = Bucketizer(splits=[float("-inf"), 10.0, 50.0, float("inf")], inputCol="value", outputCol="band")
    return cut.transform(t.events).select("event_id", "band")


@query("v13_index_to_string", "SELECT doc_id, lang AS original FROM documents")
def index_to_string(t):
    docs = t.documents.select("doc_id", "lang")
    model = features.label_index(docs, "lang", "i")
    back = IndexToString(inputCol="i", outputCol="original", labels=model.labels)
    return back.transform(model.transform(docs)).select("doc_id", "original")


@query("v13_scalers", """
SELECT doc_id, round((n_chars - min(n_chars) OVER ()) / (max(n_chars) OVER () - min(n_chars) OVER ()), 6) AS min_max,
  round(n_chars / max(n_chars) OVER (), 6) AS max_abs FROM documents""")
def scalers(t):
    rows = features.assemble(t.documents.select("doc_id", "n_chars"), ["n_chars"], "raw")
    for scaler in (MinMaxScaler(inputCol="raw", outputCol="a"), MaxAbsScaler(inputCol="raw", outputCol="b")):
        rows = scaler.fit(rows).transform(rows)
    first = lambda c: F.round(F.get(vector_to_array(c), F.lit(0)), 6)
    return rows.select("doc_id", first("a").alias("min_max"), first("b").alias("max_abs"))


@query("v13_quantile_bands", """
SELECT b::double AS band, true AS even FROM range(0, 4) r(b) WHERE (SELECT count(*) FROM events) > 0""")
def quantile_bands(t):
    cut = QuantileDiscretizer(numBuckets=4, inputCol="value", outputCol="band").fit(t.events).transform(t.events)
    share = F.count("*") / t.events.agg(F.count("*").alias("n")).scalar()
    # each cut point is right to 0.1 % of the rows; equal values stay together
    return cut.groupBy("band").agg((F.abs(share - 0.25) < 0.01).alias("even"))


def sentiment(t):
    docs = t.documents.join(t.labels, "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"))
    return with_split(docs, "doc_id")


@query("l1_logistic_text")
def logistic_text(t):
    rows = sentiment(t)
    staged = features.text_stages("text", 1 << 18).fit(rows).transform(rows)
    model = LogisticRegression(regParam=0.01).fit(staged.filter("split = 'train'"))
    return model.transform(staged.filter("split = 'test'")).select(
        "doc_id", "label", "prediction", vector_to_array("probability").alias("probability"))


SENTIMENT_SQL = f"""
WITH s AS (SELECT d.doc_id, l.quality AS y, len(list_filter(string_split_regex(lower(regexp_replace(d.text, '[.,!?;:]', ' ', 'g')), '[ \t\n\x0B\f\r]'), lambda x: x <> '')) AS n
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE {unit_sql('d.doc_id')} >= 0.75)
SELECT form, count(*) AS test_rows, sum(y)::bigint AS positives, sum(n)::bigint AS tokens, count(*) AS counted, true AS agree
FROM s, (VALUES ('bag_of_words'), ('tf_idf')) v(form) GROUP BY 1"""


def sentiment_scores(t, form: str):
    rows = sentiment(t)
    return learning.sentiment_flow(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "text", "label", "doc_id", form, regParam=0.01)


@query("l1_sentiment_flow", SENTIMENT_SQL)
def sentiment_flow(t):
    """Both forms of text features; the metrics of the test set agree with those counted from its predictions."""
    found = None
    for form in ("bag_of_words", "tf_idf"):
        scored = cut_lineage(sentiment_scores(t, form))
        own = learning.test_metrics(scored, "label")
        right = scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
        row = scored.agg(F.count("*").alias("test_rows"), F.sum("label").cast("bigint").alias("positives"), F.sum("num_tokens").cast("bigint").alias("tokens"))
        counted = own.select((F.col("true_negatives") + F.col("false_negatives") + F.col("true_positives") + F.col("false_positives")).alias("counted"),
                             (F.abs(F.col("accuracy") - right) < 1e-9).alias("agree"))
        row = row.crossJoin(F.broadcast(counted)).select(F.lit(form).alias("form"), "*")  # a row each
        found = row if found is None else found.unionByName(row)
    return found


@query("l1_sentiment_metrics")
def sentiment_metrics(t):
    forms = [learning.test_metrics(sentiment_scores(t, form), "label").select(F.lit(form).alias("form"), "*") for form in ("bag_of_words", "tf_idf")]
    return forms[0].unionByName(forms[1])


SCORED_LABELS = "s AS (SELECT d.doc_id, length(d.text)::double AS s, l.quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def scored_labels(t):
    return t.documents.select("doc_id", F.length("text").cast("double").alias("s")).join(
        t.labels.select("doc_id", F.col("quality").alias("y")), "doc_id")


@query("l2_area_under_roc", f"""
WITH {SCORED_LABELS}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::double AS r FROM s),
c AS (SELECT sum(r) FILTER (y = 1) AS sr, count(*) FILTER (y = 1)::double AS p, count(*) FILTER (y = 0)::double AS n FROM r)
SELECT round((sr - p * (p + 1) / 2) / (p * n), 6) AS auc FROM c""")
def area_under_roc(t):
    return evaluate.area_under_roc(scored_labels(t), "s", "y").select(F.round("auc", 6).alias("auc"))


@query("l2_sketched_auc", """
SELECT count(*) FILTER (event_type = 'purchase') AS positives, count(*) FILTER (event_type <> 'purchase') AS negatives, true AS within FROM events""")
def sketched_auc(t):
    """The area from one pass over the scores, next to the exact one."""
    rows = t.events.select("value", (F.col("event_type") == "purchase").cast("int").alias("y"))
    exact = evaluate.area_under_roc(rows, "value", "y").first().auc
    found = evaluate.sketched_curve(rows, "value", "y")
    within = F.abs(F.col("auc") - F.lit(exact)) < 2 * evaluate.sketch_error() + 1 / 500
    return found.select("positives", "negatives", within.alias("within"))


@query("l2_evaluator_auc", "SELECT count(*) AS rows, true AS agrees FROM embeddings")
def evaluator_auc(t):
    rows = labelled(t)
    model = LogisticRegression(labelCol="y").fit(rows)
    scored = model.transform(rows)
    value = learning.auc(scored, "y")
    own = evaluate.area_under_roc(scored.select(F.get(vector_to_array("probability"), F.lit(1)).alias("s"), F.col("y").cast("int").alias("y")), "s", "y")
    return rows.agg(F.count("*").alias("rows")).withColumn("agrees", F.abs(own.select("auc").scalar() - value) < 0.005)


@query("l3_curve_points", """
WITH c AS (SELECT value AS score, count(*) FILTER (event_type = 'purchase') AS pos, count(*) FILTER (event_type <> 'purchase') AS neg FROM events GROUP BY 1),
k AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c WINDOW w AS (ORDER BY score DESC))
SELECT round(score, 4) AS score, round(fp / n, 6)::double AS fpr, round(tp / p, 6)::double AS recall, round(tp / (tp + fp), 6)::double AS precision FROM k""")
def curve_points(t):
    rows = t.events.select("value", (F.col("event_type") == "purchase").cast("int").alias("y"))
    points = evaluate.curve_points(rows, "value", "y")
    return points.select(*[F.round(c, 4 if c == "score" else 6).alias(c) for c in points.columns])


@query("l3_sorted_coefficients")
def sorted_coefficients(t):
    model = LogisticRegression(labelCol="y").fit(labelled(t))
    rows = [(float(v),) for v in sorted(model.coefficients.toArray())]
    return t.spark.createDataFrame(rows, "coefficient double")


@query("l4_confusion_matrix", """
SELECT toxic, count(*) FILTER (quality = 0) AS pred_0, count(*) FILTER (quality = 1) AS pred_1 FROM labels GROUP BY 1""")
def confusion_matrix(t):
    return evaluate.confusion_matrix(t.labels, "toxic", "quality", evaluate.true_labels(t.labels, "toxic"))


@query("l5_binary_metrics", """
WITH c AS (SELECT count(*) FILTER (toxic = 0 AND quality = 0) AS tn, count(*) FILTER (toxic = 1 AND quality = 0) AS fn,
  count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 0 AND quality = 1) AS fp FROM labels),
r AS (SELECT *, (tn + tp) / (tn + fn + tp + fp) AS accuracy, tn / (tn + fp) AS recall_0, tp / (tp + fn) AS recall_1,
  tn / (tn + fn) AS precision_0, tp / (tp + fp) AS precision_1 FROM c)
SELECT tn AS true_negatives, fn AS false_negatives, tp AS true_positives, fp AS false_positives, round(accuracy, 6) AS accuracy,
  round(recall_0, 6) AS recall_0, round(recall_1, 6) AS recall_1, round(precision_0, 6) AS precision_0, round(precision_1, 6) AS precision_1,
  round(2 * recall_1 * precision_1 / (recall_1 + precision_1), 6) AS f1 FROM r""")
def binary_metrics(t):
    metrics = evaluate.binary_metrics(t.labels, "toxic", "quality")
    counts = {"true_negatives", "false_negatives", "true_positives", "false_positives"}
    return metrics.select(*[c if c in counts else F.round(c, 6).alias(c) for c in metrics.columns])


def best_row(t, rows, best: dict):
    """The chosen parameters next to the number of rows they were chosen on."""
    found = rows.agg(F.count("*").alias("rows"))
    return found.withColumns({k: F.lit(float(v)) for k, v in best.items()})


@query("l6_forest_grid")
def forest_grid(t):
    rows = labelled(t)
    return best_row(t, rows, learning.forest_grid(rows, "p", "y")[1])


@query("l7_logistic_grid")
def logistic_grid(t):
    rows = with_split(labelled(t), "vec_id")
    best = learning.logistic_grid(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "p", "y")[1]
    return best_row(t, rows, best)


@query("l8_forest_regression_grid")
def forest_regression_grid(t):
    rows = vectors(t)
    return best_row(t, rows, learning.forest_regression_grid(rows, "p", "label")[1])


@query("l9_boosted_regression_grid")
def boosted_regression_grid(t):
    rows = vectors(t)
    return best_row(t, rows, learning.boosted_regression_grid(rows, "p", "label")[1])


@query("l10_boosted_classifier_grid")
def boosted_classifier_grid(t):
    rows = labelled(t)
    return best_row(t, rows, learning.boosted_classifier_grid(rows, "p", "y")[1])


def grid_sql(grid: dict[str, list], rows: str, label: str) -> str:
    """Every point of a grid, with the number of rows and the accuracy of always saying the commonest class."""
    axes = " CROSS JOIN ".join(f"(SELECT unnest([{', '.join(map(str, values))}])::integer AS {name})" for name, values in grid.items())
    return (f"WITH c AS (SELECT {label} AS y, count(*) AS n FROM {rows} GROUP BY 1), b AS (SELECT sum(n)::bigint AS rows, round(max(n) / sum(n), 6) AS commonest FROM c) "
            f"SELECT {', '.join(grid)}, rows, commonest, true AS is_better FROM {axes} CROSS JOIN b")


def grid_points(t, rows, label: str, points: list[dict]):
    """Every point seen, next to what saying the commonest class would score."""
    by_class = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), (F.max("n") / F.sum("n")).alias("commonest"))
    found = t.spark.createDataFrame([tuple(p.values()) for p in points], ", ".join(f"{k} {'double' if k == 'metricValue' else 'int'}" for k in points[0]))
    return found.crossJoin(F.broadcast(by_class))  # one row


@query("l6_forest_points", grid_sql(learning.FOREST_GRID, "embeddings", "label % 2"))
def forest_points(t):
    """All 60 points from six fits; none does worse on its training rows than the commonest class."""
    rows = labelled(t)
    points = grid_points(t, rows, "y", learning.forest_grid(rows, "p", "y", threshold=None)[2])
    return points.select("maxDepth", "numTrees", "rows", F.round("commonest", 6).alias("commonest"), (F.col("metricValue") >= F.col("commonest") - 0.02).alias("is_better"))


@query("l6_forest_accuracies")
def forest_accuracies(t):
    rows = labelled(t)
    return grid_points(t, rows, "y", learning.forest_grid(rows, "p", "y", threshold=None)[2])


@query("l10_boosted_points", grid_sql(learning.BOOSTING_GRID, "embeddings", "label % 2"))
def boosted_points(t):
    """All 12 points from three fits."""
    rows = labelled(t)
    points = grid_points(t, rows, "y", learning.boosted_classifier_grid(rows, "p", "y")[2])
    return points.select("maxDepth", "maxIter", "rows", F.round("commonest", 6).alias("commonest"), (F.col("metricValue") >= F.col("commonest")).alias("is_better"))


SWEEP_SQL = (
    "SELECT k::integer AS clusters, true AS silhouette_in_range, true AS cost_is_positive "
    "FROM range(2, 5) r(k) WHERE (SELECT count(*) FROM embeddings) > 0")


def swept(rows):
    return rows.select("clusters", F.abs("silhouette").between(0, 1).alias("silhouette_in_range"), (F.col("cost") > 0).alias("cost_is_positive"))


@query("l11_bisecting_sweep", SWEEP_SQL)
def bisecting_sweep(t):
    return swept(learning.cluster_sweep(vectors(t), 4, bisecting=True))


@query("l12_kmeans_sweep", SWEEP_SQL)
def kmeans_sweep(t):
    return swept(learning.cluster_sweep(vectors(t), 4))


@query("l12_joint_sweep")
def joint_sweep(t):
    """Silhouette and cost of 2 to 6 clusters, one pass a round for all of them."""
    return sweep.kmeans_sweep(t.embeddings, range(2, 7), "embedding")


@query("l11_bisecting_numbers")
def bisecting_numbers(t):
    return learning.cluster_sweep(vectors(t), 4, bisecting=True)


SCORES = [1, 2, 3, 4, 5]
SCORE_PAIRS = list(combinations(SCORES, 2))


def score_rows(t, scores: int):
    return vectors(t).select("vec_id", (F.col("label") % scores + 1).alias("score"), "features")


def first_level(rows):
    """The 5 binary, 10 pair and 10 quaternary models behind the 25 stacked outputs."""
    return (learning.fit_binary_scorers(rows, "score", SCORES),
            learning.fit_pair_scorers(rows, "score", SCORE_PAIRS),
            learning.fit_pair_scorers(rows, "score", SCORE_PAIRS, rest=True))


@query("l13_boosted_scorers", """
SELECT vec_id, label % 3 + 1 AS score, true AS are_classes FROM embeddings""")
def boosted_scorers(t):
    scores = [1, 2, 3]  # those of its SQL
    rows = score_rows(t, 3)
    models = learning.fit_binary_scorers(rows, "score", scores)
    scored = votes.apply_models(rows, list(models.values()), "pred_", list(models))
    both = [F.col(f"pred_{s}").isin(0.0, 1.0) for s in scores]
    return scored.select("vec_id", "score", (both[0] & both[1] & both[2]).alias("are_classes"))


@query("l13_whole_scorers", """
SELECT vec_id, label % 5 + 1 AS score, 5 AS outputs, true AS are_classes FROM embeddings""")
def whole_scorers(t):
    """All five scores, each with its yes/no model."""
    rows = score_rows(t, len(SCORES))
    models = learning.fit_binary_scorers(rows, "score", SCORES)
    scored = votes.apply_models(rows, list(models.values()), "pred_", list(models))
    outputs = F.array(*[f"pred_{s}" for s in SCORES])
    return scored.select("vec_id", "score", F.size(outputs).alias("outputs"), F.forall(outputs, lambda p: p.isin(0.0, 1.0)).alias("are_classes"))


@query("l14_stacked_scores", "SELECT vec_id, true AS is_score FROM embeddings")
def stacked_scores(t):
    rows = score_rows(t, len(SCORES))
    stacked = learning.stack(rows, "vec_id", *first_level(rows))
    scored = learning.final_score(stacked, "vec_id", learning.fit_final(stacked, "score"))
    return scored.select("vec_id", F.col("score").isin(SCORES).alias("is_score"))


@query("l14_cross_fitted_scores")
def cross_fitted_scores(t):
    """The stack without leaks: both levels score rows that their models have not seen."""
    return learning.cross_fitted_scores(score_rows(t, len(SCORES)), "vec_id", "score", first_level)


@query("l14_voted_scores")
def voted_scores(t):
    rows = score_rows(t, len(SCORES))
    models = learning.fit_pair_scorers(rows, "score", SCORE_PAIRS)
    scored = votes.apply_models(rows, list(models.values()))
    return scored.select("vec_id", votes.pairwise_vote([f"pred_{i}" for i in range(len(SCORE_PAIRS))], SCORE_PAIRS).alias("score"))


@query("l15_one_vs_rest_and_linear", """
SELECT vec_id, (label % 3)::double AS y, true AS is_class, true AS is_finite FROM embeddings""")
def one_vs_rest_and_linear(t):
    rows = score_rows(t, 3).withColumn("y", F.col("score").cast("double") - 1)
    ovr = OneVsRest(classifier=LinearSVC(), labelCol="y", predictionCol="ovr").fit(rows)
    line = LinearRegression(labelCol="y", predictionCol="line").fit(rows)
    return line.transform(ovr.transform(rows)).select(
        "vec_id", "y", F.col("ovr").isin(0.0, 1.0, 2.0).alias("is_class"), (F.abs("line") < float("inf")).alias("is_finite"))


@query("l15_cross_validated")
def cross_validated(t):
    rows = labelled(t)
    search = learning.cross_validated(LogisticRegression(labelCol="y"), {"regParam": [0.01, 0.1]}, rows,
                                      MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy"))
    return rows.agg(F.count("*").alias("rows")).withColumns(
        {f"accuracy_{i}": F.lit(v) for i, v in enumerate(search.avgMetrics)})
