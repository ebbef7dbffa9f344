"""Text features: term counts, hashed terms, tf-idf, label index, vectors and embeddings."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import (IDF, PCA, CountVectorizer, HashingTF, SQLTransformer,
                                StopWordsRemover, StringIndexer, StringIndexerModel, Tokenizer,
                                VectorAssembler, Word2Vec, Word2VecModel)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from wordtrail.functions.arrays import cosine
from wordtrail.operators.lookup import salted_join

# Fixed value: default number of hashed term slots.
HASH_SLOTS = 262_144


def count_vectors(df: DataFrame, tokens: str, output: str = "features", **params) -> DataFrame:
    return CountVectorizer(inputCol=tokens, outputCol=output, **params).fit(df).transform(df)


def hashed_tf(df: DataFrame, tokens: str, output: str = "tf", slots: int = HASH_SLOTS) -> DataFrame:
    return HashingTF(inputCol=tokens, outputCol=output, numFeatures=slots).transform(df)


def hashed_tf_idf(df: DataFrame, tokens: str, output: str = "features", slots: int = HASH_SLOTS,
                  min_doc_freq: int = 0) -> DataFrame:
    """Hashed tf-idf: the model is one vector of ``slots`` numbers, so no join is needed."""
    counted = hashed_tf(df, tokens, "_tf", slots)
    return IDF(inputCol="_tf", outputCol=output, minDocFreq=min_doc_freq).fit(counted).transform(counted).drop("_tf")


def tf_idf(counts: DataFrame, key: str, documents: DataFrame, min_doc_freq: int = 0,
           salts: int | None = None) -> DataFrame:
    """``(key, term, tf, df, tf_idf)`` from ``(key, term, tf)`` counts, one per document and term.

    ``idf = ln((m + 1) / (df + 1))``, 0 below ``min_doc_freq``. Terms found in most documents are
    spread over several copies of their document frequency.
    """
    total = documents.agg(F.count("*").cast("double").alias("m")).scalar()
    freq = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.when(F.col("df") >= min_doc_freq, F.ln((total + 1.0) / (F.col("df") + 1.0))).otherwise(0.0)
    weighted = freq.withColumn("_idf", idf)
    return salted_join(counts, weighted, "term", [key], salts=salts).select(
        key, "term", "tf", "df", (F.col("tf") * F.col("_idf")).alias("tf_idf"))


def label_index(df: DataFrame, label: str, output: str) -> StringIndexerModel:
    """Index by falling frequency, ties alphabetical."""
    return StringIndexer(inputCol=label, outputCol=output, stringOrderType="frequencyDesc").fit(df)


def assemble(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="keep").transform(df)


def stacked_vector(columns: list[Column | str], output: str = "features") -> Column:
    """Prediction columns as one feature vector."""
    return array_to_vector(F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double")
                                     for c in columns])).alias(output)


def to_vector(values: Column | str) -> Column:
    values = F.col(values) if isinstance(values, str) else values
    return array_to_vector(F.transform(values, lambda x: x.cast("double")))


def train_word_vectors(lists: DataFrame, tokens: str, size: int = 100, output: str = "embedding",
                       min_count: int = 5, seed: int = 42, partitions: int | None = None) -> Word2VecModel:
    """Trained on as many tasks as the session has cores, 64 at most, as each holds the whole model;
    several rounds make up for the tasks learning apart. Words rarer than ``min_count`` have no vector."""
    cores = lists.sparkSession.sparkContext.defaultParallelism
    partitions = partitions or min(cores, 64)
    kept = lists.select(tokens).persist()
    model = Word2Vec(vectorSize=size, inputCol=tokens, outputCol=output, minCount=min_count, seed=seed,
                     numPartitions=partitions, maxIter=min(partitions, 4)).fit(kept)
    kept.unpersist()
    return model


def word_vectors(model: Word2VecModel) -> DataFrame:
    """``(word, vector)`` with the vector as an array of doubles."""
    return model.getVectors().withColumn("vector", vector_to_array("vector"))


def similar_words(vectors: DataFrame, word: str) -> DataFrame:
    """All words with their cosine similarity to one word, most similar first."""
    query = vectors.filter(F.col("word") == word).select("vector").scalar()
    return (vectors.filter(F.col("word") != word).withColumn("_query", query)
                   .select("word", cosine("vector", "_query").alias("similarity"))
                   .orderBy(F.desc("similarity"), "word"))


def project(df: DataFrame, vector: str, k: int = 2, output: str = "pca") -> DataFrame:
    """Principal components of an array or vector column."""
    if df.schema[vector].dataType.typeName() == "array":
        df = df.withColumn(vector, to_vector(vector))
    return PCA(k=k, inputCol=vector, outputCol=output).fit(df).transform(df)


def text_features(text: str, form: str, slots: int = HASH_SLOTS) -> Pipeline:
    """Words without stop words as ``features``: ``bag_of_words`` (counts of the ``slots`` most
    frequent words) or ``tf_idf`` (hashed, weighted), with the number of words as one number more."""
    words = [
        SQLTransformer(statement=f"SELECT *, regexp_replace({text}, '[.,!?;:]', ' ') AS _clean FROM __THIS__"),
        Tokenizer(inputCol="_clean", outputCol="_tokens"),
        StopWordsRemover(inputCol="_tokens", outputCol="_refined"),
        SQLTransformer(statement="SELECT *, filter(_refined, t -> t <> '') AS _terms, cast(size(filter(_tokens, t -> t <> '')) AS double) AS num_tokens FROM __THIS__")]
    weights = {"bag_of_words": [CountVectorizer(inputCol="_terms", outputCol="_words", vocabSize=slots)],
               "tf_idf": [HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=slots), IDF(inputCol="_tf", outputCol="_words")]}[form]
    return Pipeline(stages=[*words, *weights, VectorAssembler(inputCols=["_words", "num_tokens"], outputCol="features")])


def text_stages(text: str, slots: int = HASH_SLOTS) -> Pipeline:
    """Clean, tokenize, drop stop words, hash and weight as one MLlib pipeline."""
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, regexp_replace({text}, '[.,!?;:]', ' ') AS _clean FROM __THIS__"),
        Tokenizer(inputCol="_clean", outputCol="tokens"),
        StopWordsRemover(inputCol="tokens", outputCol="refined"),
        SQLTransformer(statement="SELECT *, filter(refined, t -> t <> '') AS terms FROM __THIS__"),
        HashingTF(inputCol="terms", outputCol="tf", numFeatures=slots),
        IDF(inputCol="tf", outputCol="features")])
