"""Toxicity by compression distance: which of two zstandard dictionaries shortens a window more.

The ordinary dictionary is what zstandard's trainer makes of ordinary windows. The toxic one takes
the place of part of it by pieces of toxic texts, chosen by how much more toxic than ordinary
documents hold them: the trainer, given toxic windows alone, mostly finds again what is frequent in
any text (held-out area under the curve at sf0.1: 0.71 at best, 0.86 to 0.91 for chosen pieces).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtrail.llm.common import stored

WINDOW_WORDS, WINDOW_BYTES, LEVEL = 8, 512, 5
DICTIONARY_BYTES, PIECE_BYTES, PIECES, CERTAIN = 16_000, 8, 300, 6.0
FEATURES = 10


def windows(text: str) -> list[bytes]:
    """Runs of eight words of the lower-cased text, cut further where words are very long; at least one."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    whole = [b" ".join(words[i:i + WINDOW_WORDS]) for i in range(0, len(words), WINDOW_WORDS)] or [b""]
    if max(map(len, whole)) <= WINDOW_BYTES:
        return whole
    return [w[i:i + WINDOW_BYTES] for w in whole for i in range(0, max(len(w), 1), WINDOW_BYTES)]


def pieces(window: bytes) -> set[bytes]:
    """The words of a window and their parts of eight bytes, blanks at word ends included."""
    out: set[bytes] = set()
    for word in set(window.split()):
        word = b" " + word + b" "
        out.add(word)
        out.update(word[i:i + PIECE_BYTES] for i in range(len(word) - PIECE_BYTES + 1))
    return out


@dataclass
class Model:
    """Two dictionaries, the threshold of a window's difference, the weights of a text's measures,
    and the score that a calibrated share of ordinary texts reaches."""

    toxic: bytes
    ordinary: bytes
    threshold: float
    weights: list[float]
    cut: float = 0.5

    def compressors(self) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
        made = []
        for content in (self.toxic, self.ordinary):
            data = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            made.append(zstd.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False))
        return made[0], made[1]


def differences(text: str, toxic: zstd.ZstdCompressor, ordinary: zstd.ZstdCompressor) -> np.ndarray:
    """For each window the bytes that the toxic dictionary saves over the ordinary one."""
    a, b = toxic.compress, ordinary.compress
    return np.array([len(b(w)) - len(a(w)) for w in windows(text)], np.float64)


def measures(saved: np.ndarray, threshold: float) -> list[float]:
    saved = np.sort(saved)
    n, over, far = len(saved), float((saved >= threshold).sum()), float((saved >= 2 * threshold).sum())
    return [1.0, saved.mean(), saved[-1] / 5, saved[-3:].mean() / 5, saved[-8:].mean() / 5, over / n * 5, math.log1p(over),
            math.log1p(n) / 5, far / n * 5, math.log1p(far)]


def train_dictionaries(best: list[bytes], plain: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the toxic and of the ordinary dictionary.

    Both hold what zstandard's trainer finds frequent in the windows ``plain``. To that the toxic
    one adds the pieces ``best``, best ones last, where matches are cheapest; the ordinary one adds
    as much ordinary text.
    """
    surplus = b"".join(best)
    try:
        common = zstd.train_dictionary(DICTIONARY_BYTES, plain).as_bytes()
    except zstd.ZstdError:  # too little text to train on
        common = b" ".join(plain)
    rest = max(DICTIONARY_BYTES - len(surplus) - PIECES * PIECE_BYTES, 0)
    base = common[-rest:] if rest else b""
    return base + surplus or b" ", common[-(len(base) + len(surplus)):] or b" "


def best_pieces(sample: DataFrame, text: str) -> list[bytes]:
    """Pieces found in more toxic than ordinary documents by the largest z-scores (six or more, or
    near the best where samples are small), best ones last. Counted in Spark; ``PIECES`` come back."""
    def hold(batches):
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set().union(*map(pieces, windows(t or "")))
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([y] * len(own), pa.int32())], names=["piece", "y"])

    n = {r._y: r.n for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    a, b = float(n.get(1, 0)), float(n.get(0, 0))
    held = sample.select(text, "_y").mapInArrow(hold, "piece binary, y int")
    x, y = F.col("x"), F.col("y")
    share = (x + y) / (a + b)
    z = (x / a - y / max(b, 1.0)) / F.sqrt(share * (1 - share) * (1 / max(a, 1.0) + 1 / max(b, 1.0)))
    counted = held.groupBy("piece").agg(F.count_if(F.col("y") == 1).alias("x"), F.count_if(F.col("y") == 0).alias("y"))
    ranked = counted.filter((x >= min(5.0, a)) & (share < 1)).select("piece", z.alias("z")).filter("z > 0").orderBy(F.desc("z"), F.desc("piece")).limit(PIECES).collect()
    certain = min(CERTAIN, 0.8 * ranked[0].z) if ranked else 0.0
    return [bytes(r.piece) for r in reversed(ranked) if r.z >= certain]


def some_windows(sample: DataFrame, text: str, most: int) -> list[bytes]:
    """At most ``most`` windows, chosen by their hash: what the trainer learns from."""
    def cut(batches):
        for batch in batches:
            yield from (pa.RecordBatch.from_arrays([pa.array(windows(t or ""), pa.binary())], names=["w"]) for t in batch.column(0).to_pylist())

    rows = sample.select(text).mapInArrow(cut, "w binary")
    return [bytes(r.w) for r in rows.orderBy(F.xxhash64("w"), "w").limit(most).collect()]


def reached_by(saved: DataFrame, share: float) -> float:
    """The value that ``share`` of the rows reach, from their counts by value: a window's difference is a small whole number."""
    counts = sorted((r.saved, r.n) for r in saved.groupBy("saved").agg(F.count("*").alias("n")).collect())
    if not counts:
        return 0.0
    values, n = (np.array(c) for c in zip(*counts))
    return float(values[np.searchsorted(np.cumsum(n), (1 - share) * n.sum(), "left").clip(0, len(values) - 1)])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 40, stands_for: np.ndarray | None = None) -> np.ndarray:
    """Weights of the measures; each row counts as the ``stands_for`` rows it was sampled from."""
    share = np.ones(len(y)) if stands_for is None else stands_for
    share = share / share.sum()
    weights = np.zeros(x.shape[1])
    ridge = penalty * np.r_[0.0, np.ones(x.shape[1] - 1)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (share * (p - y)) + ridge * weights
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(weights))
        weights -= np.linalg.solve(bend, slope)
    return weights


def _sample(labels: DataFrame, key: str, toxic: str, sizes: tuple[int, int]) -> tuple[dict[int, int], dict[int, float]]:
    """At most ``sizes`` keys of class 1 and 0, chosen by hash; a key with both labels is toxic.
    With them, by class, how many of all labelled keys each chosen one stands for.
    """
    one = labels.filter(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(key).agg(F.max(toxic).alias("y"))
    total = {r.y: r.n for r in one.filter(F.col("y").isin(0, 1)).groupBy("y").agg(F.count("*").alias("n")).collect()}
    taken: dict[int, int] = {}
    stands_for: dict[int, float] = {}
    for y, n in ((1, sizes[0]), (0, sizes[1])):
        keys = [r[0] for r in one.filter(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(n).select(key).collect()]
        taken |= dict.fromkeys(keys, y)
        stands_for[y] = total.get(y, 0) / max(len(keys), 1)
    return taken, stands_for


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic",
        most_toxic: int = 3000, most_ordinary: int = 6000, most_windows: int = 100_000, ordinary_lost: float = 0.05) -> Model:
    """Train on a bounded sample of labelled rows: at most ``most_toxic`` and ``most_ordinary``
    documents, by their whole texts. Two thirds of them (by hash) train the dictionaries, the
    trainer seeing at most ``most_windows`` of their ordinary windows; the other third calibrates
    the threshold of a window (which 1 % of their ordinary windows reach), the weights, in which
    each class counts as much as among all labelled rows, so that a score of 0.5 means the same at
    any size, and the ``cut``, which ``ordinary_lost`` of their ordinary texts reach. Without labels
    of both kinds the model says 0 for every text.
    """
    spark = docs.sparkSession
    silent = Model(b" ", b" ", 1.0, [-30.0] + [0.0] * (FEATURES - 1))
    classes, stands_for = _sample(labels, key, toxic, (most_toxic, most_ordinary))
    if len(set(classes.values())) < 2:
        return silent
    kind = dict(docs.dtypes)[key]
    chosen = spark.createDataFrame([(k, y) for k, y in classes.items()], f"`{key}` {kind}, _y int")  # bounded by the two sizes
    sample = stored(docs.select(key, text).join(F.broadcast(chosen), key).dropDuplicates([key])
                    .withColumn("_part", (F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.lit(3)) == 0).cast("int")), "toxic-sample")
    there = {(r._y, r._part) for r in sample.select("_y", "_part").distinct().collect()}
    if {y for y, _ in there} != {0, 1}:
        return silent

    def part(y: int, wanted: int) -> DataFrame:
        """A class's documents to train (0) or calibrate (1) with: the others where it has none of the wanted ones."""
        return sample.filter((F.col("_y") == y) & (F.col("_part") == (wanted if (y, wanted) in there else 1 - wanted)))

    model = Model(*train_dictionaries(best_pieces(part(1, 0).unionByName(part(0, 0)), text), some_windows(part(0, 0), text, most_windows)), 1.0, [])

    def save(batches):
        a, b = model.compressors()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(differences(t or "", a, b))], names=["saved"])

    model.threshold = max(1.0, reached_by(part(0, 1).select(text).mapInArrow(save, "saved double"), 0.01))
    known = _measured(part(0, 1).unionByName(part(1, 1)), model, text, "_y", "int").collect()  # ten numbers a sampled document
    x, y = np.array([r.measures for r in known]), np.array([r._y for r in known], float)
    weights = logistic(x, y, stands_for=np.where(y == 1, stands_for[1], stands_for[0]))
    model.weights = weights.tolist()
    ordinary = 1 / (1 + np.exp(-x[y == 0] @ weights))
    model.cut = float(np.nextafter(np.quantile(ordinary, 1 - ordinary_lost, method="higher"), 2))
    return model


def _measured(docs: DataFrame, model: Model, text: str, key: str, kind: str) -> DataFrame:
    def run(batches):
        a, b = model.compressors()
        for batch in batches:
            found = [measures(differences(t or "", a, b), model.threshold) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=[key, "measures"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, measures array<double>")


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, score`` for every row, from its whole text alone; null counts as the empty text."""
    weights = F.array(*map(F.lit, model.weights))
    found = _measured(docs, model, text, key, dict(docs.dtypes)[key])
    total = F.aggregate(F.zip_with("measures", weights, lambda m, w: m * w), F.lit(0.0), lambda s, v: s + v)
    return found.select(key, (1 / (1 + F.exp(-total))).alias("score"))


def keep_ordinary(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below ``threshold`` (``model.cut`` is a calibrated one), with the columns they came with."""
    kinds = docs.schema

    def run(batches):
        a, b = model.compressors()
        weights = np.array(model.weights)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            total = np.array([np.dot(weights, measures(differences(t or "", a, b), model.threshold)) for t in texts])
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))) < threshold))

    return docs.mapInArrow(run, kinds)
