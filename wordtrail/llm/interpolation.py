"""Language-model scores by deleted interpolation of n-gram estimates.

The corpus is cut into units of a few million tokens, kept as arrays of local word numbers. An
n-gram is a 64-bit hash (two of a trillion different ones share a hash with a chance of about one
in eighteen million each). For each length a unit sends the keys and counts of its n-grams, by key
range; a range sums them and sends each unit back only the sums, in the order of the keys. An
n-gram whose first or last n-1 words occur in no other unit is counted at home and never sent;
no other unit can hold it.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtrail.llm.common import settings, stored
from wordtrail.session import shared_path

HELD_OUT, TRAIN, DEVELOP = 0, 1, 2
UNIT = ("unit long, n_docs long, n_train long, n_main long, keys array<long>, roles binary, sizes binary, tokens binary, words binary")
ANSWER = "unit long, n int, range int, main binary, extra binary, shared binary, types long, tokens long, main_tokens long"
C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, in as many bytes each as the largest needs, compressed."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(values) or values.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}")


def narrow(values: np.ndarray) -> np.ndarray:
    """Counts in four bytes where they fit."""
    return values.astype(np.int32) if not len(values) or values.max() < 1 << 31 else values


def joined(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Key of an n-gram from the key of all but its last word and the key of that word."""
    x = before * C1 + (last ^ C3)
    x = (x ^ (x >> np.uint64(29))) * C2
    return x ^ (x >> np.uint64(32))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and each key's rank; ``np.unique`` would sort stably, at over twice the cost."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    at = np.empty(len(keys), np.int32 if len(keys) < 1 << 31 else np.int64)
    at[order] = np.cumsum(new, dtype=at.dtype) - 1
    return keys[new], order[new], at


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def units(docs: DataFrame, text: str, key: str, held_out: Column, develop: Column, unit_tokens: int) -> DataFrame:
    """One row for some millions of tokens of consecutive rows; a longer text makes a longer unit."""
    role = F.when(held_out, HELD_OUT).when(develop, DEVELOP).otherwise(TRAIN)

    def build(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0

        def row():
            tokens, lengths = np.concatenate(numbers), np.array(sizes, np.int64)
            kinds = np.array(roles, np.int64)
            data = [(task << 24) + number, len(keys), int((kinds != HELD_OUT).sum()), int((kinds == TRAIN).sum()), keys, pack(kinds), pack(lengths),
                    pack(tokens), zstandard.ZstdCompressor(level=1).compress(b" ".join(list(known)[1:]))]
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(data, types)], names=[c.split()[0] for c in UNIT.split(", ")])

        def fresh():
            vocabulary = defaultdict()
            vocabulary.default_factory = vocabulary.__len__
            vocabulary[b""]  # the end of a text is word 0
            return vocabulary

        known, keys, roles, sizes, numbers, total = fresh(), [], [], [], [], 0
        for batch in batches:
            for k, t, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = [known[w] for w in words_of(t or "")]
                own.append(0)
                keys.append(k), roles.append(r), sizes.append(len(own)), numbers.append(np.array(own, np.int32))
                total += len(own)
                if total >= unit_tokens:
                    yield row()
                    known, keys, roles, sizes, numbers, total, number = fresh(), [], [], [], [], 0, number + 1
        if keys:
            yield row()

    return docs.select(F.col(key).cast("long"), F.col(text), role).mapInArrow(build, UNIT)


def rows_of(batch: pa.RecordBatch):
    """One row at a time: a unit is large."""
    for at in range(batch.num_rows):
        yield batch.slice(at, 1).to_pylist()[0]


def shifted(values: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """Each position's value of the position before; ``first`` at the start of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = first
    return out


class Unit:
    """A unit's n-grams of growing length, with counts over all of the corpus as answers come in."""

    def __init__(self, row: dict, keep: bool = False):
        """``keep``: hold the counts of each position, without (``main``) and with (``total``) the development texts."""
        self.keep = keep
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        self.roles, self.tokens = unpack(row["roles"]), unpack(row["tokens"])
        words = zstandard.ZstdDecompressor().decompress(row["words"])
        digest = xxhash.xxh64_intdigest
        self.hashes = np.array([digest(b"\n"), *map(digest, words.split(b" ") if words else [])], np.uint64)
        self.word_keys = self.hashes[self.tokens]
        self.role = np.repeat(self.roles, self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.n, self.keys, self.main, self.total = 0, None, [], []

    def grow(self) -> None:
        """Go on to n-grams one word longer; finds which of them other units may have too."""
        self.n += 1
        if self.n == 1:
            self.keys, wanted = self.word_keys, None
            self.unique, first, rank = distinct(self.hashes)
            self.at = rank[self.tokens]
        else:
            self.keys = joined(shifted(self.keys, self.starts, np.uint64(self.n)), self.word_keys)
            wanted = self.elsewhere & shifted(self.elsewhere, self.starts, True)
            self.unique, first, self.at = distinct(self.keys)
        count = len(self.unique)
        self.own_main = np.bincount(self.at[self.role == TRAIN], minlength=count)
        self.own_total = self.own_main + np.bincount(self.at[self.role == DEVELOP], minlength=count)
        self.sent = np.ones(count, bool) if wanted is None else wanted[first]

    def answered(self, answers: list[dict]) -> None:
        """Take the sums for the n-grams that were sent: concatenated ranges are in the order of the keys."""
        main, total, elsewhere = self.own_main.copy(), self.own_total.copy(), np.zeros(len(self.unique), bool)
        if self.sent.any():
            answers = sorted(answers, key=lambda a: a["range"])
            main[self.sent] = np.concatenate([unpack(a["main"]) for a in answers])
            total[self.sent] = main[self.sent] + np.concatenate([unpack(a["extra"]) for a in answers])
            elsewhere[self.sent] = np.concatenate([unpack(a["shared"]) for a in answers]) > 0
        self.elsewhere = elsewhere[self.at]
        if self.keep:
            self.main.append(narrow(main)[self.at])
            self.total.append(narrow(total)[self.at])

    def take(self, answers: list[dict] | None, longest: int) -> None:
        """Count all n-grams up to the length ``longest``, with the answers for those that were sent."""
        by_length = defaultdict(list)
        for a in answers or []:
            by_length[a["n"]].append(a)
        for n in range(1, longest + 1):
            self.grow()
            self.answered(by_length[n])


def requests(rows: DataFrame, n: int, ranges_bits: int) -> DataFrame:
    """What units send of n-grams of length ``n``; ``rows`` are units with the answers for shorter ones.

    ``extra`` are the counts in the development texts, on top of ``main``; they are mostly zero.
    """
    def send(batches):
        for batch in batches:
            for row in rows_of(batch):
                unit = Unit(row)
                unit.take(row.get("answers"), n - 1)
                unit.grow()
                keys, main, extra = (x[unit.sent] for x in (unit.unique, unit.own_main, unit.own_total - unit.own_main))
                if not len(keys):
                    continue
                part = (keys >> np.uint64(64 - ranges_bits)).astype(np.int64) if ranges_bits else np.zeros(len(keys), np.int64)
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                stops = np.r_[cuts[1:], len(keys)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(cuts), row["unit"])), pa.array(part[cuts], pa.int32()),
                    pa.array([keys[a:b].tobytes() for a, b in zip(cuts, stops)], pa.binary()),
                    pa.array([pack(main[a:b]) for a, b in zip(cuts, stops)], pa.binary()),
                    pa.array([pack(extra[a:b]) for a, b in zip(cuts, stops)], pa.binary())], names=["unit", "range", "keys", "main", "extra"])

    return rows.mapInArrow(send, "unit long, range int, keys binary, main binary, extra binary")


def answers(asked: DataFrame, n: int, partitions: int) -> DataFrame:
    """Sums over all units, one row for each range that a unit sent."""
    def reply(sent: list[dict]) -> pa.RecordBatch:
        keys = [np.frombuffer(r["keys"], np.uint64) for r in sent]
        unique, _, at = distinct(np.concatenate(keys))
        main, extra = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        holders = np.bincount(at, minlength=len(unique))  # units that don't send a key are its only holders
        stops = np.cumsum([len(k) for k in keys])
        places = np.split(at, stops[:-1])
        for r, place in zip(sent, places):  # keys are distinct within one sender
            main[place] += unpack(r["main"])
            extra[place] += unpack(r["extra"])
        rest = [0] * (len(sent) - 1)
        return pa.RecordBatch.from_arrays([
            pa.array([r["unit"] for r in sent], pa.int64()), pa.array([n] * len(sent), pa.int32()), pa.array([r["range"] for r in sent], pa.int32()),
            pa.array([pack(main[p]) for p in places], pa.binary()), pa.array([pack(extra[p]) for p in places], pa.binary()),
            pa.array([pack(holders[p] > 1) for p in places], pa.binary()), pa.array([int((main + extra > 0).sum()), *rest], pa.int64()), pa.array([int((main + extra).sum()), *rest], pa.int64()),
            pa.array([int(main.sum()), *rest], pa.int64())], names=[c.split()[0] for c in ANSWER.split(", ")])

    def run(batches):
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["range"] != row["range"]:
                    yield reply(held)
                    held = []
                held.append(row)
        if held:
            yield reply(held)

    return asked.repartition(partitions, "range").sortWithinPartitions("range").mapInArrow(run, ANSWER)


# ---- the mixture

COUNTED = "keys array<long>, roles binary, sizes binary, counts array<binary>, data binary, n binary"


def estimates(counts: list[np.ndarray], starts: np.ndarray, size: dict, texts: int, tokens: int, piece: int = 1 << 18):
    """For pieces of a unit: (slice, bucket of each position, estimates: uniform, then by n-grams of length 1, 2, ...).

    The bucket is the length of the longest context seen in training and the power of two below
    its frequency, of which the last is 2^15.
    """
    order = len(counts)
    contexts = [shifted(c.astype(np.int64), starts, texts) for c in counts[:-1]]
    for at in range(0, len(counts[0]), piece):
        part = slice(at, min(at + piece, len(counts[0])))
        p = np.zeros((part.stop - at, order + 1))
        p[:, 0] = 1.0 / (size["types"] + 1)
        p[:, 1] = counts[0][part] / max(tokens, 1)
        bucket = np.zeros(len(p), np.int64)
        for n in range(2, order + 1):
            context = contexts[n - 2][part]
            seen = context > 0
            p[:, n] = np.where(seen, counts[n - 1][part] / np.maximum(context, 1), 0.0)
            level = np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), 15)
            bucket = np.where(seen, (n - 2) * 16 + level + 1, bucket)
        yield part, bucket, p


def counted(rows: DataFrame, order: int, size: dict) -> DataFrame:
    """A unit a row: every position's counts for the scores, and the estimates of its development
    tokens (bucket, then n-grams of length 1, 2, ...; each distinct row with its number)."""
    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                unit = Unit(row, keep=True)
                unit.take(row["answers"], order)
                data, n = np.zeros((0, order + 1), np.float32), np.zeros(0, np.int64)
                if (unit.role == DEVELOP).any():
                    chosen = []
                    for part, bucket, p in estimates(unit.main, unit.starts, size, size["main_texts"], size["main_tokens"]):
                        at = unit.role[part] == DEVELOP
                        chosen.append(np.concatenate([bucket[at][:, None], p[at][:, 1:]], axis=1).astype(np.float32))
                    data, n = np.unique(np.concatenate(chosen), axis=0, return_counts=True)
                values = [row["keys"], row["roles"], row["sizes"], [pack(c) for c in unit.total], data.tobytes(), n.astype(np.int64).tobytes()]
                kinds = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in COUNTED.split(", ")])

    return stored(rows.mapInArrow(run, COUNTED), "lm-positions")


def fit_weights(kept: DataFrame, order: int, size: dict, rounds: int, tolerance: float = 1e-5) -> np.ndarray:
    """Mixture weights a bucket by expectation-maximisation over the development texts.

    ``kept`` has their estimates (``data, n`` of ``counted``); their tokens were left out of the
    counts used there. Each round is one sum over all of them.
    """
    buckets = 16 * max(order - 1, 0) + 1
    # a context no longer than the bucket's: estimates of longer ones are zero there and take no weight
    possible = np.arange(order + 1) <= 1 + (np.arange(buckets)[:, None] + 15) // 16
    weights = possible / possible.sum(axis=1, keepdims=True)
    uniform, before = 1.0 / (size["types"] + 1), -np.inf

    for _ in range(rounds):
        def expected(batches, weights=weights):
            total, gain, tokens = np.zeros((buckets, order + 1)), 0.0, 0
            for batch in batches:
                for data, n in zip(batch.column("data").to_pylist(), batch.column("n").to_pylist()):
                    data = np.frombuffer(data, np.float32).reshape(-1, order + 1).astype(np.float64)
                    n = np.frombuffer(n, np.int64)
                    bucket = data[:, 0].astype(np.int64)
                    data[:, 0] = uniform
                    share = weights[bucket] * data
                    sums = share.sum(axis=1)
                    gain += float((n * np.log(sums)).sum())
                    tokens += int(n.sum())
                    share *= (n / sums)[:, None]
                    for k in range(order + 1):
                        total[:, k] += np.bincount(bucket, share[:, k], buckets)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64())), pa.array([gain]), pa.array([tokens], pa.int64())], names=["total", "gain", "tokens"])

        sums = kept.mapInArrow(expected, "total array<double>, gain double, tokens long")
        parts = sums.select(F.posexplode("total"), "gain", "tokens").groupBy("pos").agg(
            F.sum("col").alias("v"), F.sum("gain").alias("gain"), F.sum("tokens").alias("tokens")).collect()  # a row a weight
        if not parts or not parts[0].tokens:
            break
        total = np.zeros(buckets * (order + 1))
        for r in parts:
            total[r.pos] = r.v
        total = total.reshape(weights.shape)
        # a little of the pooled mixture keeps rare buckets sound
        pooled = possible * (total.sum(axis=0) / total.sum())
        weights = total + pooled
        weights /= weights.sum(axis=1, keepdims=True)
        gain = parts[0].gain / parts[0].tokens
        if gain - before < tolerance:
            break
        before = gain
    return weights


def score(docs: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", order: int = 3, rounds: int = 15,
          unit_tokens: int = 1_200_000, develop_share: int = 20) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Trained on the rows that ``held_out`` (a boolean column) excludes not. One in
    ``develop_share`` of them, by hash of the key, is left out of the counts while the weights
    are learned and counted in again for the scores. A null text is empty and has the end token
    alone; a row without a key counts for training. Repeated rows are counted and scored each.
    With no training text every token gets its share of a uniform vocabulary of one.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(2, (2 * partitions - 1).bit_length())
    develop = F.coalesce(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(develop_share)) == 0, F.lit(False))
    name = f"lm_units_{uuid.uuid4().hex}"
    (units(docs, text, key, F.coalesce(held_out, F.lit(False)), develop, unit_tokens).write.bucketBy(partitions, "unit")
     .option("path", shared_path(spark, "lm-units")).saveAsTable(name))  # buckets: units never move again
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="4"):  # a row is a unit, or a unit's share of a range
        corpus = spark.table(name)
        texts = corpus.agg(F.sum("n_train").alias("texts"), F.sum("n_main").alias("main_texts")).first()
        replies: DataFrame | None = None
        size: dict = {}
        for n in range(1, order + 1):
            rows = corpus if replies is None else with_answers(corpus, replies)
            new = stored(answers(requests(rows, n, bits), n, partitions), f"lm-counts-{n}")
            if n == 1:
                sums = new.agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens"), F.sum("main_tokens").alias("main_tokens")).first()
                size = {k: int(v or 0) for k, v in {**sums.asDict(), **texts.asDict()}.items()}
            replies = new if replies is None else replies.unionByName(new)
        rows = counted(with_answers(corpus, replies), order, size)
        weights = fit_weights(rows.select("data", "n"), order, size, rounds)

        def scores(batches):
            names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
            for batch in batches:
                for row in rows_of(batch):
                    sizes, counts = unpack(row["sizes"]).astype(np.int64), [unpack(c) for c in row["counts"]]
                    starts = np.cumsum(sizes) - sizes
                    mixed = np.concatenate([np.log10((weights[bucket] * p).sum(axis=1))
                                            for _, bucket, p in estimates(counts, starts, size, size["texts"], size["tokens"])])
                    base = np.log10((counts[0] + 1.0) / (size["tokens"] + size["types"] + 1))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(row["keys"], pa.int64()), pa.array(unpack(row["roles"]) == HELD_OUT), pa.array(sizes),
                        pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), starts)), pa.array(np.full(len(sizes), size["tokens"])),
                        pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(mixed, starts))], names=names)

        result = stored(rows.select("keys", "roles", "sizes", "counts").mapInArrow(scores, f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                                "base_score double, score double"), "lm-scores")
    spark.sql(f"DROP TABLE {name}")
    return result


def with_answers(corpus: DataFrame, replies: DataFrame) -> DataFrame:
    """Units with all their answers in one array; a unit's answers are about as large as the unit."""
    lists = replies.groupBy("unit").agg(F.collect_list(F.struct("n", "range", "main", "extra", "shared")).alias("answers"))
    return corpus.join(lists, "unit", "left")
