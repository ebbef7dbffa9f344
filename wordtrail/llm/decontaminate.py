"""Benchmark decontamination: BM25 over an inverted index of test items, pruned by block bounds."""

from __future__ import annotations

import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtrail.llm.common import running_sum, stored, text_or_empty

K1, B = 1.2, 0.75
BLANKS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
PASSAGE, STRIDE, PIECE, BLOCK = 128, 64, 64, 32


def tokens(text: str) -> list[bytes]:
    """Lower-cased words; ASCII punctuation parts them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(BLANKS).split()


def shingles(words: list[bytes], n: int = 5) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}


class Index:
    """Postings of the pieces (at most 64 words) of some items, in blocks of 32 pieces with their largest weights.

    A weight is a term's BM25 part in a piece over the sum of the piece's parts, so that scores
    run from 0 to 1 and one threshold suits all. ``need`` is what the essential terms (the
    heaviest of a piece, 0.6 of its weight) must give for the piece to reach the threshold.
    """

    def __init__(self, items: list[tuple[int, list[bytes], list[bytes]]], frequency: dict[bytes, int], n_pieces: int, mean: float, threshold: float):
        self.items, self.threshold = items, threshold
        self.piece_item, parts = [], []
        for number, (_, question, answer) in enumerate(items):
            words = question + answer
            for at in range(0, len(words), PIECE):
                self.piece_item.append(number)
                parts.append(Counter(words[at:at + PIECE]))
        self.piece_item = np.array(self.piece_item, np.int64)
        self.terms: dict[bytes, int] = {}
        rows = []
        self.need = np.zeros(len(parts))
        for piece, counts in enumerate(parts):
            long = sum(counts.values())
            weight = {t: np.log(1 + (n_pieces - frequency[t] + 0.5) / (frequency[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * long / mean))
                      for t, n in counts.items()}
            total, heavy = sum(weight.values()), 0.0
            for t in sorted(weight, key=lambda t: (-weight[t], t)):
                essential = heavy < 0.6
                share = weight[t] / total
                heavy += share if essential else 0
                rows.append((self.terms.setdefault(t, len(self.terms)), piece, share, essential))
            self.need[piece] = threshold - (1 - heavy) - 1e-9
        term, piece, share, essential = (np.array(x) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((piece, term))
        term, piece, share, essential = (x[order] for x in (term, piece, share, essential))
        self.all = self._lists(term, piece, share)
        keep = essential.astype(bool)
        self.heavy = self._lists(term[keep], piece[keep], share[keep])
        self.is_heavy = np.r_[np.diff(self.heavy[0]) > 0, False]  # the last stands for words that no item has
        block = piece // BLOCK
        if len(term):
            first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
            self.blocks = self._lists(term[first], block[first], np.maximum.reduceat(share, first))
        else:
            self.blocks = self._lists(term, block, share)

    def _lists(self, term, value, share):
        starts = np.r_[0, np.cumsum(np.bincount(term.astype(np.int64), minlength=len(self.terms)))]
        return starts, value.astype(np.int64), share.astype(np.float64)

    @staticmethod
    def spread(lists, owner: np.ndarray, term: np.ndarray):
        """(owner, value, share) for all postings of each owner's term."""
        starts, value, share = lists
        n = starts[term + 1] - starts[term]
        at = np.repeat(starts[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(owner, n), value[at], share[at]

    @staticmethod
    def summed(owner: np.ndarray, value: np.ndarray, share: np.ndarray):
        key = owner * (int(value.max(initial=0)) + 1) + value
        unique, first, at = np.unique(key, return_index=True, return_inverse=True)
        return owner[first], value[first], np.bincount(at, share, len(unique))

    def candidates(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, passage, piece, score) of everything at or above the threshold.

        Three bounds, each exact: a passage whose essential terms can't lift any piece to the
        threshold has no pivot and is passed over; in the others, blocks whose summed largest
        weights stay below are skipped; pieces of the live blocks are scored.
        """
        size = np.array([len(d) for d in docs], np.int64)
        passages = np.maximum(1, -(-(size - PASSAGE) // STRIDE) + 1)
        base = np.cumsum(passages) - passages
        term = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(docs)), size)
        place = np.arange(len(term)) - np.repeat(np.cumsum(size) - size, size)
        late = place // STRIDE
        own = np.concatenate([np.minimum(late, passages[doc] - 1), late - 1])
        twice = np.r_[np.arange(len(term)), np.arange(len(term))]
        known = self.is_heavy[term]
        pick = np.r_[known, known & (late >= 1) & (late <= passages[doc] - 1)]
        empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        if not pick.any():
            return empty
        width = len(self.terms) + 1
        pair = np.unique((base[doc[twice[pick]]] + own[pick]) * width + term[twice[pick]])
        owner, piece, got = self.summed(*self.spread(self.heavy, pair // width, pair % width))
        live = np.unique(owner[got >= self.need[piece]])
        if not len(live):
            return empty
        whole = np.searchsorted(base, live, "right") - 1
        start = np.cumsum(size) - size + 0
        pairs = np.unique(np.concatenate([
            p * width + np.unique(docs[d][(p - base[d]) * STRIDE:(p - base[d]) * STRIDE + PASSAGE]) for p, d in zip(live, whole)]))
        owner, term = pairs // width, pairs % width
        owner, term = owner[term < width - 1], term[term < width - 1]
        at, block, bound = self.summed(*self.spread(self.blocks, owner, term))
        high = bound >= self.threshold - 1e-9
        alive = np.unique(at[high] * (len(self.piece_item) // BLOCK + 1) + block[high])
        owner, piece, share = self.spread(self.all, owner, term)
        keep = np.isin(owner * (len(self.piece_item) // BLOCK + 1) + piece // BLOCK, alive)
        owner, piece, score = self.summed(owner[keep], piece[keep], share[keep])
        hit = score >= self.threshold - 1e-9
        owner, piece, score = owner[hit], piece[hit], score[hit]
        d = np.searchsorted(base, owner, "right") - 1
        return d, owner - base[d], piece, score

    def search(self, texts: list[str], overlap: float) -> list[tuple[int, int, float, int, int, int, int]]:
        """(text's place, item's place, best score, shared and all question shingles, the same of the answer)."""
        words = [tokens(t) for t in texts]
        get, none = self.terms.get, len(self.terms)
        docs = [np.array([get(w, none) for w in ws], np.int64) for ws in words]
        met: dict[tuple[int, int], list] = defaultdict(list)
        for d, passage, piece, score in zip(*(x.tolist() for x in self.candidates(docs))):
            met[d, int(self.piece_item[piece])].append((passage, score))
        out = []
        for (d, item), hits in sorted(met.items()):
            _, question, answer = self.items[item]
            reach = len(question) + len(answer)
            near: set = set()
            for passage, _ in hits:
                near |= shingles(words[d][max(0, passage * STRIDE - reach):passage * STRIDE + PASSAGE + reach])
            if min(len(question), len(answer) or 5, 5) < 5:  # shorter than a shingle: look for it whole
                for part in (question, answer):
                    if 0 < len(part) < 5:
                        lo = max(0, min(p for p, _ in hits) * STRIDE - reach)
                        hi = max(p for p, _ in hits) * STRIDE + PASSAGE + reach
                        near |= {tuple(words[d][i:i + len(part)]) for i in range(lo, min(hi, len(words[d])) - len(part) + 1)}
            q, a = shingles(question), shingles(answer)
            nq, na = len(q & near), len(a & near)
            if (not q or nq >= overlap * len(q)) and (not a or na >= overlap * len(a)):
                out.append((d, item, max(s for _, s in hits), nq, len(q), na, len(a)))
        return out


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", question: str = "text",
          answer: str | None = None, item: str = "item_id", threshold: float = 0.6, overlap: float = 0.8,
          index_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, item_id, score, question_shared, question_shingles, answer_shared, answer_shingles``: verified leaks.

    Every passage (128 words, each 64 words) of every text queries the index and retrieves all
    items of at least ``threshold``. A pair is a leak if at least ``overlap`` of the item's
    distinct five-word shingles, of question and of answer each, stand near those passages; an
    item without an answer is judged by its question. Null texts and items without a word match
    nothing; repeated rows give repeated pairs. The items go to the tasks in indexes of at most
    ``index_bytes`` of text (or one longer item), and the texts are read once an index.
    """
    spark = docs.sparkSession
    item_kind, key_kind = dict(benchmark.dtypes)[item], dict(docs.dtypes)[key]
    rows = benchmark.select(F.col(item).alias("item"), text_or_empty(question).alias("question"),
                            (text_or_empty(answer) if answer else F.lit("")).alias("answer")).distinct()
    rows = rows.withColumn("tie", F.xxhash64("question", "answer")).withColumn("n", (F.octet_length("question") + F.octet_length("answer") + 16).cast("long"))
    placed = stored(running_sum(rows, ["item", "tie"], "n", "before").withColumn("part", F.floor(F.col("before") / index_bytes)), "test-items")

    def count(batches):
        for batch in batches:
            out, lengths, pieces = Counter(), 0, 0
            for q, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens(q) + tokens(a)
                for at in range(0, len(words), PIECE):
                    out.update(set(words[at:at + PIECE]))
                    lengths, pieces = lengths + len(words[at:at + PIECE]), pieces + 1
            yield pa.RecordBatch.from_arrays([pa.array([*out, None], pa.binary()), pa.array([*out.values(), pieces], pa.int64()),
                                              pa.array([0] * len(out) + [lengths], pa.int64())], names=["term", "n", "words"])

    counts = stored(placed.select("question", "answer").mapInArrow(count, "term binary, n long, words long")
                    .groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "test-terms")
    total = counts.filter("term IS NULL").first()
    n_pieces, mean = (int(total.n or 0), (total.words or 0) / max(total.n or 0, 1)) if total else (0, 1.0)
    found = None
    for part in sorted(r.part for r in placed.select("part").distinct().collect()):
        own = placed.filter(F.col("part") == part).orderBy("item", "tie").collect()  # bounded by index_bytes
        items = [(r.item, tokens(r.question), tokens(r.answer)) for r in own]
        words = {w for _, q, a in items for w in q + a}
        here = spark.createDataFrame([(bytearray(w),) for w in sorted(words)], "term binary")
        frequency = {bytes(r.term): r.n for r in counts.join(F.broadcast(here), "term").collect()}
        index = spark.sparkContext.broadcast(Index(items, frequency, n_pieces, mean or 1.0, threshold))

        def search(batches, index=index):
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    some = batch.slice(at, 500)
                    hits = index.value.search([t or "" for t in some.column(1).to_pylist()], overlap)
                    if hits:
                        d, i, *rest = zip(*hits)
                        yield pa.RecordBatch.from_arrays(
                            [some.column(0).take(pa.array(d)), pa.array([index.value.items[k][0] for k in i]), pa.array(rest[0], pa.float64()),
                             *[pa.array(x, pa.int64()) for x in rest[1:]]],
                            names=["doc_id", "item_id", "score", "question_shared", "question_shingles", "answer_shared", "answer_shingles"])

        hits = docs.select(key, text).mapInArrow(search, f"doc_id {key_kind}, item_id {item_kind}, score double, question_shared long, "
                                                         "question_shingles long, answer_shared long, answer_shingles long")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], f"doc_id {key_kind}, item_id {item_kind}, score double, question_shared long, "
                                          "question_shingles long, answer_shared long, answer_shingles long")
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The documents with no leak, columns as they came; rows without a key stay."""
    bad = stored(leaks(docs, benchmark, text, key, **how).select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return docs.join(bad, key, "left_anti").select(docs.columns)
