"""Phrase collocations from weighted acyclic automata.

The phrases (up to four words) of a shard, sorted and counted, are built into a minimal acyclic
automaton whose transitions carry a word and a count: states are registered from the longest
phrases up, and a state that equals a registered one is not stored again. An automaton leaves its
shard in ranges of prefixes, and a task unites all automata of one range, adding the counts.
Only then is a phrase called rare. The counts of a candidate's parts come from composing an
automaton of the wanted parts with the counted one of their range.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordtrail.llm.common import lower_ascii, running_sum, settings, stored, text_or_empty
from wordtrail.llm.interpolation import distinct, pack, rows_of, unpack

# fixed values: what ends a piece, and what separates words
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
BREAK = b"."
TO_TOKENS = bytes(ord(BREAK) if c in ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
AUTOMATON = "lang string, range int, n long, parts array<binary>"
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens_of(text: str) -> list[bytes]:
    """Words and, between pieces, ``BREAK``."""
    return text.encode("utf-8", "surrogatepass").translate(TO_TOKENS).replace(BREAK, b" . ").split()


def expanded(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the stretches ``first .. first + count - 1``, and each place's stretch."""
    of = np.repeat(np.arange(len(count)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of], of


class Trie:
    """Sorted phrases by length: of each its parent among those one word shorter, its last word, its weight.

    ``words`` are sorted, so phrases are sorted by their words. A phrase of weight 0 is no member,
    but the beginning of one.
    """

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    @classmethod
    def of_tokens(cls, tokens: np.ndarray, words: list[bytes], longest: int) -> Trie:
        """All phrases of a row of word numbers, in which -1 ends a piece."""
        levels, at, whole = [], tokens.astype(np.int64), tokens >= 0
        levels.append((np.zeros(len(words), np.int64), np.arange(len(words)), np.bincount(tokens[whole], minlength=len(words))))
        for n in range(2, longest + 1):
            whole = whole[:-1] & (tokens[n - 1:] >= 0)
            keys, _, rank = distinct(at[:len(whole)][whole] * len(words) + tokens[n - 1:][whole])
            levels.append((keys // max(len(words), 1), keys % max(len(words), 1), np.bincount(rank, minlength=len(keys))))
            at = np.zeros(len(whole), np.int64)
            at[whole] = rank
        return cls(words, levels)

    @classmethod
    def of_phrases(cls, phrases: list[tuple[bytes, ...]], longest: int) -> Trie:
        """A trie of the given phrases, each of weight 1."""
        words = sorted({w for p in phrases for w in p})
        number = {w: i for i, w in enumerate(words)}
        every, members = {p[:n] for p in phrases for n in range(1, len(p) + 1)}, set(phrases)
        levels, before = [], {(): 0}
        for n in range(1, longest + 1):
            own = sorted(p for p in every if len(p) == n)
            levels.append(tuple(np.array(x, np.int64) for x in ([before[p[:-1]] for p in own], [number[p[-1]] for p in own], [int(p in members) for p in own])))
            before = {p: i for i, p in enumerate(own)}
        return cls(words, levels)

    def size(self) -> int:
        return sum(len(label) for _, label, _ in self.levels)

    def children(self, n: int) -> np.ndarray:
        """Where the children of each phrase of ``n`` words start among those one word longer, and their end."""
        parents = len(self.levels[n - 1][0]) if n else 1
        return np.searchsorted(self.levels[n][0], np.arange(parents + 1))

    def cut(self, bound: tuple[bytes, ...], children: list[np.ndarray]) -> list[int]:
        """For each length the first phrase that does not sort before ``bound``."""
        out, exact, above = [], 0, 0
        for n, (_, label, _) in enumerate(self.levels):
            if exact is None or n >= len(bound):
                above = int(children[n][above if exact is None else exact]) if n else 0
                exact = None
            else:
                first, end = int(children[n][exact]), int(children[n][exact + 1])
                word = bisect_left(self.words, bound[n])
                above = first + int(np.searchsorted(label[first:end], word))
                hit = above < end and word < len(self.words) and self.words[word] == bound[n] and label[above] == word
                exact = above if hit else None
                if hit and n + 1 < len(bound):
                    above += 1  # the beginning of the bound sorts before it
            out.append(above)
        return out

    def between(self, low: list[int], high: list[int]) -> Trie | None:
        """The phrases from one cut to the next, with the beginnings of the first ones at weight 0."""
        first = list(low)
        for n in range(len(first) - 1, 0, -1):
            if first[n] < high[n]:
                first[n - 1] = min(first[n - 1], int(self.levels[n][0][first[n]]))
        levels = []
        for n, (parent, label, weight) in enumerate(self.levels):
            own = weight[first[n]:high[n]].copy()
            own[:low[n] - first[n]] = 0
            levels.append((parent[first[n]:high[n]] - (first[n - 1] if n else 0), label[first[n]:high[n]], own))
        return Trie(self.words, levels).compact() if len(levels[0][0]) else None

    def compact(self) -> Trie:
        """Without words that no phrase has."""
        used = np.unique(np.concatenate([label for _, label, _ in self.levels]))
        return Trie([self.words[i] for i in used], [(p, np.searchsorted(used, label), w) for p, label, w in self.levels])

    def pruned(self, least: int) -> Trie:
        """Members of at least that weight, and their beginnings."""
        keep = [w >= least for _, _, w in self.levels]
        for n in range(len(keep) - 1, 0, -1):
            keep[n - 1][self.levels[n][0][keep[n]]] = True
        levels, number = [], np.zeros(1, np.int64)
        for (parent, label, weight), k in zip(self.levels, keep):
            levels.append((number[parent[k]], label[k], np.where(weight[k] >= least, weight[k], 0)))
            number = np.cumsum(k) - 1
        return Trie(self.words, levels).compact()

    def phrases(self) -> list[list[tuple[tuple[bytes, ...], int]]]:
        """By length: every phrase and its weight, beginnings included."""
        out, before = [], [()]
        for parent, label, weight in self.levels:
            own = [(*before[p], self.words[i]) for p, i in zip(parent.tolist(), label.tolist())]
            out.append(list(zip(own, weight.tolist())))
            before = own
        return out

    # ---- automata

    def automaton(self) -> list[bytes]:
        """The words, then for each length the states' numbers of transitions and the transitions (word, weight, target)."""
        depth, out = len(self.levels), []
        target = np.zeros(len(self.levels[-1][0]), np.int64)  # all of the longest phrases end in one state
        for n in range(depth - 1, -1, -1):
            _, label, weight = self.levels[n]
            start = self.children(n)
            count = np.diff(start)
            kept, target_of = registered(start[:-1], count, label, weight, target)
            places, _ = expanded(start[:-1][kept], count[kept])
            out = [pack(count[kept]), pack(label[places]), pack(weight[places]), pack(target[places]), *out]
            target = target_of
        return [zstandard.ZstdCompressor(level=1).compress(b" ".join(self.words)), *out]

    @classmethod
    def of_automaton(cls, parts: list[bytes]) -> Trie:
        """All paths of an automaton, in order."""
        words = zstandard.ZstdDecompressor().decompress(parts[0])
        levels, state = [], np.zeros(1, np.int64)
        for at in range(1, len(parts), 4):
            count, label, weight, target = (unpack(p).astype(np.int64) for p in parts[at:at + 4])
            places, parent = expanded((np.cumsum(count) - count)[state], count[state])
            levels.append((parent, label[places], weight[places]))
            state = target[places]
        return cls(words.split(b" ") if words else [], levels)


def registered(start: np.ndarray, count: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different states among those given by their transitions, and the number of each one's equal.

    States are looked up by a hash of their transitions and compared with the registered one;
    one whose hash lies is registered for itself.
    """
    mixed = (label.astype(np.uint64) * C1) ^ (weight.astype(np.uint64) * C2 + target.astype(np.uint64))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * C2
    mixed ^= mixed >> np.uint64(29)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)]
    _, first, at = distinct(sums[start + count] - sums[start] + count.astype(np.uint64) * C1)
    equal = first[at]
    same = count == count[equal]
    places, of = expanded(start[same], count[same])
    theirs = places - start[same][of] + start[equal[same]][of]
    wrong = (label[places] != label[theirs]) | (weight[places] != weight[theirs]) | (target[places] != target[theirs])
    same[np.flatnonzero(same)[np.unique(of[wrong])]] = False
    equal = np.where(same, equal, np.arange(len(equal)))
    kept = np.unique(equal)
    return kept, np.searchsorted(kept, equal)


def union(tries: list[Trie]) -> Trie:
    """All phrases of the tries, with the sums of their weights."""
    words = sorted(set().union(*(t.words for t in tries)))
    number = {w: i for i, w in enumerate(words)}
    maps = [np.array([number[w] for w in t.words], np.int64) for t in tries]
    before, levels = [np.zeros(1, np.int64) for _ in tries], []
    for n in range(len(tries[0].levels)):
        keys = np.concatenate([b[t.levels[n][0]] * max(len(words), 1) + m[t.levels[n][1]] for t, m, b in zip(tries, maps, before)])
        order = np.argsort(keys)
        new = np.flatnonzero(np.r_[True, np.diff(keys[order]) > 0]) if len(keys) else np.zeros(0, np.int64)
        weights = np.concatenate([t.levels[n][2] for t in tries])[order]
        unique = keys[order][new]
        levels.append((unique // max(len(words), 1), unique % max(len(words), 1), np.add.reduceat(weights, new) if len(new) else weights))
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(keys)]))
        before = np.split(rank, np.cumsum([len(t.levels[n][0]) for t in tries])[:-1])
    return Trie(words, levels)


def composed(wanted: Trie, counted: Trie) -> Trie | None:
    """The phrases of both, weights of ``counted``: pairs of states go on together by a common word."""
    number = {w: i for i, w in enumerate(counted.words)}
    other = np.array([number.get(w, -1) for w in wanted.words], np.int64)
    pair, kept, levels = np.zeros(1, np.int64), np.zeros(1, np.int64), []  # state of each kept node in counted; number of each wanted node
    for (parent, label, member), (theirs, their_label, weight) in zip(wanted.levels, counted.levels):
        mine = kept[parent]
        keys = theirs * (len(counted.words) + 1) + their_label
        look = pair[np.maximum(mine, 0)] * (len(counted.words) + 1) + other[label]
        at = np.searchsorted(keys, look)
        hit = (mine >= 0) & (other[label] >= 0) & (keys[np.minimum(at, len(keys) - 1)] == look if len(keys) else False)
        levels.append((mine[hit], label[hit], np.where(member[hit] > 0, weight[at[hit]], 0)))
        pair, kept = np.r_[at[hit], 0], np.where(hit, np.cumsum(hit) - 1, -1)
    return Trie(wanted.words, levels).compact() if len(levels[0][0]) else None


# ---- over the cluster

def lang_of(lang: str) -> Column:
    return F.coalesce(F.col(lang), F.lit("und"))


def bounds(docs: DataFrame, text: str, lang: str, longest: int, range_bytes: int, most_ranges: int) -> dict[str, list[tuple[bytes, ...]]]:
    """Phrases that cut each language into ranges of similar size.

    Taken from phrases at regular places of every text, one in about two thousand characters; they
    only balance the tasks and have no bearing on the result. At most ``most_ranges`` come to the driver.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = min(most_ranges, total // range_bytes + 1)
    if ranges == 1:
        return {}
    n = F.char_length(F.col("t"))
    steps = F.greatest(F.lit(2000), F.ceil(n / 64)).cast("int")
    at = (docs.select(lang_of(lang).alias("lang"), text_or_empty(text).alias("t")).filter(n > 0)
          .select("lang", "t", F.explode(F.sequence(F.lit(1), n, steps)).alias("at")))
    words = F.filter(F.split(lower_ascii(F.substring("t", F.col("at") + F.pmod(F.xxhash64("t", "at"), F.lit(1900)).cast("int"), F.lit(200))),
                             r"[.,;:!?\n\x0B\f\r \t]+"), lambda w: w != "")
    picked = at.select("lang", F.array_join(F.slice(words, 2, longest), " ").alias("phrase"), F.lit(1).alias("one")).filter("phrase <> ''")
    ordered = running_sum(stored(picked, "phrase-bounds"), ["lang", "phrase"], "one", "number")
    step = max(1, ordered.count() // ranges)
    out: dict[str, set[tuple[bytes, ...]]] = defaultdict(set)
    for r in ordered.filter((F.col("number") % step == step - 1) & (F.col("number") >= step)).select("lang", "phrase").collect():
        out[r.lang].add(tuple(r.phrase.encode().split(b" ")))
    return {k: sorted(v) for k, v in out.items()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<binary>": pa.list_(pa.binary())}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[f for f, _ in fields])


def shards(docs: DataFrame, text: str, lang: str, cuts: dict, longest: int, shard_tokens: int) -> DataFrame:
    """Automata of the phrases of some million words, by language and range."""
    def build(batches):
        def fresh():
            known: dict[str, defaultdict] = {}
            return known, defaultdict(list)

        def leave():
            for name, rows in tokens.items():
                words = list(known[name])[1:]
                order = sorted(range(len(words)), key=words.__getitem__)
                rank = np.full(len(words) + 1, -1, np.int64)
                rank[np.array(order, np.int64) + 1] = np.arange(len(order))
                row = rank[np.concatenate(rows)]
                trie = Trie.of_tokens(row, [words[i] for i in order], longest)
                children, n = [trie.children(i) for i in range(longest)], int((row >= 0).sum())
                ends = [trie.cut(b, children) for b in cuts.get(name, [])] + [[len(label) for _, label, _ in trie.levels]]
                low = [0] * longest
                for number, high in enumerate(ends):
                    part = trie.between(low, high)
                    if part is not None:
                        yield batch_of([(name, number, n, part.automaton())], AUTOMATON)
                        n = 0
                    low = high

        (known, tokens), total = fresh(), 0
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in known:
                    known[name] = defaultdict()
                    known[name].default_factory = known[name].__len__
                    known[name][BREAK]  # word 0
                own = known[name]
                tokens[name].append(np.array([own[w] for w in tokens_of(t)] + [0], np.int32))
                total += len(tokens[name][-1])
                if total >= shard_tokens:
                    yield from leave()
                    (known, tokens), total = fresh(), 0
        yield from leave()

    return docs.select(lang_of(lang), text_or_empty(text)).mapInArrow(build, AUTOMATON)


def by_range(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(rows)`` over the rows of each language and range, which come as an iterator."""
    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for row in rows_of(batch):
                if held and (held[0]["lang"], held[0]["range"]) != (row["lang"], row["range"]):
                    yield from work(held)
                    held = []
                held.append(row)
        if held:
            yield from work(held)

    return rows.repartition("lang", "range").sortWithinPartitions("lang", "range").mapInArrow(run, schema)


def unite(held: list[dict], least: int, most_nodes: int = 3 << 20) -> Trie:
    """One trie of all automata of a range, a bounded number of paths at a time."""
    tries: list[Trie] = []
    for row in held:
        tries.append(Trie.of_automaton(row["parts"]))
        if sum(t.size() for t in tries) > most_nodes and len(tries) > 1:
            tries = [union(tries)]
            most_nodes = max(most_nodes, 2 * tries[0].size())
    return (union(tries) if len(tries) > 1 else tries[0]).pruned(least)


FOUND = "lang string, phrase string, a long, l long, r long, score long"


def scored(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, range_bytes: int = 8 << 20,
           most_ranges: int = 1 << 16, shard_tokens: int = 1_200_000) -> tuple[DataFrame, DataFrame]:
    """All candidates ``lang, phrase, a, l, r, score``, and ``lang, n``.

    A candidate is a phrase of 2 to ``longest`` words with at least ``least`` occurrences. Of its
    cuts into two parts the one of the lowest score ``2000000 * a / (l + r)``, rounded down, counts,
    and of equal ones the first. Null texts are empty; a missing language is ``und``.
    """
    cuts = bounds(docs, text, lang, longest, range_bytes, most_ranges)

    def sum_up(held):
        n = sum(r["n"] for r in held)
        yield batch_of([(held[0]["lang"], held[0]["range"], n, unite(held, least).automaton())], AUTOMATON)

    def ask(batches):
        for batch in batches:
            for row in rows_of(batch):
                wanted: dict[int, set] = defaultdict(set)
                own = cuts.get(row["lang"], [])
                for phrases in Trie.of_automaton(row["parts"]).phrases()[1:]:
                    for p, a in phrases:
                        for k in range(1, len(p)) if a else ():
                            for part in (p[:k], p[k:]):
                                wanted[bisect_right(own, part)].add(part)
                rows = [(row["lang"], number, row["range"], Trie.of_phrases(list(parts), longest).automaton()) for number, parts in wanted.items()]
                if rows:
                    yield batch_of(rows, AUTOMATON)  # n: who asks

    def answer(held):
        counted = next((Trie.of_automaton(r["parts"]) for r in held if r["kind"] == 0), None)
        for r in held if counted else ():
            if r["kind"] == 1 and (got := composed(Trie.of_automaton(r["parts"]), counted)) is not None:
                yield batch_of([(r["lang"], r["n"], 0, got.automaton())], AUTOMATON)

    def score(held):
        counts = {p: a for r in held if r["kind"] == 1 for phrases in Trie.of_automaton(r["parts"]).phrases() for p, a in phrases if a}
        rows = []
        for phrases in next(Trie.of_automaton(r["parts"]) for r in held if r["kind"] == 0).phrases()[1:]:
            for p, a in phrases:
                if a:
                    parts = [(counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
                    value, k = min((2_000_000 * a // (x + y), k) for k, (x, y) in enumerate(parts))
                    rows.append((held[0]["lang"], b" ".join(p).decode("utf-8", "surrogatepass"), a, *parts[k], value))
        if rows:
            yield batch_of(rows, FOUND)

    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="8"):  # a row is an automaton
        counted = stored(by_range(shards(docs, text, lang, cuts, longest, shard_tokens), sum_up, AUTOMATON), "phrase-counts")
        questions = stored(counted.mapInArrow(ask, AUTOMATON), "phrase-parts")
        both = counted.withColumn("kind", F.lit(0)).unionByName(questions.withColumn("kind", F.lit(1)))
        answers = stored(by_range(both, answer, AUTOMATON), "part-counts")
        both = counted.withColumn("kind", F.lit(0)).unionByName(answers.withColumn("kind", F.lit(1)))
        found = stored(by_range(both, score, FOUND), "phrase-scores")
    return found, counted.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", first: int = 2000, share: int = 80, **how) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first phrases by score, count and bytes.

    A candidate whose words lie inside a longer candidate of at least ``share`` percent of its
    occurrences is dropped. ``how`` goes to ``scored``. An empty table gives no row.
    """
    found, sizes = scored(docs, text, lang, **how)
    words = F.split("phrase", " ", -1)
    n = F.size(words)
    starts = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda size: F.transform(
        F.sequence(F.lit(1), n - size + 1), lambda at: F.array_join(F.slice(words, at, size), " "))))
    inside = (found.filter(n > 2).select("lang", F.col("a").alias("longer"), F.explode(starts).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    kept = (found.join(inside, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * share)).drop("longer"))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    # a language in parts first: each part's best, so that no task holds all of its phrases
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best)
    some = kept.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= first)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
