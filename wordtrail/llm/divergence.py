"""How the word use of sources differs, priced pair by pair from sorted arrays.

Every group (language, source) has its terms as sorted arrays of numbers and counts, in blocks of
numbers. Two groups of a language meet in the tasks of their tiles, one a block; a task merges the
arrays of each unordered pair by a galloping intersection and prices terms that both, one or
neither of them have. All prices are whole numbers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordtrail.llm.common import stored

# fixed values of the prices: scale, and what is added to each count
SCALE, EXTRA = 1_000_000_000, 5
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTS = "lang string, source string, term binary, n long, docs long"


def terms_of(text: str) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, A to Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split()


def named(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def term_counts(docs: DataFrame, text: str, lang: str, source: str, most_entries: int) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term, summed up in the tasks first."""
    def count(batches):
        total: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = 0

        def leave():
            for (a, b), (n, d) in total.items():
                if n:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([a] * len(n)), pa.array([b] * len(n)), pa.array(list(n), pa.binary()),
                        pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], names=[c.split()[0] for c in COUNTS.split(", ")])

        for batch in batches:
            for a, b, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n, d = total.setdefault((a, b), (Counter(), Counter()))
                before, words = len(n), terms_of(t)
                n.update(words)
                d.update(set(words))
                entries += len(n) - before
                if entries > most_entries:
                    yield from leave()
                    total, entries = {}, 0
        yield from leave()

    rows = docs.select(named(lang), named(source), named(text)).mapInArrow(count, COUNTS)
    return rows.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(count: np.ndarray, whole: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + EXTRA) / whole)`` by long division in three steps of 1000, exact far beyond 64 bits."""
    if whole > (1 << 63) // 1000 - 1:
        return np.array([1 + SCALE * (int(c) + EXTRA) // whole for c in count], np.int64)
    rest, out = count.astype(np.int64) + EXTRA, np.ones(len(count), np.int64)
    out += (rest // whole) * SCALE
    rest = rest % whole
    for unit in (1_000_000, 1000, 1):
        out += (rest * 1000 // whole) * unit
        rest = rest * 1000 % whole
    return out


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of ``short`` the first place in ``long`` that is not smaller; both are sorted.

    From a guess in proportion, steps double until the value is bracketed, then a binary search
    goes on inside; all values side by side.
    """
    n = len(long)
    if not n or not len(short):
        return np.zeros(len(short), np.int64)
    guess = np.arange(len(short)) * n // len(short)
    right = long[guess] < short  # the place lies right of the guess
    lo, hi, step = np.where(right, guess + 1, 0), np.where(right, n, guess), 1
    at = np.flatnonzero(lo < hi)
    while len(at):
        probe = np.where(right[at], guess[at] + step, guess[at] - step)
        inside = (probe >= 0) & (probe < n)
        at, probe = at[inside], probe[inside]
        below = long[probe] < short[at]
        lo[at], hi[at] = np.where(below, probe + 1, lo[at]), np.where(below, hi[at], probe)
        at, step = at[below == right[at]], step * 2
    while len(at := np.flatnonzero(lo < hi)):
        mid = (lo[at] + hi[at]) >> 1
        below = long[mid] < short[at]
        lo[at], hi[at] = np.where(below, mid + 1, lo[at]), np.where(below, hi[at], mid)
    return lo


def pair_price(a: tuple, b: tuple) -> tuple[int, int]:
    """Price of the terms that one or both have, and their number. A side is (ids, prices, price of an absent term)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = gallop(a[0], b[0])
    hit = at < len(b[0])
    hit[hit] = b[0][at[hit]] == a[0][hit]
    alone = np.ones(len(b[0]), bool)
    alone[at[hit]] = False
    total = np.abs(a[1][hit] - b[1][at[hit]]).sum() + np.abs(a[1][~hit] - b[2]).sum() + np.abs(b[1][alone] - a[2]).sum()
    return int(total), len(a[0]) + int(alone.sum())


PARTS = "lang string, a string, b string, part long, present long, rest long, kept long"


def _sides(table: pa.Table) -> list[tuple]:
    out = []
    for i, (source, n, kept) in enumerate(zip(*(table.column(c).to_pylist() for c in ("source", "n", "kept")))):
        terms = table.column("terms")[i].values
        ids, counts = (np.zeros(0, np.int64),) * 2 if terms is None or not len(terms) else (terms.field(k).to_numpy() for k in (0, 1))
        whole = n + EXTRA * kept
        absent = int(price(np.zeros(1, np.int64), whole)[0]) if kept else 0
        out.append((source, (ids, price(counts, whole), absent), kept))
    return out


def merge_tiles(left: pa.Table, right: pa.Table) -> pa.Table:
    """All unordered pairs between two tiles of groups (within one, each pair once) for one block of terms."""
    key = (left if left.num_rows else right)
    lang, same = (key.column("lang")[0].as_py(), key.column("i")[0].as_py() == key.column("j")[0].as_py()) if key.num_rows else ("", False)
    rows = []
    ours, theirs = _sides(left), _sides(right)
    for name, one, kept in ours:
        for other, two, _ in theirs:
            if not same or name < other:
                a, b = sorted((name, other))
                rows.append((lang, a, b, *pair_price(one, two), abs(one[2] - two[2]), kept))
    kinds = [pa.string()] * 3 + [pa.int64()] * 4
    columns = zip(*rows) if rows else [[]] * 7
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in PARTS.split(", ")])


def exact(column: str, whole: str) -> Column:
    return F.expr(f"1 + (cast({column} + {EXTRA} as decimal(22,0)) * cast({SCALE} as decimal(10,0))) div cast({whole} as decimal(22,0))")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, first_terms: int = 50,
               tile: int = 32, block_bits: int = 16, most_entries: int = 1_000_000, most_sizes: int = 100_000) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group (language, source) of the table.

    Part ``pair``: the other sources of the language by the sum of price differences over all terms
    that the language keeps. Part ``term``: the first terms that the group uses more than its
    language. Nulls count as empty strings; a group without terms has all counts zero. An empty
    table gives no row.
    """
    counts = stored(term_counts(docs, text, lang, source, most_entries), "term-counts")
    groups = stored(docs.select(named(lang).alias("lang"), named(source).alias("source")).distinct(), "term-groups")
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
                  .select("lang", "term", "total", F.monotonically_increasing_id().alias("id")), "term-numbers")
    held = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "id", "n", "total"), "kept-counts")
    by_lang = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(
        kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n")), "lang", "left")
    sizes = stored(groups.join(held.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(by_lang, "lang").select(
        "lang", "source", F.coalesce("n", F.lit(0)).alias("group_n"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"),
        "groups"), "group-sizes")
    small = F.broadcast(sizes) if sizes.count() <= most_sizes else sizes

    rated = held.join(small, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), exact("n", f"group_n + {EXTRA} * kept").alias("p"), exact("total", f"lang_n + {EXTRA} * kept").alias("q"))
    terms = rated.filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first_terms)

    # a group meets the others in every block of its language, also where it has no term; one without terms lets all groups meet
    block = F.shiftright("id", block_bits).alias("block")
    every = held.select("lang", block).distinct().unionByName(groups.select("lang", F.lit(-1).cast("long").alias("block")).distinct())
    absent = groups.join(every, "lang").select("lang", "source", "block", F.expr("cast(null as struct<id:bigint,n:bigint>)").alias("term"))
    blocks = (held.select("lang", "source", block, F.struct("id", "n").alias("term")).unionByName(absent)
              .groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list("term")).alias("terms")))
    tiles = F.ceil(F.col("groups") / tile).cast("int")
    sided = stored(blocks.join(small, ["lang", "source"]).select("lang", "source", "block", "terms", F.col("group_n").alias("n"), "kept", tiles.alias("tiles"),
                                                          F.pmod(F.xxhash64("source"), F.ceil(F.col("groups") / tile)).cast("int").alias("tile")), "group-blocks")
    keys = ["lang", "block", "i", "j"]
    left = sided.select("*", F.col("tile").alias("i"), F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("j"))
    right = sided.toDF(*sided.columns).select("*", F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("i"), F.col("tile").alias("j"))
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(merge_tiles, PARTS)
    prices = parts.groupBy("lang", "a", "b").agg(
        (F.sum("part") + (F.max("kept") - F.sum("present")) * F.max("rest")).alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e")
    pairs = prices.select("lang", ends, "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)
