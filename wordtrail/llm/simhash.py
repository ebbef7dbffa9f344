"""Near-duplicates by SimHash: fingerprints, and their self-join over a binary trie."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtrail.llm.common import stored

BITS = 64


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """The majority bits of the hashes of all word shingles, repeats included.

    Fewer words than a shingle make one shingle of all of them; no word at all gives zero.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[:len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1:].tolist())),
                         np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        piece = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4) -> DataFrame:
    """``key`` and ``fingerprint`` (long, the 64 bits as a signed number); a null text counts as empty."""
    def score(batches):
        for batch in batches:
            values = [fingerprint(t or "", words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], names=[key, "fingerprint"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(score, f"`{key}` {kind}, fingerprint long")


# ---- the trie self-join inside one task

def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First index within [lo, hi) whose value has the bit set; values are sorted and share all higher bits."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        ones = (values[np.minimum(mid, len(values) - 1)] >> bit) & np.uint64(1) == 1
        hi = np.where(open_ & ones, mid, hi)
        lo = np.where(open_ & ~ones, mid + 1, lo)


class _Forest:
    """Union-find over positions with whole-array root look-up."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            roots = self.roots()
            ra, rb = roots[a], roots[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def trie_links(values: np.ndarray, groups: np.ndarray, budget: int, leaf: int = 64,
               frontier: int = 1 << 17) -> np.ndarray:
    """For each value the position of the first value it is connected with.

    ``values`` (distinct within a group) are sorted by (group, value); two values of a group are
    linked when they differ in at most ``budget`` bits. A trie node is a stretch of the sorted
    array. Pairs of nodes are taken down together, one bit at a time; a pair carries the number
    of bits in which its two prefixes differ and is dropped beyond the budget. A pair of which
    all members are connected already is dropped as well: it can't change the components. Pairs
    of few members are compared value by value.
    """
    n = len(values)
    forest = _Forest(n)
    if n < 2:
        return forest.roots()
    # neighbours in sorted order first: dense groups become one component early
    near = (groups[1:] == groups[:-1]) & (np.bitwise_count(values[1:] ^ values[:-1]) <= budget)
    at = np.flatnonzero(near)
    forest.link(at, at + 1)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ends = np.r_[starts[1:], n]
    keep = ends - starts > 1
    s, e = starts[keep], ends[keep]
    stack = [(s, e, s, e, np.zeros(len(s), np.int8), np.full(len(s), BITS - 1, np.int8))]
    while stack:
        lo1, hi1, lo2, hi2, diff, bit = stack.pop()
        if len(lo1) > frontier:
            half = len(lo1) // 2
            stack.append(tuple(x[:half] for x in (lo1, hi1, lo2, hi2, diff, bit)))
            stack.append(tuple(x[half:] for x in (lo1, hi1, lo2, hi2, diff, bit)))
            continue
        roots = forest.roots()
        changes = np.r_[0, np.cumsum(roots[1:] != roots[:-1])]
        whole = (changes[hi1 - 1] == changes[lo1]) & (changes[hi2 - 1] == changes[lo2]) & (roots[lo1] == roots[lo2])
        open_ = ~whole
        lo1, hi1, lo2, hi2, diff, bit = (x[open_] for x in (lo1, hi1, lo2, hi2, diff, bit))
        if not len(lo1):
            continue
        n1, n2 = hi1 - lo1, hi2 - lo2
        small = (n1 * n2 <= leaf) | (bit < 0)
        if small.any():
            a1, a2, m1, m2 = lo1[small], lo2[small], n1[small], n2[small]
            size = m1 * m2
            pair = np.repeat(np.arange(len(size)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = a1[pair] + k // m2[pair], a2[pair] + k % m2[pair]
            hit = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            forest.link(i[hit], j[hit])
        rest = ~small
        lo1, hi1, lo2, hi2, diff, bit = (x[rest] for x in (lo1, hi1, lo2, hi2, diff, bit))
        if not len(lo1):
            continue
        shift = bit.astype(np.uint64)
        mid1, mid2 = _split(values, lo1, hi1, shift), _split(values, lo2, hi2, shift)
        same = lo1 == lo2
        below = bit - np.int8(1)
        parts = [(lo1, mid1, lo2, mid2, diff, below, None), (mid1, hi1, mid2, hi2, diff, below, None),
                 (lo1, mid1, mid2, hi2, diff + np.int8(1), below, None),
                 (mid1, hi1, lo2, mid2, diff + np.int8(1), below, same)]  # of a node with itself one mixed pair is enough
        made = []
        for a, b, c, d, dist, bits, skip in parts:
            ok = (a < b) & (c < d) & (dist <= budget)
            if skip is not None:
                ok &= ~skip
            made.append((a[ok], b[ok], c[ok], d[ok], dist[ok], bits[ok]))
        stack.append(tuple(np.concatenate(x) for x in zip(*made)))
    return forest.roots()


# ---- the join over the cluster

def _blocks(budget: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of budget + 1 blocks: two fingerprints within the budget agree on one of them."""
    cuts = np.linspace(0, BITS, budget + 2).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:])]


def links(prints: DataFrame, budget: int = 4, task_rows: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` that connect distinct fingerprints of at most ``budget`` differing bits.

    ``prints`` has one column ``fingerprint``, distinct. Edges form stars, one a group and
    component, not all pairs; the components are those of all pairs. Each fingerprint goes to
    budget + 1 groups, one a block of bits, as two linked ones agree on a block; a trie self-join
    runs in each group. A group of more than ``task_rows`` fingerprints is cut into pieces, and
    each pair of pieces is a task of its own, so that no task outgrows the others.
    """
    spark = prints.sparkSession
    blocks = F.array(*[F.struct(F.lit(i).alias("block"),
                                F.shiftrightunsigned("fingerprint", low).bitwiseAND(F.lit((1 << width) - 1)).alias("value"))
                       for i, (low, width) in enumerate(_blocks(budget))])
    rows = prints.select("fingerprint", F.explode(blocks).alias("g")).select("fingerprint", "g.block", "g.value")
    sizes = rows.groupBy("block", "value").agg(F.count("*").alias("n"))
    if task_rows is None:
        total = prints.count() * (budget + 1)
        task_rows = max(512, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # at most total / task_rows groups are that large
    big = sizes.filter(F.col("n") > task_rows).select("block", "value", F.ceil(F.col("n") / (task_rows / 2)).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("fingerprint"), F.col("pieces")).cast("int")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("pieces") - 1), lambda x: x != F.col("piece")))
    small = rows.join(F.broadcast(big), ["block", "value"], "left_anti").select(
        "fingerprint", "block", "value", F.lit(0).alias("i"), F.lit(0).alias("j"))
    cut = (rows.join(F.broadcast(big), ["block", "value"]).withColumn("piece", piece).withColumn("other", other)
           .select("fingerprint", "block", "value", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j")))
    tasks = small.unionByName(cut).select(F.xxhash64("block", "value", "i", "j").alias("task"), "block", "fingerprint")

    def join(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        task = table.column("task").to_numpy()
        value = table.column("fingerprint").to_numpy().view(np.uint64)
        order = np.lexsort((value, task))
        task, value = task[order], value[order]
        first = trie_links(value, task, budget)
        moved = np.flatnonzero(first != np.arange(len(first)))
        yield pa.RecordBatch.from_arrays([pa.array(value[moved].view(np.int64)), pa.array(value[first[moved]].view(np.int64))], names=["a", "b"])

    return tasks.repartition("task").select("task", "fingerprint").mapInArrow(join, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; the root is the component's smallest node.

    Alternates two steps till nothing changes: every node ties its larger neighbours to the
    smallest of its neighbourhood, then ties its smaller neighbours there. The edges of each
    round are written below the shared folder; only a count comes to the driver.
    """
    def step(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs if not larger else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("node"), F.least("a", "least").alias("least"))
        tied = both.join(least, both.a == least.node).filter("b > a" if larger else "true")
        out = tied.select(F.col("b").alias("a"), F.col("least").alias("b"))
        if not larger:
            out = out.unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
        return out.filter("a <> b").distinct()

    turned = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(turned, "links")
    before = None
    for _ in range(rounds):
        # the large step on (a > b) pairs seen from both ends, then the small step
        now = stored(step(step(now, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), False), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct())


def _named(rooted: DataFrame, share: int = 10_000) -> DataFrame:
    """``fingerprint, component_id`` from ``fingerprint, least, root``: the smallest ``least`` of the root's fingerprints.

    Components of over one in ``share`` of all linked fingerprints (and a thousand), so at most
    ``share`` of them, meet their name by a broadcast: no task gets all members of one.
    """
    linked = rooted.filter("root IS NOT NULL")
    sizes = stored(linked.groupBy("root").agg(F.count("*").alias("n"), F.min("least").alias("component_id")), "component-names")
    bound = max(1000, linked.count() // share)
    large = F.broadcast(sizes.filter(F.col("n") > bound).select("root", "component_id"))
    small = linked.join(large.select("root"), "root", "left_anti").join(sizes.filter(F.col("n") <= bound), "root")
    return (rooted.filter("root IS NULL").select("fingerprint", F.col("least").alias("component_id"))
            .unionByName(linked.join(large, "root").select("fingerprint", "component_id"))
            .unionByName(small.select("fingerprint", "component_id")))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, budget: int = 4) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key that links reach.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay
    repeated; a null key never becomes a component's name unless all keys of the component are null.
    Texts with equal fingerprints meet once in the trie; their rows are not paired.
    """
    prints = stored(fingerprints(docs, text, key, words), "fingerprints")
    groups = stored(prints.groupBy("fingerprint").agg(F.min(key).alias("least")), "distinct-fingerprints")
    roots = components(stored(links(groups.select("fingerprint"), budget), "trie-links"))
    # only linked fingerprints have a root
    rooted = stored(groups.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"), "rooted-fingerprints")
    return prints.join(_named(rooted), "fingerprint").select(
        key, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, budget: int = 4) -> DataFrame:
    """The documents whose key is their component's smallest; columns as they came.

    Rows of one key stay or go together; rows without a key stay.
    """
    found = near_duplicates(docs, text, key, words, budget)
    dropped = found.filter(F.col(key) != F.col("component_id")).select(key).distinct()
    return docs.join(dropped, key, "left_anti").select(docs.columns)
