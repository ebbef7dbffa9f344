"""Repeated byte strings found by a hash-compared suffix sort, spread over the cluster.

A string of ``length`` bytes is a window. Of the short strings (``anchor`` bytes) inside a window,
the one of the smallest hash is its anchor; equal windows have equal anchors at equal places, so
only windows of one anchor have to be sorted together. Consecutive windows of one anchor make a
run, which travels as one stretch of text, and only if its anchor occurs elsewhere too. In a task
the suffixes that start the windows are sorted by a mergesort whose comparisons find the common
extension of two suffixes by binary search over prefix polynomial hashes. Suffixes that the hashes
call equal are compared byte by byte.

Texts are packed into units of a few megabytes, stored once in buckets by unit; what tasks find
out is sent back to the units, so that the texts themselves never move again.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtrail.llm.common import settings, stored
from wordtrail.llm.interpolation import pack, rows_of, unpack
from wordtrail.session import shared_path

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
WHOLE = {"tinyint", "smallint", "int", "bigint"}
UNIT = "unit long, keys array<long>, sizes binary, texts binary"
ONCE, SOME, MANY = 0, 1, 2
PIECE = "range int, unit long, keys binary, docs binary, texts_of binary, starts binary, sizes binary, offsets binary, bytes binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a polynomial hash, whose low bits are weak."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse."""
    both = np.full((2, n + 1), BASE, np.uint64)
    both[1], both[:, 0] = INVERSE, 1
    np.multiply.accumulate(both, axis=1, out=both)
    return both[0], both[1]


class PrefixHashes:
    """Polynomial hashes of all prefixes of a text, modulo 2^64; any stretch's hash takes two look-ups."""

    def __init__(self, text: np.ndarray):
        self.text = text
        up, self.back = powers(1 << max(len(text).bit_length(), 16))
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:len(text)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Hashes of all stretches of one length."""
        n = max(len(self.text) - length + 1, 0)
        return (self.sums[length:length + n] - self.sums[:n]) * self.back[:n]

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]

    def common(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Length of the common extension of the suffixes at ``a`` and ``b``, up to ``limit`` bytes, by binary search."""
        low = np.full(len(a), limit, np.int64)
        open_ = np.flatnonzero(self.of(a, limit) != self.of(b, limit))  # most are equal over the whole length
        lo, hi = np.zeros(len(open_), np.int64), np.full(len(open_), limit, np.int64)
        a, b = a[open_], b[open_]
        while len(lo) and (hi - lo > 1).any():
            mid = (lo + hi) >> 1
            same = self.of(a, mid) == self.of(b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid)
        low[open_] = lo
        return low

    def less(self, a: np.ndarray, b: np.ndarray, limit: int, or_equal) -> np.ndarray:
        """Whether the suffix at ``a`` sorts before the one at ``b`` by its first ``limit`` bytes."""
        n = self.common(a, b, limit)
        at = np.minimum(n, limit - 1)  # hashes that agree though the bytes don't only cost order, which the byte check mends
        before = self.text[a + at] < self.text[b + at]
        return np.where(n >= limit, or_equal, before)


def suffix_order(hashes: PrefixHashes, starts: np.ndarray, groups: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes at ``starts`` by their first ``limit`` bytes within each group (groups are sorted); stable.

    A mergesort from runs of one upward. All merges of a round go on side by side: a suffix's place
    in the merged run is its place in its own run and its rank in the other, by binary search.
    """
    order = np.arange(len(starts))
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    end = np.r_[first[1:], len(groups)]
    width = 1
    while len(first):
        # pairs of runs: [left, middle) and [middle, right)
        long = end - first > width
        first, end = first[long], end[long]
        k, of = expanded(np.zeros(len(first), np.int64), (end - first - width - 1) // (2 * width))
        left = first[of] + k * 2 * width
        middle, right = left + width, np.minimum(left + 2 * width, end[of])
        turned = hashes.less(starts[order[middle]], starts[order[middle - 1]], limit, False)
        left, middle, right = left[turned], middle[turned], right[turned]  # the others are in order as they stand
        place, pair = expanded(left, right - 1)
        own, is_left = starts[order[place]], place < middle[pair]
        lo = np.where(is_left, middle[pair], left[pair])
        hi, other = np.where(is_left, right[pair], middle[pair]), lo.copy()
        while True:
            todo = np.flatnonzero(lo < hi)
            if not len(todo):
                break
            mid = (lo[todo] + hi[todo]) >> 1
            # of equal suffixes those of the left run come first
            below = hashes.less(starts[order[mid]], own[todo], limit, ~is_left[todo])
            lo[todo] = np.where(below, mid + 1, lo[todo])
            hi[todo] = np.where(below, hi[todo], mid)
        to = left[pair] + (place - np.where(is_left, left[pair], middle[pair])) + (lo - other)
        merged = order.copy()
        merged[to] = order[place]
        order, width = merged, width * 2
    return order


def repeated(text: np.ndarray, starts: np.ndarray, groups: np.ndarray, limit: int) -> np.ndarray:
    """Which windows equal one of their group that comes earlier as they are given.

    Windows are sorted by group, within it from the earliest to the latest. Windows of equal hashes
    are compared with the first of them byte by byte; those whose hash lies, with each other.
    """
    out = np.zeros(len(starts), bool)
    if not len(starts):
        return out
    hashes = PrefixHashes(text)
    order = suffix_order(hashes, starts, groups, limit)  # stable: of equal windows the earliest is first
    sorted_starts, sorted_groups = starts[order], groups[order]
    key = hashes.of(sorted_starts, limit)
    new = np.r_[True, (key[1:] != key[:-1]) | (sorted_groups[1:] != sorted_groups[:-1])]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = np.flatnonzero(~new)
    windows = np.lib.stride_tricks.sliding_window_view(text, limit)
    lies = []
    for at in range(0, len(later), 1 << 16):  # a bounded piece at a time
        part = later[at:at + (1 << 16)]
        same = (windows[sorted_starts[part]] == windows[sorted_starts[head[part]]]).all(axis=1)
        out[order[part[same]]] = True
        lies.extend(part[~same].tolist())
    seen: dict[tuple[int, bytes], bool] = {}
    for at in lies:  # collisions: as good as none
        name = (int(head[at]), windows[sorted_starts[at]].tobytes())
        out[order[at]] = name in seen
        seen[name] = True
    return out


# ---- units

def units(docs: DataFrame, text: str, key: str, unit_bytes: int) -> DataFrame:
    """One row for some megabytes of consecutive texts; a longer text makes a longer unit."""
    def build(batches):
        from pyspark import TaskContext

        task, number, keys, texts, total = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            data = [(task << 24) + number, keys, pack(np.array([len(t) for t in texts], np.int64)),
                    zstandard.ZstdCompressor(level=1).compress(b"".join(texts))]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(data, kinds)], names=[c.split()[0] for c in UNIT.split(", ")])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (t or "").encode("utf-8", "surrogatepass")
                keys.append(k), texts.append(data)
                total += len(data)
                if total >= unit_bytes:
                    yield row()
                    keys, texts, total, number = [], [], 0, number + 1
        if keys:
            yield row()

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(build, UNIT)


class Unit:
    """A unit's windows as runs: windows ``first`` to ``last`` have their anchor at ``anchor``; ``key`` is its hash."""

    def __init__(self, row: dict, length: int, anchor: int):
        self.number, self.keys, self.length = row["unit"], row["keys"], length
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"]), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.anchor_bytes = anchor

    def find_runs(self) -> None:
        n = max(len(self.text) - self.length + 1, 0)
        if not n:
            self.first = self.last = self.anchors = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        hashes = mixed(PrefixHashes(self.text).every(self.anchor_bytes))
        bits = np.uint64(len(self.text).bit_length())
        least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)  # leftmost of equal ones
        span, width = self.length - self.anchor_bytes + 1, 1
        while width * 2 <= span:  # smallest of 2, 4, 8, ... places
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
        at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        ends = self.starts + self.sizes - self.length + 1  # past the last window of each text
        some = ends > self.starts
        inside = np.zeros(n + 1, np.int8)
        np.add.at(inside, self.starts[some], 1)
        np.add.at(inside, ends[some], -1)
        inside = np.cumsum(inside, dtype=np.int8)[:n] > 0
        starts_text = np.zeros(n, bool)
        starts_text[self.starts[some]] = True
        new = inside & (np.r_[True, at[1:] != at[:-1]] | starts_text | ~np.r_[False, inside[:-1]])
        stop = inside & ~np.r_[inside[1:] & ~new[1:], False]
        self.first, self.last = np.flatnonzero(new), np.flatnonzero(stop)
        self.anchors = at[self.first]
        self.key = mixed(hashes[self.anchors] + BASE)  # the smallest of many hashes are small: spread them anew

    def window_keys(self) -> np.ndarray:
        return mixed(PrefixHashes(self.text).every(self.length))

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        filled = np.flatnonzero(self.sizes > 0)
        return filled[np.searchsorted(self.starts[filled], at, "right") - 1]

    def keys_of(self, docs: np.ndarray) -> np.ndarray:
        """Keys of texts; a text without one comes before all others."""
        keys = np.array([np.iinfo(np.int64).min if k is None else k for k in self.keys], np.int64)
        return keys[docs]


def spread(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges, by the highest bits, in sorted 64-bit keys: number, first and end."""
    part = (values >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    return part[first], first, np.r_[first[1:], len(part)] if len(part) else first


def expanded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the stretches, ends included, and each place's stretch."""
    n = last - first + 1
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of], of


def asked(rows: DataFrame, make, bits: int) -> DataFrame:
    """Distinct keys of each unit, with how often it holds them, by range."""
    def send(batches):
        for batch in batches:
            for row in rows_of(batch):
                keys, counts = np.unique(make(row), return_counts=True)
                parts, first, end = spread(keys, bits)
                if len(parts):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(parts), row["unit"])), pa.array(parts, pa.int32()),
                        pa.array([keys[a:b].tobytes() for a, b in zip(first, end)], pa.binary()),
                        pa.array([pack(counts[a:b]) for a, b in zip(first, end)], pa.binary())], names=["unit", "range", "keys", "counts"])

    return rows.mapInArrow(send, "unit long, range int, keys binary, counts binary")


def told(sent: DataFrame, many: int, name: str) -> DataFrame:
    """For each key that a unit sent: ONCE, SOME or MANY (over ``many`` places in all)."""
    def reply(held: list[dict]) -> pa.RecordBatch:
        keys = [np.frombuffer(r["keys"], np.uint64) for r in held]
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        total, places = np.zeros(len(unique), np.int64), np.split(at, np.cumsum([len(k) for k in keys])[:-1])
        for r, place in zip(held, places):  # keys are distinct within one sender
            total[place] += unpack(r["counts"]).astype(np.int64)
        kind = np.where(total <= 1, ONCE, np.where(total <= many, SOME, MANY))
        return pa.RecordBatch.from_arrays([
            pa.array([r["unit"] for r in held], pa.int64()), pa.array([r["range"] for r in held], pa.int32()),
            pa.array([pack(kind[p]) for p in places], pa.binary())], names=["unit", "range", "kinds"])

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for row in rows_of(batch):
                if held and held[0]["range"] != row["range"]:
                    yield reply(held)
                    held = []
                held.append(row)
        if held:
            yield reply(held)

    return stored(sent.repartition("range").sortWithinPartitions("range").mapInArrow(run, "unit long, range int, kinds binary"), name)


def lists(replies: DataFrame, name: str, *columns: str) -> DataFrame:
    return replies.groupBy("unit").agg(F.collect_list(F.struct(*columns)).alias(name))


def kinds_of(answers: list[dict] | None, keys: np.ndarray) -> np.ndarray:
    """The kind of each key, from the answers for the distinct ones."""
    unique, at = np.unique(keys, return_inverse=True)
    told_ = [unpack(a["kinds"]) for a in sorted(answers or [], key=lambda a: a["range"])]
    return (np.concatenate(told_) if told_ else np.zeros(0, np.uint8))[at] if len(unique) else np.zeros(0, np.uint8)


def hot_windows(unit: Unit, kinds: np.ndarray) -> np.ndarray:
    at, _ = expanded(unit.first[kinds == MANY], unit.last[kinds == MANY])
    return at


def pieces(rows: DataFrame, length: int, anchor: int, bits: int) -> DataFrame:
    """The stretches of text that have to be sorted, by range of their key.

    A run with an anchor of SOME places goes whole. The windows of anchors of MANY places go one by
    one, each different one once a unit, under their own hash, and only if it occurs elsewhere.
    """
    types = [pa.int32(), pa.int64()] + [pa.binary()] * 7

    def known(unit, at):
        """Windows that repeat an earlier one of their own unit: nothing is left to sort."""
        if len(at):
            docs = unit.doc_of(at)
            values = [int(unit.number % (1 << bits)), unit.number, None, pack(docs), None, pack(at - unit.starts[docs]), None, None, None]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[c.split()[0] for c in PIECE.split(", ")])

    def send(batches):
        for batch in batches:
            for row in rows_of(batch):
                unit = Unit(row, length, anchor)
                unit.find_runs()
                kinds = kinds_of(row["anchors"], unit.key)
                some = kinds == SOME
                key, first, last, offset = unit.key[some], unit.first[some], unit.last[some], (unit.anchors - unit.first)[some]
                at = hot_windows(unit, kinds)
                if len(at):
                    keys = unit.window_keys()[at]
                    at, keys = at[(again := kinds_of(row["windows"], keys) > ONCE)], keys[again]
                    once = ~hot_repeats(unit, at, keys)
                    again_at, at, keys = at[~once], at[once], keys[once]
                    key, first, last, offset = (np.concatenate(x) for x in ((key, keys), (first, at), (last, at), (offset, np.full(len(at), length))))
                    yield from known(unit, again_at)
                order = np.lexsort((first, key))
                key, first, last, offset = key[order], first[order], last[order], offset[order]
                parts, begin, end = spread(key, bits)
                docs = unit.doc_of(first)
                out = {c.split()[0]: [] for c in PIECE.split(", ")}
                for part, a, b in zip(parts, begin, end):
                    s = slice(a, b)
                    places, _ = expanded(first[s], last[s] + length - 1)
                    values = [part, unit.number, key[s].tobytes(), pack(docs[s]), unit.keys_of(docs[s]).tobytes(), pack(first[s] - unit.starts[docs[s]]),
                              pack(last[s] - first[s] + 1), pack(offset[s]), zstandard.ZstdCompressor(level=1).compress(unit.text[places].tobytes())]
                    for c, v in zip(out, values):
                        out[c].append(v)
                if len(parts):
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return rows.mapInArrow(send, PIECE)


def hot_repeats(unit: Unit, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which windows of frequent anchors equal an earlier one of the same unit."""
    docs = unit.doc_of(at)
    order = np.lexsort((at, docs, unit.keys_of(docs), keys))
    out = np.zeros(len(at), bool)
    out[order] = repeated(unit.text, at[order], keys[order], unit.length)
    return out


def found(sent: DataFrame, length: int, most_windows: int = 1 << 18) -> DataFrame:
    """Stretches of windows that equal an earlier one: for each unit the text's number, first and last byte."""
    def solve(held: list[dict]) -> pa.RecordBatch | None:
        out = [np.zeros((4, 0), np.int64)]
        for r in (r for r in held if r["keys"] is None):
            at = unpack(r["starts"]).astype(np.int64)
            out.append(np.stack([np.full(len(at), r["unit"], np.int64), unpack(r["docs"]).astype(np.int64), at, at + length]))
        held = [r for r in held if r["keys"] is not None]
        if held:
            out.extend(sort_pieces(held))
        rows = np.concatenate(out, axis=1)
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        if not rows.shape[1]:
            return None
        first = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        end = np.r_[first[1:], rows.shape[1]]
        return pa.RecordBatch.from_arrays([pa.array(rows[0][first]), *[pa.array([pack(rows[i][x:y]) for x, y in zip(first, end)], pa.binary()) for i in (1, 2, 3)]],
                                          names=["unit", "docs", "firsts", "ends"])

    def sort_pieces(held: list[dict]):
        sizes = [unpack(r["sizes"]).astype(np.int64) for r in held]
        n = [len(s) for s in sizes]
        join = lambda f: np.concatenate([f(r) for r in held])
        key, doc_key = join(lambda r: np.frombuffer(r["keys"], np.uint64)), join(lambda r: np.frombuffer(r["texts_of"], np.int64))
        doc, start, offset = (join(lambda r, c=c: unpack(r[c]).astype(np.int64)) for c in ("docs", "starts", "offsets"))
        size, unit = np.concatenate(sizes), np.repeat(np.array([r["unit"] for r in held], np.int64), n)
        text = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["bytes"]) for r in held), np.uint8)
        begin = np.cumsum(size + length - 1) - (size + length - 1)
        by_key = np.argsort(key, kind="stable")
        cuts = np.r_[np.flatnonzero(np.r_[True, key[by_key][1:] != key[by_key][:-1]]), len(by_key)]
        before = np.r_[0, np.cumsum(size[by_key])][cuts]  # windows before each key
        at = 0
        while at < len(cuts) - 1:  # a bounded number of windows at a time, whole keys
            to = max(int(np.searchsorted(before, before[at] + most_windows, "right")) - 1, at + 1)
            mine = by_key[cuts[at]:cuts[to]]
            at = to
            places, of = expanded(begin[mine], begin[mine] + size[mine] + length - 2)
            part = text[places]
            moved = np.zeros(len(key), np.int64)
            moved[mine] = np.cumsum(size[mine] + length - 1) - (size[mine] + length - 1)
            j, of = expanded(np.zeros(len(mine), np.int64), size[mine] - 1)
            run = mine[of]
            away, place = offset[run] - j, start[run] + j
            # windows of one key can be equal only at the same distance from the anchor
            order = np.lexsort((place, doc[run], unit[run], doc_key[run], away, key[run]))
            k, d = key[run][order], away[order]
            group = np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
            again = repeated(part, (moved[run] + j)[order], group, length)
            hit = np.zeros(len(run), bool)
            hit[order] = again
            # consecutive windows of a run make one stretch
            first = np.flatnonzero(hit & ~np.r_[False, hit[:-1] & (run[1:] == run[:-1])])
            last = np.flatnonzero(hit & ~np.r_[hit[1:] & (run[1:] == run[:-1]), False])
            yield np.stack([unit[run[first]], doc[run[first]], place[first], place[last] + length])

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for row in rows_of(batch):
                if held and held[0]["range"] != row["range"]:
                    if (done := solve(held)) is not None:
                        yield done
                    held = []
                held.append(row)
        if held and (done := solve(held)) is not None:
            yield done

    return stored(sent.repartition("range").sortWithinPartitions("range").mapInArrow(run, "unit long, docs binary, firsts binary, ends binary"), "repeats")


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 100, anchor: int = 32, unit_bytes: int = 2 << 20,
            range_bytes: int = 16 << 20, most_places: int = 1024, with_text: bool = False) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` for every row; with ``with_text`` also ``spans`` and ``kept`` (binary).

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a row of
    a smaller key, or further left in the same row. Overlapping strings count; all are judged on the
    texts as they came. A null text is empty. Rows without a key come before all others; rows of one
    key are ordered by their place in the table as it is read. The key has to be a whole number.
    A string of ``anchor`` bytes met in over ``most_places`` places has its windows dealt out by
    their own hash, so that no passage, however common, meets in one task.
    """
    if dict(docs.dtypes)[key] not in WHOLE:
        raise TypeError(f"{key} is {dict(docs.dtypes)[key]}: whole numbers are needed, as they say which row is earlier")
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"repeat_units_{uuid.uuid4().hex}"
    (units(docs, text, key, unit_bytes).write.bucketBy(partitions, "unit")
     .option("path", shared_path(spark, "repeat-units")).saveAsTable(name))  # buckets: texts never move again

    def anchor_keys(row: dict) -> np.ndarray:
        unit = Unit(row, length, anchor)
        unit.find_runs()
        return unit.key

    def frequent_windows(row: dict) -> np.ndarray:
        if not any((unpack(a["kinds"]) == MANY).any() for a in row["anchors"] or []):
            return np.zeros(0, np.uint64)
        unit = Unit(row, length, anchor)
        unit.find_runs()
        at = hot_windows(unit, kinds_of(row["anchors"], unit.key))
        return unit.window_keys()[at] if len(at) else np.zeros(0, np.uint64)

    def finish(batches):
        for batch in batches:
            for row in rows_of(batch):
                unit = Unit(row, length, anchor)
                change = np.zeros(len(unit.text) + 1, np.int32)

                for r in row["found"] or []:
                    base = unit.starts[unpack(r["docs"]).astype(np.int64)]
                    np.add.at(change, base + unpack(r["firsts"]).astype(np.int64), 1)
                    np.add.at(change, base + unpack(r["ends"]).astype(np.int64), -1)
                gone = np.cumsum(change[:-1]) > 0
                out: list[tuple] = []
                for k, a, n in zip(unit.keys, unit.starts.tolist(), unit.sizes.tolist()):
                    mask, own = gone[a:a + n], unit.text[a:a + n]
                    kept = own[~mask].tobytes()
                    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
                    record = (k, n, n - len(kept), len(edges) // 2, hashlib.sha256(kept).hexdigest())
                    out.append((*record, edges.reshape(-1, 2).tolist(), kept) if with_text else record)
                types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * with_text
    schema = f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<long>>, kept binary" * with_text
    try:
        with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="4"):  # a row is a unit, or a unit's share of a range
            table = spark.table(name)
            bits = max(2, (table.count() * unit_bytes // range_bytes).bit_length())
            rows = table.join(lists(told(asked(table, anchor_keys, bits), most_places, "anchor-kinds"), "anchors", "range", "kinds"), "unit", "left")
            windows = told(asked(rows, frequent_windows, bits), 1 << 62, "window-kinds")
            rows = rows.join(lists(windows, "windows", "range", "kinds"), "unit", "left")
            ranges = found(pieces(rows, length, anchor, bits), length)
            rows = table.join(lists(ranges, "found", "docs", "firsts", "ends"), "unit", "left")
            result = stored(rows.mapInArrow(finish, schema), "repeats-by-row")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return result
