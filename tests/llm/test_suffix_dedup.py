"""Repeated byte strings against a brute-force version that keeps every string of the length in a dictionary."""

import hashlib
import random

import numpy as np
import pytest

from wordtrail.llm import suffix_dedup
from wordtrail.llm.queries import QUERIES

DOCS = "doc_id long, text string, unit long, keys string, n_bytes int"


def brute(rows, length=100):
    """Rows in table order; a missing key comes first, rows of one key by their place."""
    seen, out = set(), []
    for _, (key, text) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            window = data[at:at + length]
            if window in seen:
                gone[at:at + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(g and not (at and gone[at - 1]) for at, g in enumerate(gone))
        out.append((key, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made_rows(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéü") for _ in range(r.randint(1, 6))) for _ in range(300)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    common, rows = [some(40) for _ in range(4)], []
    for i in range(250):
        text = some(r.randint(0, 120))
        if r.random() < 0.5:
            text += " " + r.choice(common) + " " + some(20)
        if r.random() < 0.1 and rows:
            text = rows[-1][1]
        if r.random() < 0.1:
            text = text[:50] + common[0][10:150] + text[50:]
        rows.append((r.choice([i, 7, None]) if r.random() < 0.1 else i, text))
    return rows + [(1000, None), (1001, ""), (1002, "1 " * 400), (1003, "x" * 99), (1004, "x" * 100), (1005, "x" * 101),
                   (1006, "x" * 350), (1007, "1 " * 400), (1008, "long " * 40_000), (999, "日本語 " * 60)]


@pytest.mark.parametrize("most_places", [4096, 5])
def test_equals_brute_force(spark, most_places):
    rows = made_rows(most_places)
    docs = spark.createDataFrame([(k, t, 1, "k", 2) for k, t in rows], DOCS).coalesce(1)
    got = suffix_dedup.repeats(docs, unit_bytes=3000, range_bytes=20_000, most_places=most_places)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)


def test_spans_and_kept_text(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(300))
    docs = spark.createDataFrame([(1, text), (2, "before " + text[20:180] + " after")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.repeats(docs, with_text=True).collect()}
    assert got[2].spans == [[7, 167]] and bytes(got[2].kept) == b"before  after"
    assert got[2].n_removed == 160 and got[1].n_bytes == 300


def test_empty_and_other_keys(spark):
    assert suffix_dedup.repeats(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(TypeError):
        suffix_dedup.repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 300))
        text, groups, starts = rng.integers(97, 99, n + 12).astype(np.uint8), np.sort(rng.integers(0, 4, n)), rng.permutation(n)
        order = suffix_dedup.suffix_order(suffix_dedup.PrefixHashes(text), starts, groups, 12)
        assert list(order) == sorted(range(n), key=lambda i: (groups[i], text[starts[i]:starts[i] + 12].tobytes()))


def test_lying_hashes_are_found_out(monkeypatch):
    monkeypatch.setattr(suffix_dedup.PrefixHashes, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    text = np.frombuffer(b"abcabcabdabd", np.uint8)
    got = suffix_dedup.repeated(text, np.array([0, 3, 6, 9]), np.zeros(4, np.int64), 3)
    assert got.tolist() == [False, True, False, True]


def test_query_on_the_table(spark, folder):
    got = QUERIES["op13_suffix_dedup"](spark, folder)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)
