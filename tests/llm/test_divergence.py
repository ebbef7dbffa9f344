"""Word-use prices against a brute-force version over dictionaries and Python's own whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from compare import connect, difference
from wordtrail.llm import divergence
from wordtrail.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, term string, n int, block int"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least=30):
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, own in sources.items():
        kept = [t for t, d in docs[lang].items() if d >= least]

        def prices(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: prices(counts[lang, s]) for s in own}
        q = prices(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, first in (("pair", pairs, None), ("term", terms, 50)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:first], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def random_rows(seed, sources=6, n=600):
    r = random.Random(seed)
    words = ["The", "of", "don't", "Ünder", "日本", "x\x7fy", "É"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(8)]
    rows = [("", "en", "none"), (None, None, None), ("123 456", "xx", "a"), ("few words", "xx", "b"), ("long" * 30_000, "en", "s1")]
    for _ in range(n):
        s = r.randrange(sources)
        rows.append((" ".join(r.choice(words[:20 + 10 * s]) for _ in range(r.randint(0, 40))), r.choice(["en", "en", "de", None]), f"s{s}" if s else None))
    return rows + rows[-30:]


@pytest.mark.parametrize("how", [{}, {"tile": 2, "block_bits": 3, "most_entries": 200, "most_sizes": 0}])
def test_equals_brute_force(spark, how):
    rows = random_rows(1)
    docs = spark.createDataFrame([(i, *r, "x", 1, 2) for i, r in enumerate(rows)], DOCS).repartition(3)
    assert sorted(tuple(r) for r in divergence.divergence(docs, **how).collect()) == brute(rows)


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_prices_are_exact():
    r = random.Random(2)
    for bits in (5, 20, 40, 52, 61):
        whole = r.getrandbits(bits) + (1 << bits)
        counts = [r.randrange(whole) for _ in range(50)] + [0, whole - 5]
        want = [1 + 1_000_000_000 * (c + 5) // whole for c in counts]
        assert divergence.price(np.array(counts, np.int64), whole).tolist() == want


def test_gallop_finds_what_binary_search_finds():
    rng = np.random.default_rng(3)
    for _ in range(300):
        short, long = (np.unique(rng.integers(0, 400, rng.integers(0, n))) for n in (30, 300))
        assert divergence.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


def test_query_and_sql(spark, folder):
    got = QUERIES["op11_divergence"](spark, folder)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert difference(got, connect(folder), SQL["op11_divergence"]) is None
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
