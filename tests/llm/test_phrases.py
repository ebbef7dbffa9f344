"""Phrase collocations against a brute-force count, and the automata against plain dictionaries."""

import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest

from wordtrail.llm import phrases
from wordtrail.llm.phrases import Trie
from wordtrail.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, phrase string, n int"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least=30, first=2000, share=80):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = defaultdict(int)
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    covered[p[i:i + n]] = max(covered[p[i:i + n]], a)
        best = []
        for p, a in found.items():
            if 100 * covered[p] < 80 * a or not covered[p]:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def random_rows(seed, n=400):
    r = random.Random(seed)
    words = ["the", "of", "New", "york", "CITY", "Ünder", "x\x1cy", "日本", "a"] + [f"w{i}" for i in range(40)]
    rows = [(None, "en"), ("", "en"), ("  \t ", None), (". . !!", "de"), ("one" * 20_000, "en")]
    for _ in range(n):
        text = "".join(r.choice(words) + r.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "\x0b", "; ", "?!"]) for _ in range(r.randint(0, 60)))
        rows.append((text + ("new york city hall " * 2 if r.random() < 0.3 else ""), r.choice(["en", "en", "de", None, "und"])))
    return rows + [("a b " * 20_000, "long")] + rows[-20:]


@pytest.mark.parametrize("how", [{}, {"range_bytes": 500, "shard_tokens": 700}])
def test_equals_brute_force(spark, how):
    rows = random_rows(1)
    docs = spark.createDataFrame([(i, t, lang, "x", 1) for i, (t, lang) in enumerate(rows)], DOCS).repartition(3)
    assert sorted(tuple(r) for r in phrases.collocations(docs, **how).collect()) == brute(rows)


def test_first_few_of_a_language(spark):
    rows = random_rows(2)
    docs = spark.createDataFrame([(i, t, lang, "x", 1) for i, (t, lang) in enumerate(rows)], DOCS)
    assert sorted(tuple(r) for r in phrases.collocations(docs, first=7).collect()) == brute(rows, first=7)


def test_empty_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "x", 1)], DOCS)).count() == 0


def random_trie(r, n=200):
    words = sorted({bytes([97 + r.randrange(26), 97 + r.randrange(2)]) for _ in range(12)})
    tokens = np.array([r.randrange(-1, len(words)) for _ in range(n)], np.int64)
    tokens[:len(words)] = np.arange(len(words))
    return Trie.of_tokens(tokens, words, 4)


def members(trie):
    return {p: a for level in trie.phrases() for p, a in level if a}


def test_automata_keep_every_path_and_share_states():
    r = random.Random(3)
    for _ in range(30):
        trie = random_trie(r)
        again = Trie.of_automaton(trie.automaton())
        assert members(again) == members(trie)
    same = Trie.of_phrases([(a, b, c) for a in (b"a", b"b") for b in (b"x", b"y") for c in (b"1", b"2")], 4)
    transitions = sum(len(phrases.unpack(p)) for p in same.automaton()[2::4])
    assert transitions == 6  # two a level, all shared


def test_cuts_agree_with_sorted_phrases():
    r = random.Random(4)
    for _ in range(30):
        trie = random_trie(r)
        every = members(trie)
        some = list(every) + [(b"b",), (b"zz", b"a"), (b"ab", b"zz", b"a"), (b"a", b"b", b"c", b"d")]
        bounds = sorted(r.sample(some, 5))
        children = [trie.children(i) for i in range(4)]
        low, parts = [0] * 4, []
        for high in [trie.cut(b, children) for b in bounds] + [[len(x[1]) for x in trie.levels]]:
            part = trie.between(low, high)
            parts.append(members(Trie.of_automaton(part.automaton())) if part else {})
            low = high
        want = [{} for _ in parts]
        for p, a in every.items():
            want[bisect_right(bounds, p)][p] = a
        assert parts == want


def test_union_and_composition():
    r = random.Random(5)
    for _ in range(20):
        one, two = random_trie(r), random_trie(r)
        both = phrases.union([one, two])
        assert members(both) == Counter(members(one)) + Counter(members(two))
        few = r.sample(sorted(members(both)), 10) + [(b"zz", b"q")]
        got = phrases.composed(Trie.of_phrases(few, 4), both)
        assert members(got) == {p: a for p, a in members(both).items() if p in few}
        assert members(both.pruned(3)) == {p: a for p, a in members(both).items() if a >= 3}


def test_query_on_the_table(spark, folder):
    got = QUERIES["op12_phrases"](spark, folder)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
