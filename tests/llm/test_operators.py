"""Each operator against a brute-force version on small tables with nulls, ties, repeats and clashing names."""

import collections
import hashlib
import math
import os
import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordtrail.llm import (bpe, decontaminate, exact_dedup, interpolation, licenses, pii, simhash, token_files, toxicity, warc)
from wordtrail.llm.queries import QUERIES, remainder, tokenizer
from wordtrail.session import shared_path

os.environ["TOKENIZERS_PARALLELISM"] = "false"
DOCS = "doc_id long, text string, digest string, key string, fingerprint int, task int"
ODD = ["", None, "   ", "a", "A", "word " * 3000, "x" * 20000, "don't I'LL 's 12 ½", "ΣΑΣ é́  b\x1cc\x85d", "a<|endoftext|>b <|startoftext|>",
       "a\n \nb  c", "日本 語. 한국어", "Same text of five words", "same TEXT of five words"]


def frame(spark, texts, start=0):
    rows = [(start + i, t, "d", "k", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(None, "no key at all", "d", "k", 1, 2)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()["text"]


def test_bpe_equals_library(spark, texts):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = frame(spark, ODD + texts[:60])
    got = {r.doc_id: r for r in bpe.encode_and_decode(docs, path, with_ids=True).collect()}
    for i, t in enumerate(ODD + texts[:60]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_and_decode(empty(spark), path).count() == 0


def test_bpe_of_single_characters():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    words = [f"a{chr(c)}b" for c in [*range(0x2000), *range(0x2000, 0xD800, 7), *range(0xE000, 0x20000, 61)]]
    theirs = [e.ids for e in library.encode_batch_fast(words, add_special_tokens=False)]
    own.learn({c for w in words for c in own.chunks(w)}, 1 << 30)
    assert [w for w, ids in zip(words, theirs) if own.encode(w) != ids] == []


def test_bpe_of_random_texts_with_marks():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library, own, r = Tokenizer.from_file(path), bpe.WordBpe(path), random.Random(7)
    marks = [chr(c) for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))]
    some = ["x\u0345\u1ac5", "x\u0301\u1dfa", "a\u093c\u0301"]
    for _ in range(20_000):
        letters = [r.choice(["a", "É", "ο", "Σ", "한", "x", " ", "1", "-", chr(r.randrange(0x20, 0x3000))]) for _ in range(r.randint(1, 6))]
        some.append("".join(c + "".join(r.choice(marks) for _ in range(r.choice([0, 0, 1, 2, 3]))) for c in letters))
    theirs = [e.ids for e in library.encode_batch_fast(some, add_special_tokens=False)]
    own.learn({c for t in some for c in own.chunks(t)}, 1 << 30)
    assert [t for t, ids in zip(some, theirs) if own.encode(t) != ids] == []


def test_chunks_encoded_apart_are_those_of_whole_texts(texts):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_files.CachedEncoder(path, 2000)
    assert own.direct
    r = random.Random(3)
    parts = ["the", "don't", "Über", "naïve", "x.", "end!!", "a&&&", "don.'t", "ß", "É.,", "½", "a1", "1.", ".", "...", "  ", "\t", "\n", "日本", "x²", "ǅ", "\xad", "a\u0301",
             "<|endoftext|>", "word$$$", "one.\nTwo!", "a\nb", "Über\nÉ.", "x\n\ny", "we'll.", "ÿ×÷", "%*", "A" * 300]
    made = ["".join(r.choice(parts) + r.choice([" ", " ", "", "  ", "\n "]) for _ in range(30)) for _ in range(400)] + texts[:100]
    for at in range(0, len(made), 50):
        some = made[at:at + 50]
        got = [np.frombuffer(b, own.dtype).tolist() for b in own.encode(some)]
        assert got == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    path, place = tokenizer("byte_bpe_50k.json"), shared_path(spark, "t")
    library = Tokenizer.from_file(path)
    own = (ODD + texts[:40])[::-1]
    docs = frame(spark, own).unionByName(frame(spark, own[:2])).repartition(5)
    manifest = token_files.write_tokens(docs, place, path, length=64, file_tokens=3000)
    got = token_files.read_tokens(manifest, place).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in docs.collect()], key=lambda k: -1 if k is None else k)
    start = 0
    by = dict(enumerate(own)) | {None: "no key at all"}
    for r in got:
        ids = np.array(library.encode(by[r.doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    file = manifest.filter("file LIKE 'part%' AND file NOT LIKE '%index%'").first()
    table = token_files.sequences(place, file.file)
    assert table.column("mask").combine_chunks().flatten().to_pylist().count(True) == file.n_units
    manifest = token_files.write_tokens(empty(spark), shared_path(spark, "t"), path)
    assert token_files.read_tokens(manifest, place).count() == 0


def brute_components(prints, budget):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= budget:
                root[find(b)] = find(a)
    return {p: find(p) for p in prints}


def brute_print(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, texts):
    own = ODD + texts + [t.replace(" the ", " a ", 1) for t in texts]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, own)).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(own)}
    groups = brute_components(set(prints.values()), 4)
    least = {}
    for i, p in sorted(prints.items(), reverse=True):
        least[groups[p]] = i
    for i, p in prints.items():
        assert got[i].fingerprint == f"{p:016x}" and got[i].component_id == least[groups[p]]
    kept = simhash.keep_one(frame(spark, own))
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted(set(least.values())) and kept.columns[2] == "digest"
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_names_of_large_and_small_components(spark):
    rows = [(i, 10_000 - i, 7 if i < 1500 else 8 if i < 1600 else None) for i in range(1700)]
    named = dict(simhash._named(spark.createDataFrame(rows, "fingerprint long, least long, root long")).collect())
    assert named == {f: 10_000 - 1499 if f < 1500 else 10_000 - 1599 if f < 1600 else least for f, least, _ in rows}


def test_trie_in_split_groups(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    near = {centre}
    for _ in range(700):
        near.add(rng.choice(sorted(near)[:50]) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    prints = sorted(near | {rng.getrandbits(64) for _ in range(300)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fingerprint long"), 4, task_rows=60)
    roots = {r.node % (1 << 64): r.root for r in simhash.components(edges).collect()}
    truth = brute_components(prints, 4)
    same = collections.defaultdict(set)
    for p in prints:
        same[truth[p]].add(roots.get(p, p - (1 << 64) if p >> 63 else p))
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, texts, weak):
    own = ODD + texts + texts[:30] + [t.upper() for t in texts[30:50]]
    docs = frame(spark, own).unionByName(frame(spark, own[20:24], 20)).repartition(4)
    digest = (lambda c: F.substring(F.sha2(c, 256), 1, 1)) if weak else exact_dedup.sha256
    got = exact_dedup.duplicates(docs, digest=digest, batch_bytes=1500).collect()
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[lower(r.text)].append(r.doc_id)
    want = sorted((str(i), max((k for k in ids if k is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest())
                  for t, ids in groups.items() for i in ids)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.duplicates(empty(spark)).count() == 0


def test_dedup_goes_on_from_its_state(spark):
    place, one = shared_path(spark, "go-on"), shared_path(spark, "feed")
    for texts in (["a", "b"], ["a", "c"]):
        exact_dedup.arrivals(frame(spark, texts, len(texts[0]) * (texts[1] == "c") * 10)).write.mode("append").parquet(one)
        state = exact_dedup.first_seen(spark.read.parquet(one), checkpoint=place)
    assert state.agg(F.sum("n")).first()[0] == 6 and state.filter("n = 2").count() == 2


def test_warc(spark):
    long = "<p>" + "é" * 600
    rows = [(i, f"http://x/{i} y", h) for i, h in enumerate([long, None, "", long, "short", "short", "a" * 1000, long + "!"])]
    rows += [(None, None, long), (7, "http://again", long + "!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit(1)).repartition(3)
    out = []
    for cores in (3, 1):
        place = shared_path(spark, "warc")
        manifest = warc.write_warc(pages.repartition(cores), place, shard_bytes=2000, roll_bytes=300)
        got = warc.read_warc(manifest, place).collect()
        files = {r.file: open(f"{place.removeprefix('file:')}/{r.file}", "rb").read() for r in manifest.collect()}
        out.append(files)
        assert len(got) == len(rows) and len(files) > 3
        for r in got:
            source = [h or "" for i, u, h in rows if i == r.page_id]
            assert r.payload_bytes in {len(h.encode()) for h in source} and r.payload_digest in {hashlib.sha1(h.encode()).hexdigest() for h in source}
        refers = sorted((str(r.page_id), r.refers_to) for r in got if r.record_type == "revisit")
        assert refers == [("0", 3), ("None", 3)]
    assert out[0] == out[1]  # same files however the work was dealt out
    place = shared_path(spark, "warc")
    assert warc.read_warc(warc.write_warc(pages.limit(0), place), place).count() == 0


def test_licenses(spark):
    mit = dict(licenses.KNOWN)["BSD-3-Clause"]
    own = [mit, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("\n", "  \n"), mit + " more", "x\nReleased under the MIT Licence\ny", "", None]
    got = {(r.doc_id, r.license_id, r.scope): r.n_places for r in licenses.find(frame(spark, own)).collect()}
    assert got == {(0, "BSD-3-Clause", "document"): 1, (1, "BSD-3-Clause", "document"): 1, (3, "MIT", "line"): 1}
    assert licenses.find(empty(spark)).count() == 0


def test_pii(spark, texts):
    own = ["card 4111 1111 1111 1111 and 4111-1111-1111-1111, not 4111111111111112", "on 2024-02-29, not 2023-02-29, nor 31/04/2020; 01.12.1999",
           "DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00", "+1 (017) 555-7713 10.0.0.255 300.1.1.1 078-05-1120 000-12-3456",
           "mail a.b-1@mail7.example.com now", "", None, *texts]
    docs = frame(spark, own)
    found = pii.pseudonymise(docs, b"k")
    got = {r.doc_id: r for r in found.collect()}
    assert [got[i].n_card for i in range(3)] == [2, 0, 0] and got[1].n_date == 2 and got[2].n_iban == 1
    assert (got[3].n_phone, got[3].n_ip, got[3].n_ssn, got[4].n_email) == (1, 1, 1, 1)
    digits = ["".join(filter(str.isdigit, x)) for x in got[0].text.replace(",", "|").replace(" and ", "|").split("|")]
    assert digits[0] == digits[1] != "4111111111111111" and pii.luhn(digits[0]) and "4111111111111112" in got[0].text
    assert got[6].text is None and all(len(r.text) == len(own[i]) for i, r in got.items() if i is not None and own[i] and not r.n_ip)
    back = pii.pseudonymise(found.select("doc_id", "text"), b"k", back=True)
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in docs.collect()}
    assert pii.pseudonymise(empty(spark), b"k").count() == 0


def test_permutation_is_one_to_one():
    move = pii.Permutation(b"key")
    for size in (1, 2, 10, 97, 1000):
        assert sorted(move(v, size, "t") for v in range(size)) == list(range(size))
        assert all(move(move(v, size, "t"), size, "t", back=True) == v for v in range(size))


def test_decontamination(spark, texts):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    phrase = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, phrase(rng.randint(8, 300))) for i in range(70)] + [(70, "only three words"), (71, ""), (72, None), (None, phrase(20))]
    leak = {}
    own = []
    for i in range(120):
        body = phrase(rng.randint(0, 900))
        if i % 3 == 0:
            number, item = items[i % 70]
            body = f"{body} {item.upper() if i % 2 else item}. {phrase(150)}"
            leak[i] = number
        if i % 5 == 0:
            number, item = items[(i * 7) % 70]
            part = item.split()
            body += " " + " ".join(part[:len(part) // 3])
        own.append(body)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, own + ["", None, "has only Three words, really"])
    for size in (8 << 20, 2000):
        got = decontaminate.leaks(docs, bench, index_bytes=size).collect()
        brute = set()
        for d, t in enumerate(own):
            for i, q in items[:70]:
                a, b = decontaminate.shingles(decontaminate.tokens(q)), decontaminate.shingles(decontaminate.tokens(t))
                if len(a & b) >= 0.8 * len(a):
                    brute.add((d, i))
        assert {(r.doc_id, r.item_id) for r in got} == brute | {(122, 70)} and set(leak.items()) <= brute
    left = decontaminate.drop_leaks(docs, bench)
    assert left.count() == docs.count() - len({d for d, _ in brute}) - 1 and left.columns == docs.columns
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(empty(spark), bench).count() == 0


def test_decontamination_wants_the_answer(spark):
    bench = spark.createDataFrame([(1, "which rivers does the northern road cross before the lake", "the green one and the long one")], "item_id long, q string, a string")
    docs = frame(spark, [bench.first().q, f"x {bench.first().q}? {bench.first().a}."])
    got = decontaminate.leaks(docs, bench, question="q", answer="a", threshold=0.4).collect()
    assert [r.doc_id for r in got] == [1]


def test_toxicity_held_out(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(remainder("doc_id", 5) != 0))
    scored = toxicity.score(docs.withColumn("score", F.lit("clash")), model).join(labels.filter(remainder("doc_id", 5) == 0), "doc_id").cache()
    area = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="toxic").evaluate(scored.withColumn("toxic", F.col("toxic").cast("double")))
    wrong = scored.filter("(score >= 0.5) <> (toxic = 1)").count() / scored.count()
    share = scored.filter("toxic = 1").count() / scored.count()
    assert area > 0.88 and wrong < 0.8 * share  # about 240 toxic documents to learn from
    odd = toxicity.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in odd)
    kept = toxicity.keep_ordinary(frame(spark, ODD), model)
    assert kept.columns == frame(spark, ODD).columns and kept.count() == sum(r.score < 0.5 for r in odd)
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(frame(spark, ODD), none).filter("score > 0.01").count() == 0 and toxicity.score(empty(spark), none).count() == 0


def test_pii_leaves_tables_of_numbers_alone():
    r, move = random.Random(5), pii.Permutation(b"k")
    rows = [" ".join(str(r.randrange(10_000)) for _ in range(12)) for _ in range(300)]
    assert [t for t in rows if pii.replace(t, move)[0] != t] == []
    ids = [str(r.randrange(10 ** 11, 10 ** 12)) for _ in range(300)] + [f"{r.random():.14f}" for _ in range(300)]
    assert sum(pii.replace(t, move)[0] != t for t in ids) == 0


def test_pii_other_forms():
    move = pii.Permutation(b"k")
    for text, kind in [("call +441632960961 now", "phone"), ("+49 151 23456789", "phone"), ("3/4/2020", "date"), ("13.7.1999", "date"), ("12/3/2001", "date"),
                       ("2001:db8:85a3::8a2e:370:7334", "ip"), ("FE80::1:2AB", "ip"), ("4111.1111.1111.1111", "card"), ("de89 3704 0044 0532 0130 00 und", "iban"),
                       ("de89370400440532013000", "iban"), ("555-0123 4111111111111111", "card"), ("4111 1111 1111 1111", "card"), ("4111-1111-1111-1111", "card")]:
        new, counts = pii.replace(text, move)
        assert counts[kind] == 1 and new != text and len(new) == len(text), text
        assert pii.replace(new, move, back=True)[0] == text, text
    for text in ("12:34:56", "10:20", "a::b::c", "1/2/3", "99/99/2020", "31/2/2020", "+123", "version 1.2.3", "4111 1111-1111 1111", "9111 1111 1111 1111"):
        assert pii.replace(text, move)[0] == text, text


def test_pii_of_a_long_row_of_numbers():
    import time

    move, start = pii.Permutation(b"k"), time.process_time()
    for text in ("1 " * 300_000, "4111 " * 100_000, "9" * 300_000):
        assert pii.replace(text, move)[0] == text
    assert time.process_time() - start < 30
    dates = "2020-01-02 " * 3000
    new, counts = pii.replace(dates, move)
    assert counts["date"] == 3000 and pii.replace(new, move, back=True)[0] == dates


def test_pii_beside_other_numbers():
    move = pii.Permutation(b"k")
    card, iban = "4111 1111 1111 1111", "DE89370400440532013000"
    for text, kind, value in [
            (f"{card} 12/27", "card", card), ("4111111111111111 123", "card", "4111111111111111"), (f"12 {card}", "card", card),
            (f"12345 {card} 99", "card", card), (f"{card} 5500 0000 0000 0004", "card", card), ("x 3782 822463 10005-7", "card", "3782 822463 10005"),
            (f"{iban} BIC COBADEFFXXX", "iban", iban), ("DE89 3704 0044 0532 0130 00 BIC", "iban", "DE89 3704 0044 0532 0130 00"),
            (f"AB12 {iban}", "iban", iban), ("12/31/2020", "date", "12/31/2020"), ("31/12/2020", "date", "31/12/2020")]:
        new, counts = pii.replace(text, move)
        assert counts[kind] >= 1 and value not in new and len(new) == len(text), text
        assert pii.replace(new, move, back=True)[0] == text, text
    alone = pii.replace(card, move)[0]
    assert pii.replace(f"{card} 12/27", move)[0] == f"{alone} 12/27" and pii.replace(f"12 {card}", move)[0] == f"12 {alone}"
    assert all(int(d := pii.replace(f"{m:02d}/{day}/{y}", move)[0][:2]) <= 12 for m in (1, 12) for day in (13, 28) for y in (1901, 2020, 2099))
    for n in range(300):  # stretches that look valid by chance do not mislead the way back
        text = f"{n} 4{n:03d} {n:02d}11 1111 1" + pii.check_digit(f"4{n:03d}{n:02d}1111111")
        assert pii.replace(pii.replace(text, move)[0], move, back=True)[0] == text
    assert pii.replace("1234 5678 9012 3456 1", move)[0] == "1234 5678 9012 3456 1" or pii.luhn("12345678901234561")


def test_drop_duplicates_of_a_repeated_key(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (1, "alone"), (None, "a"), (3, None)], "doc_id long, text string")
    kept = exact_dedup.drop_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "a"), (1, "alone"), (2, "A"), (3, "")]


def test_toxicity_scores_do_not_move_with_the_caps(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    learned, held = labels.filter(remainder("doc_id", 5) != 0), labels.filter(remainder("doc_id", 5) == 0)
    share = learned.agg(F.avg("toxic")).first()[0]
    scores = []
    for caps in ({}, {"most_ordinary": 600}):  # the second takes about 360 toxic and 600 of 2,800 ordinary documents
        scored = toxicity.score(docs.join(held, "doc_id", "left_semi"), toxicity.fit(docs, learned, **caps))
        scores.append(dict(scored.collect()))
    free, bound = (np.array([s[k] for k in sorted(scores[0])]) for s in scores)
    assert abs(bound.mean() - share) < 0.03 and abs(bound.mean() - free.mean()) < 0.03
    assert abs((bound >= 0.5).mean() - (free >= 0.5).mean()) < 0.02


def test_toxicity_cut_loses_the_asked_share_of_ordinary_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    learned, held = labels.filter(remainder("doc_id", 5) != 0), labels.filter(remainder("doc_id", 5) == 0)
    for caps in ({}, {"most_ordinary": 600}):
        model = toxicity.fit(docs, learned, **caps)
        kept = toxicity.keep_ordinary(docs.join(held, "doc_id"), model, threshold=model.cut).groupBy("toxic").count()
        total = dict(held.groupBy("toxic").count().collect())
        share = {r.toxic: r["count"] / total[r.toxic] for r in kept.collect()}
        assert 0.9 <= share[0] <= 0.99 and share[1] < 0.5  # kept: nearly all ordinary, fewer than half of the toxic ones


def test_logistic_counts_what_rows_stand_for():
    made = np.random.default_rng(1)
    x = np.c_[np.ones(300), made.normal(size=(300, 2))]
    y = (x[:, 1] + made.normal(size=300) > 1).astype(float)
    times = np.where(y == 1, 1, 4)
    assert np.allclose(toxicity.logistic(x, y, stands_for=times.astype(float)), toxicity.logistic(np.repeat(x, times, 0), np.repeat(y, times)))
    assert np.allclose(toxicity.logistic(x, y), toxicity.logistic(x, y, stands_for=np.full(300, 7.0)))


def test_interpolation(spark, texts, monkeypatch):
    seen = {}
    fit = interpolation.fit_weights

    def kept(*a, **k):
        seen["w"] = fit(*a, **k)
        return seen["w"]

    monkeypatch.setattr(interpolation, "fit_weights", kept)
    own = ODD + texts[:80] + texts[:3]
    docs = frame(spark, own).filter("doc_id IS NOT NULL").repartition(4)
    got = {r.doc_id: r for r in interpolation.score(docs, remainder("doc_id", 7) == 2, unit_tokens=2500).collect()}
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in enumerate(own)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = [collections.Counter() for _ in range(4)]
    n_texts = sum(not h for h in held.values())
    for i, w in tokens.items():
        for n in (1, 2, 3):
            padded = [None] * (n - 1) + w
            if not held[i]:
                counts[n].update(tuple(padded[k:k + n]) for k in range(len(w)))
    total, types = sum(counts[1].values()), len(counts[1])
    for i, w in tokens.items():
        base = sum(math.log10((counts[1][(x,)] + 1) / (total + types + 1)) for x in w)
        score = 0.0
        for k in range(len(w)):
            c = [counts[n][tuple(([None] * (n - 1) + w)[k:k + n])] for n in (1, 2, 3)]
            two = counts[1][(w[k - 1],)] if k else n_texts
            three = counts[2][tuple(([None] + w)[k - 1:k + 1])] if k else n_texts
            bucket = 17 + min(15, int(math.log2(three))) if three else 1 + min(15, int(math.log2(two))) if two else 0
            p = [1 / (types + 1), c[0] / total, c[1] / two if two else 0, c[2] / three if three else 0]
            score += math.log10(float(np.dot(seen["w"][bucket], p)))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(counts[1][(x,)] > 0 for x in w), total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    assert np.allclose(seen["w"].sum(axis=1), 1)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)
    assert interpolation.score(empty(spark), F.lit(False)).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_keep_their_contract(spark, folder, name):
    import duckdb

    import corpus_pipeline
    from compare import connect, difference
    from wordtrail.llm.registry import SQL

    df = QUERIES[name](spark, folder)
    if name in SQL:
        assert difference(df, connect(folder), SQL[name]) is None
    elif name.startswith(("op2", "op4", "op5", "op6", "op9", "op10")):
        ids = duckdb.sql(f"SELECT doc_id FROM '{folder}/documents.parquet'").fetchall()
        assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(i for i, in ids)
    elif name == "pipeline":
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert sorted(r.doc_id for r in df.collect()) == sorted(r.doc_id for r in docs.collect())
