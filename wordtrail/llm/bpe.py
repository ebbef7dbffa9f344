"""Byte-pair encoding of whole texts in numpy merge rounds, and decoding."""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NO_RANK = np.int64(1 << 60)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A vocabulary of merges over words, read from a tokenizer's JSON file.

    Text is split at special tokens, then put into composed form, its white space made single
    blanks, and lower-cased; words are matched by the file's pattern, white space is left out.
    """

    def __init__(self, path: str):
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: list[str] = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for token, number in [*self.vocab.items(), *self.special.items()]:
            self.tokens[number] = token
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.space = regex.compile(r"\p{White_Space}+")
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.inner = np.array([self.vocab.get(c, -1) for c in letters])
        self.last = np.array([self.vocab.get(c + self.end, -1) for c in letters])
        if min(self.inner.min(), self.last.min()) < 0:
            raise ValueError("the vocabulary lacks letters for single bytes")
        self._load_merges(model["merges"])
        self.known: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def _load_merges(self, merges: list) -> None:
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.width = len(self.tokens)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank, self.pair_made = keys[order], order.astype(np.int64), made[order]
        # a merge is safe to apply to all its places at once if no pair with its product ranks before it
        first_use = np.full(self.width, NO_RANK)
        ranks = np.arange(len(pairs), dtype=np.int64)
        np.minimum.at(first_use, left, ranks)
        np.minimum.at(first_use, right, ranks)
        self.at_once = np.r_[first_use[made] > ranks, True]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; ``words`` are pieces that the pattern matched, none empty."""
        if not words:
            return []
        raw = [w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data].astype(np.int64)
        ends = np.cumsum(size) - 1
        symbol[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(raw)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            key = symbol[:-1] * self.width + symbol[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = (self.pair_keys[at] == key) & (word[1:] == word[:-1])
            rank = np.r_[np.where(hit, self.pair_rank[at], NO_RANK), NO_RANK]
            least = np.minimum.reduceat(rank, start)
            alive = np.repeat(least < NO_RANK, np.diff(np.r_[start, len(symbol)]))
            if not alive.all():
                done.append((word[~alive], symbol[~alive]))
            best = np.repeat(least, np.diff(np.r_[start, len(symbol)]))
            take = np.flatnonzero(alive & (rank == best))
            if not len(take):
                break
            run = np.r_[True, (take[1:] != take[:-1] + 1) | (word[take[1:]] != word[take[:-1]])]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(take)), 0))
            take = take[(np.arange(len(take)) - begin) % 2 == 0]  # of x x x the first two meet
            lone = ~self.at_once[rank[take]]
            if lone.any():
                leftmost = np.r_[True, word[take[1:]] != word[take[:-1]]]
                take = take[leftmost | ~lone]
            symbol[take] = self.pair_made[at[take]]
            alive[take + 1] = False
            symbol, word = symbol[alive], word[alive]
        word, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        cuts = np.cumsum(np.bincount(word, minlength=len(raw)))[:-1]
        return np.split(symbol[order], cuts)

    def chunks(self, text: str) -> list[str]:
        """Special tokens as they are; the rest normalised and cut at white space."""
        out: list[str] = []
        parts = self.special_at.split(text) if self.special_at and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                out.append(part)
            elif part.isascii() and not any(c in part for c in "\x1c\x1d\x1e\x1f"):
                out += part.lower().split()
            elif self.newer(part):
                out += filter(None, self.space.split(self.library.normalizer.normalize_str(part)))
            else:
                part = unicodedata.normalize("NFC", part).replace("\N{GREEK CAPITAL LETTER SIGMA}", "\N{GREEK SMALL LETTER SIGMA}")
                out += filter(None, self.space.split(part.lower()))
        return out

    @property
    def library(self):
        """For texts with characters newer than Python's Unicode tables: how these are lower-cased
        and classed depends on the library's own tables, so it normalises and cuts such texts."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def newer(self, text: str) -> bool:
        """Whether a text holds characters that only one of Python's and the library's tables knows."""
        if text == "" or max(text) < "\u0250":
            return False
        own = set(text)
        return any(unicodedata.category(c) == "Cn" for c in own) or any(map(unicodedata.combining, own)) and not own.isdisjoint(self.odd_marks)

    @cached_property
    def odd_marks(self) -> set[str]:
        """Combining marks that the library leaves in another order beside other marks than Python does."""
        clean, odd = self.library.normalizer.normalize_str, set()
        for mark in (chr(c) for c in range(0x300, sys.maxunicode + 1)):
            if unicodedata.combining(mark):
                tries = [f"x{other}{mark}" for other in "\u0316\u0307\u0345"] + [f"x{mark}{other}" for other in "\u0316\u0307\u0345"]
                if any(clean(t) != unicodedata.normalize("NFC", t).lower() for t in tries):
                    odd.add(mark)
        return odd

    def pieces(self, chunk: str) -> list[str]:
        """What the pattern matches."""
        if not self.newer(chunk):
            return self.words.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def learn(self, chunks: set[str], most: int) -> None:
        """Encode the chunks that aren't known yet, all their words in one go. Of about ``most``
        chunks kept, those not met again while half as many new ones came are forgotten."""
        if len(self.known) > most // 2:
            self.older, self.known = self.known, {}
        new = []
        for c in chunks:
            if c not in self.known:
                if c in self.older:
                    self.known[c] = self.older[c]
                else:
                    new.append(c)
        pieces, counts = [], []
        for c in new:
            found = [] if c in self.special else self.pieces(c)
            pieces += found
            counts.append(len(found))
        ids = self.encode_words(pieces)
        at = 0
        for c, n in zip(new, counts):
            own = [self.special[c]] if c in self.special else np.concatenate(ids[at:at + n]).tolist() if n else []
            at += n
            self.known[c] = (" ".join(map(str, own)), len(own), self.decode(own))

    def decode(self, ids) -> str:
        """The tokens of the ids, joined by one blank: the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        chunks = self.chunks(text)
        self.learn(set(chunks), 1 << 20)
        return [int(i) for c in chunks if self.known[c][1] for i in self.known[c][0].split(" ")]


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_and_decode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", known: int = 200_000,
                      with_ids: bool = False) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` for each row, and ``ids`` if asked for.

    ``path`` must be readable by every task. A null text counts as empty (no tokens). Rows come
    back one for one, in no shuffle. A task keeps the ids of at most about ``known`` chunks and
    encodes those it lacks in one run of merge rounds a batch; the bound changes no result.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>"

    def run(batches):
        model = loaded(path)
        names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                rows = batch.slice(at, 250)
                texts = [model.chunks(t or "") for t in rows.column(1).to_pylist()]
                model.learn(set().union(*texts), known)
                count, sha, back, ids = [], [], [], []
                for chunks in texts:
                    found = [model.known[c] for c in chunks]
                    found = [x for x in found if x[1]]
                    joined = " ".join([x[0] for x in found])
                    count.append(sum([x[1] for x in found]))
                    sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    back.append(hashlib.sha256(" ".join([x[2] for x in found]).encode()).hexdigest())
                    if with_ids:
                        ids.append(np.array(joined.split(), np.int32))
                data = [rows.column(0), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                if with_ids:
                    data.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(data, names=names)

    return docs.select(key, text).mapInArrow(run, schema)
