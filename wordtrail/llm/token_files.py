"""Token ids in Arrow files of equal-length sequences, and the way back."""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtrail.llm.bpe import byte_letters
from wordtrail.llm.common import filesystem, text_or_empty
from wordtrail.llm.sink import MANIFEST, ShardWriter, commit

#: places where byte-level pre-tokens always end: before a blank that a non-blank follows
CUT = regex.compile(r" (?=\S)")
BEFORE_BLANK = regex.compile(r" (?!\S)")
#: words of plain letters and what may end them, on one or two lines: the library's pattern parts them all
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:&$#%*]*)(?:(\n)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:&$#%*]*))?")



class CachedEncoder:
    """The tokenizers library over chunks of text, each chunk encoded once a task or so.

    A byte-level pre-token never reaches over a blank that is followed by a non-blank; so the ids
    of a text are those of its chunks, cut there. Plain words go to the library's model at once,
    other new chunks to the whole library in runs, parted by a special token. The cache is emptied
    beyond ``most`` chunks, which changes no result.
    """

    RUN = 500

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.part_id, self.part = special[0] if special else (None, None)
        self.most, self.later, self.tails = most, {}, {}
        self.model, self.visible = self.tokenizer.model, dict(enumerate(byte_letters()))
        whole = json.loads(self.tokenizer.to_str())
        before = whole.get("pre_tokenizer") or {}
        #: only where texts reach the model as they are, cut by the usual pattern, can the way be shortened
        self.direct = (whole.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                       and not before.get("add_prefix_space") and whole["model"]["type"] == "BPE"
                       and not any(PLAIN_WORD.fullmatch(t["content"].strip()) for t in whole.get("added_tokens", [])))

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: set[str]) -> None:
        later, width = self.later, self.dtype.itemsize
        new = [c for c in chunks if c not in later]
        if self.direct:
            new = self._learn_words(new)
        odd = [c for c in new if self.part is None or self.part in c]
        later.update(zip(odd, self.plain([" " + c for c in odd])))
        if odd:
            new = [c for c in new if c not in later]
        runs = [new[at:at + self.RUN] for at in range(0, len(new), self.RUN)]
        for at in range(0, len(runs), 8):
            some = runs[at:at + 8]
            joined = [(" " + (self.part + " ").join(run) + self.part) for run in some]
            for run, e in zip(some, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                data, stops = ids.tobytes(), (np.flatnonzero(ids == self.part_id) * width).tolist()
                start = 0
                for c, stop in zip(run, stops):
                    later[c] = data[start:stop]
                    start = stop + width

    def _learn_words(self, new: list[str]) -> list[str]:
        """Learn the plain words among new chunks, their ends and a second line apart; gives back the others."""
        later, others, match = self.later, [], PLAIN_WORD.fullmatch
        for c in new:
            if (m := match(c)) is None:
                others.append(c)
                continue
            word, tail, line, second, end = m.groups()
            ids = later.get(word) or self._word(word, word, self.visible[32])
            if tail:
                ids += self._tail(tail)
            if line:
                ids += self._tail(line) + (later.get(line + second) or self._word(line + second, second, ""))  # no chunk begins with a line's end
                if end:
                    ids += self._tail(end)
            later[c] = ids
        return others

    def _word(self, key: str, word: str, blank: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.visible)
        ids = self.later[key] = array(self.dtype.char, [t.id for t in self.model.tokenize(blank + shown)]).tobytes()
        return ids

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            (self.tails[tail],) = self.plain([tail])
        return self.tails[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian numbers of ``dtype``."""
        if len(self.later) > self.most:
            self.later = {}
        chunks = [CUT.split(t) if BEFORE_BLANK.search(t) else t.split(" ") for t in texts]
        self._learn(set().union(*chunks))
        get = self.later.__getitem__
        return [b"".join([first, *map(get, own[1:])]) for first, own in zip(self.plain([own[0] for own in chunks]), chunks)]


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str, most: int) -> CachedEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path, most)
    return _ENCODERS[path]


class _SequenceFile:
    """An Arrow file of fixed-size lists: ``ids`` and ``mask``; the last sequence is filled up with zeros."""

    def __init__(self, stream, length: int, dtype: np.dtype, batch: int = 256):
        self.length, self.batch, self.kind = length, batch, pa.from_numpy_dtype(dtype)
        self.dtype, self.parts, self.held = dtype, [], 0
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(stream, self.schema)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.writer.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        full = self.length * self.batch
        if self.held >= full:
            data = np.concatenate(self.parts)
            for at in range(0, len(data) - full + 1, full):
                self._write(data[at:at + full], full)
            self.parts = [data[len(data) // full * full:]]
            self.held = len(self.parts[0])

    def close(self) -> None:
        if self.held:
            data = np.concatenate(self.parts)
            self._write(np.r_[data, np.zeros(-len(data) % self.length, self.dtype)], len(data))
        self.writer.close()


def write_tokens(docs: DataFrame, folder: str, path: str, text: str = "text", key: str = "doc_id", end: int = 0,
                 length: int = 2048, file_tokens: int = 1 << 28, known: int = 1_000_000) -> DataFrame:
    """Write the ids of all texts, ``end`` after each, in ascending key order; returns the manifest.

    One shuffle of the texts by key range; each task encodes its range and writes its files, a
    new one after ``file_tokens`` ids. Besides ``ids`` files there is an ``index`` file of the
    same name with key and number of ids of each text. A null text has the end id only. Keys are
    whole numbers; null keys come first; rows of one key are ordered by a hash of their text.
    """
    if dict(docs.dtypes)[key] not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("keys must be whole numbers")
    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")

    def write(batches):
        from pyspark import TaskContext

        shard, model = TaskContext.get().partitionId(), encoder(path, known)
        ids_out, index_out = ShardWriter(folder, "arrow"), ShardWriter(folder, "index.arrow")
        index_schema = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64())])
        part, file = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                keys, blobs = some.column(0).to_pylist(), model.encode(some.column(1).to_pylist())
                sizes = []
                done = 0
                for i, blob in enumerate(blobs):
                    if file is None:
                        file = _SequenceFile(ids_out.open(shard, part), length, model.dtype)
                        index = pa.ipc.new_file(index_out.open(shard, part), index_schema)
                        total, n_docs, first = 0, 0, keys[i]
                    ids = np.append(np.frombuffer(blob, model.dtype), model.dtype.type(end))
                    file.add(ids)
                    sizes.append(len(ids))
                    total, n_docs = total + len(ids), n_docs + 1
                    if total >= file_tokens:
                        index.write_batch(pa.RecordBatch.from_arrays([pa.array(keys[done:i + 1], pa.int64()), pa.array(sizes, pa.int64())], schema=index_schema))
                        done, sizes = i + 1, []
                        file.close(), index.close()
                        ids_out.close(n_docs, total, first, keys[i]), index_out.close(n_docs, total, first, keys[i])
                        part, file = part + 1, None
                if file is not None and sizes:
                    index.write_batch(pa.RecordBatch.from_arrays([pa.array(keys[done:], pa.int64()), pa.array(sizes, pa.int64())], schema=index_schema))
                    last = keys[-1]
        if file is not None:
            file.close(), index.close()
            ids_out.close(n_docs, total, first, last), index_out.close(n_docs, total, first, last)
        yield ids_out.manifest()
        yield index_out.manifest()

    return commit(ordered.mapInArrow(write, MANIFEST), folder)


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every text, from the files that the manifest names.

    ``start`` counts the ids of all texts before; it is the sum over earlier files, of which
    there is one row each, plus the place in the own file.
    """
    files = manifest.filter(~F.col("file").endswith(".index.arrow")).selectExpr(
        "file", "sum(n_units) OVER (ORDER BY shard, part) - n_units AS base")
    parts = max(1, files.count())

    def read(batches):
        system, root = filesystem(folder)
        for batch in batches:
            for file, base in zip(*batch.to_pydict().values()):
                with system.open_input_file(f"{root}/{file[:-6]}.index.arrow") as source:
                    index = pa.ipc.open_file(source).read_all()
                sizes = index.column("n_tokens").to_numpy()
                crc, held, at = np.zeros(len(sizes), np.int64), np.zeros(0, "<u4"), 0
                with system.open_input_file(f"{root}/{file}") as source:
                    reader = pa.ipc.open_file(source)
                    for number in range(reader.num_record_batches):
                        ids = reader.get_batch(number).column("ids").flatten().to_numpy(zero_copy_only=False)
                        held = np.concatenate([held, ids.astype("<u4")])
                        used = 0
                        while at < len(sizes) and used + sizes[at] <= len(held):
                            crc[at] = zlib.crc32(held[used:used + sizes[at]].tobytes())
                            used += sizes[at]
                            at += 1
                        held = held[used:]
                yield pa.RecordBatch.from_arrays([
                    index.column("key").combine_chunks(), pa.array(base + np.cumsum(sizes) - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(parts).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def sequences(folder: str, file: str) -> pa.Table:
    """All sequences of one file, mapped into memory where the file system allows it (no copy)."""
    system, root = filesystem(folder)
    if system.type_name == "local":
        return pa.ipc.open_file(pa.memory_map(f"{root}/{file}")).read_all()
    return pa.ipc.open_file(system.open_input_file(f"{root}/{file}")).read_all()
