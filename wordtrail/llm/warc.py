"""WARC archives: a sharded writer whose files do not depend on how Spark ran it, and a reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wordtrail.llm.common import filesystem, running_sum, stored, text_or_empty
from wordtrail.llm.sink import MANIFEST, ShardWriter, commit

# fixed values of the format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_BYTES = 1000


def record_uri(key: int | None, sha1: str) -> str:
    """A record's id follows from its key and payload, so that a second run gives the same bytes."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}:{sha1}')}>"


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; lengths and digests are made anew from the payload. A revisit has no payload."""
    sha1 = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_uri(key, sha1.hexdigest()),
            "WARC-Date": date, "Content-Type": "application/http; msgtype=response"}
    if url:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if refers_to is not None:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_uri(refers_to, sha1.hexdigest()), "X-Refers-To-Key": str(refers_to)}
    if key is not None:
        head["X-Key"] = str(key)
    head |= {"WARC-Payload-Digest": "sha1:" + base64.b32encode(sha1.digest()).decode(), "WARC-Block-Digest": base32_sha1(block),
             "Content-Length": str(len(block))}
    lines = b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in head.items())
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def decisions(rows: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Adds ``refers_to``: of equal payloads of at least ``least`` bytes the largest key, for the others."""
    best = (rows.filter(F.col("n_bytes") >= least).groupBy("sha1").agg(F.count("*").alias("n"), F.max("key").alias("best"))
            .filter("n > 1").select("sha1", "best"))
    return rows.join(best, "sha1", "left").withColumn(
        "refers_to", F.when((F.col("n_bytes") >= least) & ~F.col("key").eqNullSafe(F.col("best")), F.col("best")))


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
               shard_bytes: int = 32 << 20, most_shards: int = 1 << 16, roll_bytes: int = 256 << 20,
               date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record a row, sorted by (key, payload digest), and return the manifest.

    Shards are cut at fixed sums of payload bytes in that order, found by one running sum over
    keys and sizes alone; so files are the same however Spark deals out the work. There are at
    most ``most_shards`` of them (above that size shards grow), and that many cut points go to
    the tasks. The pages travel once, to their shard, where they meet the decisions on revisits;
    a file is closed once it has ``roll_bytes`` compressed bytes. Null payloads are empty, null
    keys sort first and are never referred to; rows equal in key and payload each give a record.
    """
    body = F.encode(text_or_empty(payload), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("n_bytes"))
    narrow = stored(rows, "warc-keys")
    total = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    shard_bytes = max(shard_bytes, -(-total // most_shards))
    placed = running_sum(narrow, ["key", "sha1"], "n_bytes", "before")
    cuts = (placed.groupBy(F.floor(F.col("before") / shard_bytes).alias("shard")).agg(F.min(F.struct("key", "sha1")).alias("least"))
            .orderBy("shard").limit(most_shards + 1).collect())
    edges = sorted(_sort_key(r.least.key, r.least.sha1) for r in cuts)

    @pandas_udf("int")
    def shard_of(k: pd.Series, sha1: pd.Series) -> pd.Series:
        places = np.searchsorted(np.array(edges, dtype=object), np.array([_sort_key(a, b) for a, b in zip(k, sha1)], dtype=object), "right")
        return pd.Series(np.maximum(places - 1, 0))

    revisits = decisions(narrow).filter("refers_to IS NOT NULL").select("key", "sha1", "refers_to").distinct()
    full = pages.select(F.col(key).cast("long").alias("key"), F.sha1(body).alias("sha1"), F.lit(1).alias("kind"),
                        F.lit(None).cast("long").alias("refers_to"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    short = revisits.select("key", "sha1", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"),
                            F.lit(None).cast("binary").alias("payload"))
    text_key = F.col("key").cast("string")
    both = full.unionByName(short).withColumn("shard", shard_of(text_key, "sha1"))
    dealt = both.repartitionById(max(1, len(edges)), "shard").sortWithinPartitions("shard", "key", "sha1", "kind", "url")

    def write(batches):
        out, open_for, known = ShardWriter(folder, "warc.gz"), None, None
        part, sizes, first, last = 0, [0, 0, 0], None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    known = row
                    continue
                if open_for is not None and (row["shard"] != open_for or sizes[0] >= roll_bytes):
                    out.close(sizes[1], sizes[2], first, last)
                    part = part + 1 if row["shard"] == open_for else 0
                    open_for = None
                if open_for is None:
                    open_for, sizes, first = row["shard"], [0, 0, 0], row["key"]
                    stream = out.open(open_for, part)
                same = known is not None and known["key"] == row["key"] and known["sha1"] == row["sha1"]
                data = gzip_member(record(row["key"], row["url"], row["payload"], known["refers_to"] if same else None, date))
                stream.write(data)
                sizes = [sizes[0] + len(data), sizes[1] + 1, sizes[2] + len(row["payload"])]
                last = row["key"]
        if open_for is not None:
            out.close(sizes[1], sizes[2], first, last)
        yield out.manifest()

    return commit(dealt.mapInArrow(write, MANIFEST), folder)


def _sort_key(key: int | str | None, sha1: str) -> str:
    """Text that sorts as (key, payload digest) does, null keys first."""
    return ("0" if key is None else f"1{int(key) + (1 << 63):020d}") + sha1


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a compressed archive, one gzip member at a time."""
    data, unpack, held = b"", None, []
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                if unpack is not None:
                    raise ValueError("the archive ends within a record")
                return
        if unpack is None:
            unpack, held = zlib.decompressobj(31), []
        held.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            whole, unpack = b"".join(held), None
            head, _, rest = whole.partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "surrogatepass").split("\r\n")
            if lines[0].encode() != VERSION:
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            size = int(headers["Content-Length"])
            if rest[size:] != b"\r\n\r\n" or base32_sha1(rest[:size]) != headers["WARC-Block-Digest"]:
                raise ValueError("a record's block does not match its headers")
            yield headers, rest[:size]


def read_warc(manifest: DataFrame, folder: str, key: str = "page_id") -> DataFrame:
    """``key, payload_bytes, payload_digest, record_type, refers_to, url, file`` of each record.

    Digests are checked against the bytes read. A revisit gives length and digest of the payload
    that it stands for.
    """
    names = [key, "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def read(batches):
        system, root = filesystem(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for head, block in parse(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                        if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError("a payload does not match its digest")
                        rows.append((_number(head.get("X-Key")), size, digest, head["WARC-Type"], _number(head.get("X-Refers-To-Key")),
                                     head.get("WARC-Target-URI"), file))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = manifest.select("file")
    return files.repartition(max(1, manifest.count())).mapInArrow(
        read, f"`{key}` long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string")


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)
