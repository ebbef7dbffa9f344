"""Files that tasks write themselves: temporary names, a manifest, then the final names."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from wordtrail.llm.common import filesystem, stored, task_name

MANIFEST = ("shard long, part long, temporary string, file string, n_bytes long, n_records long, "
            "n_units long, first string, last string")


class ShardWriter:
    """Opens files under names of this attempt and notes what the manifest will say of each.

    An attempt that is lost leaves files that no manifest names; a second attempt writes others.
    """

    def __init__(self, folder: str, extension: str):
        self.fs, self.root = filesystem(folder)
        self.extension, self.attempt, self.rows = extension, task_name(), []

    def open(self, shard: int, part: int):
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.shard, self.part = shard, part
        self.temporary = f"_temporary/{shard:06d}-{part:05d}-{self.attempt}.{self.extension}"
        self.stream = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
        return self.stream

    def close(self, n_records: int, n_units: int, first, last) -> None:
        n_bytes = self.stream.tell()
        self.stream.close()
        self.rows.append((self.shard, self.part, self.temporary, f"part-{self.shard:06d}-{self.part:05d}.{self.extension}",
                          n_bytes, n_records, n_units, None if first is None else str(first), None if last is None else str(last)))

    def manifest(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in MANIFEST.split(", ")]
        columns = zip(*self.rows) if self.rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _publish(folder: str, files: list[tuple[str, str]]) -> None:
    system, root = filesystem(folder)
    for temporary, final in files:
        if system.get_file_info(f"{root}/{final}").type == fs.FileType.NotFound:
            system.move(f"{root}/{temporary}", f"{root}/{final}")


def commit(written: DataFrame, folder: str) -> DataFrame:
    """Run the writers, keep their manifest, and give its files their final names.

    The manifest (a table below the shared folder) is complete before the first renaming, and a
    renaming that was done already is skipped, so a repeated task does no harm. The last step
    writes the marker ``_COMMITTED``; a reader takes only files of the manifest.
    """
    manifest = stored(written, "manifest")

    def rename(batches):
        for batch in batches:
            rows = batch.to_pydict()
            _publish(folder, list(zip(rows["temporary"], rows["file"])))
            yield pa.RecordBatch.from_arrays([pa.array(rows["file"])], names=["file"])

    count = manifest.select("temporary", "file").mapInArrow(rename, "file string").count()
    system, root = filesystem(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/_COMMITTED", compression=None) as marker:
        marker.write(f"{count} files\n".encode())
    return manifest
