"""Files of fixed layout that many tasks read or write at once, as Python data sources.

``boxwood_blob`` reads a packed mesh: the driver reads the header, each input
partition is a range of records. ``boxwood_ranges`` writes rows (at, data): bytes and
their place in one file. Tasks write their rows into an unfinished file next to the path; when all
have, the driver checks that they fill it and renames it, else it is deleted. A
task that runs twice writes the same bytes to the same places, so lost executors do no harm.

Paths are local ones or file: URIs of a folder that driver and executors share.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from boxwood.schema import BOUNDS, BOXES

VERTEX = tuple(f"v{k}{c}" for k in range(3) for c in "xyz")
#: Fixed value: the layout of a packed mesh: int32 count, triangles of min, max and three corners, min and max of all; little-endian float32.
BLOB_FLOATS = 15
RECORD, HEAD, TAIL = 4 * BLOB_FLOATS, 4, 24
BLOB_SCHEMA = BOXES + ", " + ", ".join(f"{c} float" for c in VERTEX)
#: A packed triangle's numbers among the columns of bounds and corners: lows, highs, corners.
PACKED = [0, 2, 4, 1, 3, 5, *range(6, BLOB_FLOATS)]
_RECORDS = 1_000_000
_BATCH = 65_536


def local(path: str) -> str:
    """The path that open() takes."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"not a local or shared file: {path}")
    return unquote(parsed.path) if parsed.scheme else path


@dataclass
class Records(InputPartition):
    first: int
    last: int


class BlobReader(DataSourceReader):
    def __init__(self, path: str, records: int):
        self.path, self.records = path, records

    def partitions(self) -> list[Records]:
        with open(self.path, "rb") as f:
            head = f.read(HEAD)
        n = struct.unpack("<i", head)[0] if len(head) == HEAD else -1
        if n < 0 or os.path.getsize(self.path) != HEAD + RECORD * n + TAIL:
            raise ValueError(f"not a packed mesh: {self.path}")
        return [Records(a, min(a + self.records, n)) for a in range(0, n, self.records)] or [Records(0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            f.seek(HEAD + RECORD * partition.first)
            for a in range(partition.first, partition.last, _BATCH):
                n = min(_BATCH, partition.last - a)
                data = np.frombuffer(f.read(RECORD * n), dtype="<f4").reshape(n, BLOB_FLOATS)
                columns = [np.ascontiguousarray(data[:, PACKED.index(k)]) for k in range(BLOB_FLOATS)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), *map(pa.array, columns)], names=["tri", *BOUNDS, *VERTEX])


class BlobSource(DataSource):
    """Options: path, and records: how many an input partition has at most."""

    @classmethod
    def name(cls) -> str:
        return "boxwood_blob"

    def schema(self) -> str:
        return BLOB_SCHEMA

    def reader(self, schema) -> BlobReader:
        return BlobReader(local(self.options["path"]), int(self.options.get("records", _RECORDS)))


@dataclass
class Part(WriterCommitMessage):
    size: int
    end: int


class RangesWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.unfinished = path, f"{path}.{uuid.uuid4().hex}.part"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        size = end = 0
        handle = os.open(self.unfinished, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for batch in batches:
                held, start = [], 0  # neighbours are written together
                for at, data in zip(batch.column("at").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    if held and at != start + sum(map(len, held)) or len(held) >= 4096:
                        self._put(handle, b"".join(held), start)
                        held = []
                    if not held:
                        start = at
                    held.append(data)
                    size, end = size + len(data), max(end, at + len(data))
                self._put(handle, b"".join(held), start)
            os.fsync(handle)
        finally:
            os.close(handle)
        return Part(size, end)

    def _put(self, handle: int, data: bytes, at: int) -> None:
        while data:
            n = os.pwrite(handle, data, at)
            data, at = data[n:], at + n

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None]
        if sum(p.size for p in parts) != max((p.end for p in parts), default=0):
            self.abort(messages)
            raise ValueError("rows leave gaps in the file, or overlap")
        if not os.path.exists(self.unfinished):
            open(self.unfinished, "wb").close()
        os.replace(self.unfinished, self.path)

    def abort(self, messages: list[Part | None]) -> None:
        if os.path.exists(self.unfinished):
            os.remove(self.unfinished)


class RangesSource(DataSource):
    """Writes columns at (bigint) and data (binary) to the file at path."""

    @classmethod
    def name(cls) -> str:
        return "boxwood_ranges"

    def schema(self) -> str:
        return "at bigint, data binary"

    def writer(self, schema, overwrite: bool) -> RangesWriter:
        return RangesWriter(local(self.options["path"]))


def read_blob(spark: SparkSession, path: str, records: int = _RECORDS) -> DataFrame:
    """Boxes and corners of a packed mesh; ids are places in the file."""
    spark.dataSource.register(BlobSource)
    return spark.read.format("boxwood_blob").option("records", records).load(path)


def write_ranges(rows: DataFrame, path: str) -> None:
    """rows: at, data. The file appears whole or not at all, and replaces one that is there."""
    rows.sparkSession.dataSource.register(RangesSource)
    rows.select("at", "data").write.format("boxwood_ranges").mode("append").save(os.path.abspath(local(path)))
