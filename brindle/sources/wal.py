"""Write-ahead log files: a codec and a Spark data source ``kvwal``.

A record is ``type u8`` (1 put, 2 delete), ``klen u32, key`` and, for puts,
``vlen u32, value``, little-endian.  A last record that is cut short is ignored; an
unknown type is corruption.
"""

from __future__ import annotations

import io
import itertools
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import CorruptionError
from .sstable import open_fs

PUT, DELETE = 1, 2
#: Records in one batch of rows.
BATCH_ROWS = 4096
SCHEMA = "file string, seq long, op string, k binary, v binary"


def encode(records: Iterable[tuple[int, bytes, bytes | None]]) -> bytes:
    """Bytes of (type, key, value) records."""
    out = bytearray()
    for kind, key, value in records:
        out += struct.pack("<BI", kind, len(key)) + key
        if kind == PUT:
            out += struct.pack("<I", len(value)) + value
    return bytes(out)


def decode(data: bytes) -> Iterator[tuple[int, bytes, bytes | None]]:
    """The records of a whole log."""
    return decode_stream(io.BytesIO(data))


def decode_stream(file, chunk: int = 4 << 20) -> Iterator[tuple[int, bytes, bytes | None]]:
    """The same from a file, of which a chunk and a record are held."""
    held, at, ended = b"", 0, False

    def take(n: int) -> bytes | None:
        nonlocal held, at, ended
        while len(held) - at < n and not ended:
            more = file.read(max(chunk, n))
            ended = not more
            held, at = held[at:] + more, 0
        if len(held) - at < n:
            return None
        at += n
        return held[at - n : at]

    def part() -> bytes | None:
        size = take(4)
        return None if size is None else take(struct.unpack("<I", size)[0])

    while (kind := take(1)) is not None:
        if kind[0] not in (PUT, DELETE):
            raise CorruptionError(f"unknown record type {kind[0]}")
        key = part()
        value = part() if key is not None and kind[0] == PUT else None
        if key is None or kind[0] == PUT and value is None:
            return
        yield kind[0], key, value


@dataclass
class _File(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        fs, path = open_fs(self.path)
        if fs.get_file_info(path).type == pafs.FileType.File:
            return [_File(path)]
        return [_File(p) for p in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".wal"))] or [_File("")]

    def read(self, partition):
        if partition.name:
            fs, _ = open_fs(self.path)
            with fs.open_input_stream(partition.name, compression=None) as f:
                name, records, first = partition.name.rsplit("/", 1)[-1], decode_stream(f), 0
                while rows := list(itertools.islice(records, BATCH_ROWS)):
                    n = len(rows)
                    ops = ["insert" if kind == PUT else "remove" for kind, _, _ in rows]
                    columns = [[name] * n, range(first, first + n), ops, [k for _, k, _ in rows], [v for *_, v in rows]]
                    types = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["file", "seq", "op", "k", "v"])
                    first += n


class WalDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvwal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])
