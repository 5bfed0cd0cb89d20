"""Sorted string tables: a codec and a Spark data source ``sst``.

Layout: data blocks of entries ``klen u32, key, vlen u32, value``; an index of
``klen u32, first key, offset u64, length u64`` for each block; a footer of 20 bytes,
``index offset u64, entry count u64, magic u32``.  Integers are little-endian.

The source plans its tasks by the files' sizes; each reads the index of its file and
gives its blocks as Arrow batches.  With option ``pushFilters``, which needs
``spark.sql.python.filterPushdown.enabled``, it skips the blocks that comparisons on ``k``
rule out; :func:`load` sets it where the session allows.
"""

from __future__ import annotations

import bisect
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..errors import CorruptionError

#: Fixed values of the format.
MAGIC, FOOTER, BLOCK_BYTES = 0x5353544C, 20, 4096
SCHEMA = "k binary, v binary"
#: Bytes of a file that one task of the source reads, and of the blocks in one batch of rows.
TASK_BYTES, BATCH_BYTES = 32 << 20, 1 << 20


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class TableWriter:
    """Writes ascending entries to a stream."""

    def __init__(self, sink, block_bytes: int = BLOCK_BYTES) -> None:
        self.sink, self.block_bytes = sink, block_bytes
        self.block, self.first, self.last = bytearray(), None, None
        self.index, self.at, self.count = bytearray(), 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.last is not None and key <= self.last:
            raise CorruptionError("keys must ascend strictly")
        if self.first is None:
            self.first = key
        self.block += struct.pack("<I", len(key)) + key + struct.pack("<I", len(value)) + value
        self.last, self.count = key, self.count + 1
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.first is not None:
            self.sink.write(bytes(self.block))
            self.index += struct.pack("<I", len(self.first)) + self.first + struct.pack("<QQ", self.at, len(self.block))
            self.at += len(self.block)
            self.block, self.first = bytearray(), None

    def finish(self) -> int:
        self._flush()
        self.sink.write(bytes(self.index) + struct.pack("<QQI", self.at, self.count, MAGIC))
        return self.count


def decode_block(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at, n = 0, len(data)
    while at < n:
        if at + 4 > n:
            raise CorruptionError("truncated entry")
        (size,) = struct.unpack_from("<I", data, at)
        key = data[at + 4 : at + 4 + size]
        at += 4 + size
        if at + 4 > n:
            raise CorruptionError("truncated entry")
        (size,) = struct.unpack_from("<I", data, at)
        value = data[at + 4 : at + 4 + size]
        at += 4 + size
        if at > n:
            raise CorruptionError("truncated entry")
        yield key, value


class TableReader:
    """Random access to one table; ``file`` offers ``size()`` and ``read_at(n, offset)``."""

    def __init__(self, file) -> None:
        size = file.size()
        if size < FOOTER:
            raise CorruptionError("file is shorter than a footer")
        index_at, self.count, magic = struct.unpack("<QQI", file.read_at(FOOTER, size - FOOTER))
        if magic != MAGIC or index_at > size - FOOTER:
            raise CorruptionError("bad magic or index offset")
        self.file, self.first_keys, self.places = file, [], []
        raw, at = file.read_at(size - FOOTER - index_at, index_at), 0
        while at < len(raw):
            (n,) = struct.unpack_from("<I", raw, at)
            self.first_keys.append(raw[at + 4 : at + 4 + n])
            self.places.append(struct.unpack_from("<QQ", raw, at + 4 + n))
            at += 20 + n

    def block(self, i: int) -> bytes:
        offset, size = self.places[i]
        return self.file.read_at(size, offset)

    def get(self, key: bytes) -> bytes | None:
        i = bisect.bisect_right(self.first_keys, key) - 1
        return next((v for k, v in decode_block(self.block(i)) if k == key), None) if i >= 0 else None

    def entry_count(self) -> int:
        return self.count

    def read_all(self) -> list[tuple[bytes, bytes]]:
        return list(self.scan())

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.places)):
            yield from decode_block(self.block(i))


@dataclass
class _Part(InputPartition):
    """The ``n``-th of ``of`` tasks on a file."""

    name: str
    n: int
    of: int


class _Reader(DataSourceReader):
    """Plans by the files' sizes alone; a task reads the index of its file."""

    def __init__(self, path: str) -> None:
        self.path, self.low, self.high = path, None, None

    def partitions(self):
        fs, path = open_fs(self.path)
        info = fs.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else sorted((x for x in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if x.path.endswith(".sst")), key=lambda x: x.path)
        out = [(x.path, max(1, -(-x.size // TASK_BYTES))) for x in files]
        return [_Part(name, n, of) for name, of in out for n in range(of)] or [_Part("", 0, 1)]

    def places(self, table: TableReader) -> list[tuple[int, int]]:
        """Offsets and sizes of the blocks that the pushed bounds leave."""
        lo = 0 if self.low is None else max(0, bisect.bisect_right(table.first_keys, self.low) - 1)
        hi = len(table.places) if self.high is None else bisect.bisect_right(table.first_keys, self.high)
        return table.places[lo:hi]

    def read(self, partition):
        if not partition.name:
            return
        fs, _ = open_fs(self.path)
        with fs.open_input_file(partition.name) as f:
            size = f.size()
            lo, hi = size * partition.n // partition.of, size * (partition.n + 1) // partition.of
            keys, values, held = [], [], 0
            for offset, n in self.places(TableReader(f)):
                if lo <= offset < hi:  # a block belongs to the task in whose share it begins
                    for k, v in decode_block(f.read_at(n, offset)):
                        keys.append(k)
                        values.append(v)
                    held += n
                    if held >= BATCH_BYTES:
                        yield _batch(keys, values)
                        keys, values, held = [], [], 0
            if keys:
                yield _batch(keys, values)


def _batch(keys: list[bytes], values: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["k", "v"])


class _FilteringReader(_Reader):
    """For sessions in which Python sources receive filters."""

    def pushFilters(self, filters):
        for f in filters:
            key = bytes(f.value) if getattr(f, "attribute", None) == ("k",) and isinstance(getattr(f, "value", None), (bytes, bytearray)) else None
            if key is not None and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = key if self.low is None else max(self.low, key)
            if key is not None and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = key if self.high is None else min(self.high, key)
            yield f  # blocks are skipped; rows are still filtered by Spark


@dataclass
class _Written(WriterCommitMessage):
    path: str
    count: int


class _Writer(DataSourceWriter):
    """One table a task; the rows of a task must ascend (sort within partitions first).

    Files get their names by the commit, which also removes what tasks that failed or ran
    twice have left.
    """

    def __init__(self, path: str, block_bytes: int) -> None:
        self.path, self.block_bytes, self.job = path, block_bytes, uuid.uuid4().hex

    def write(self, iterator):
        fs, folder = open_fs(self.path)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/part-{self.job}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{name}.tmp", compression=None) as out:
            table = TableWriter(out, self.block_bytes)
            for row in iterator:
                table.add(bytes(row["k"]), bytes(row["v"]))
            table.finish()
        return _Written(name, table.count)

    def _leftovers(self) -> None:
        fs, folder = open_fs(self.path)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            for x in fs.get_file_info(pafs.FileSelector(folder)):
                if x.path.endswith(".tmp") and self.job in x.path:
                    fs.delete_file(x.path)

    def commit(self, messages):
        fs, _ = open_fs(self.path)
        for m in messages:
            if m is not None and m.count:
                fs.move(f"{m.path}.tmp", f"{m.path}.sst")
        self._leftovers()

    def abort(self, messages):
        self._leftovers()


class SstDataSource(DataSource):
    """``spark.dataSource.register(SstDataSource)``, then format ``sst`` with a path."""

    @classmethod
    def name(cls) -> str:
        return "sst"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return (_FilteringReader if self.options.get("pushfilters", "false").lower() == "true" else _Reader)(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], int(self.options.get("blockbytes", BLOCK_BYTES)))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The tables below a path; filters on the key reach the source where the session allows."""
    spark.dataSource.register(SstDataSource)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("sst").option("path", path).option("pushFilters", pushes).load()
