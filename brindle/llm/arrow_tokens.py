"""Token ids in Arrow files of fixed-size-list batches.

The documents are range-partitioned by ``doc_id``.  Each task encodes its range
and writes one Arrow IPC file: record batches whose column ``ids`` is a
``fixed_size_list<uint16, L>`` and whose column ``mask`` is a
``fixed_size_list<bool, L>``, which is false only behind the last id of the file.
All rows are equally long, so token ``t`` of a file lies at row ``t // L`` and a
reader maps the file and slices it without copying.  A table of documents
(``doc_id``, file, start in the file, length) goes with the files; the starts in
the whole corpus follow from a prefix sum over the files' totals.

A file's name holds a fresh identifier: a task that is run again writes another
file, and only files that a finished task has reported are ever read.

Defined results: a null text is the empty one; an empty document has only its
end id; strings of special tokens become these tokens, as in the plain call; rows of one ``doc_id`` are ordered by text; an empty table has no files;
columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .encoding import encoder

TOKENIZER, END_ID, LENGTH = "word_bpe_49k.json", 2, 2048
#: Sequences in one record batch.
BATCH_ROWS = 256
INDEX = "part long, file string, doc_id long, local_start long, n_tokens long"


def file_schema(length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", pa.uint16(), nullable=False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length))])


class _Shard:
    """Writes ids, given bit by bit, as equal rows."""

    def __init__(self, uri: str, length: int) -> None:
        self.schema, self.length, self.held, self.n = file_schema(length), length, [], 0
        fs, path = common.filesystem(uri)
        self.sink = fs.open_output_stream(path, compression=None)
        self.writer = pa.ipc.new_file(self.sink, self.schema)

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n += len(ids) // 2
        if self.n >= self.length * BATCH_ROWS:
            self._flush(self.n // (self.length * BATCH_ROWS) * (self.length * BATCH_ROWS))

    def _flush(self, n: int) -> None:
        raw = b"".join(self.held)
        size = self.length * BATCH_ROWS
        for at in range(0, n, size):
            ids = np.frombuffer(raw[2 * at : 2 * min(n, at + size)], "<u2")
            rows = -(-len(ids) // self.length)
            full, mask = np.zeros(rows * self.length, "<u2"), np.zeros(rows * self.length, bool)
            full[: len(ids)], mask[: len(ids)] = ids, True
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((full, mask), self.schema)]
            self.writer.write_batch(pa.record_batch(arrays, schema=self.schema))
        self.held, self.n = [raw[2 * n :]], self.n - n

    def close(self) -> None:
        if self.n:
            self._flush(self.n)
        self.writer.close()
        self.sink.close()


def _write(folder: str, tokenizer: str, end: int, length: int):
    def write(batches):
        part, at, coder, shard, uri = TaskContext.get().partitionId(), 0, encoder(tokenizer, "<u2", end), None, ""
        for batch in batches:
            if shard is None and batch.num_rows:
                uri = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.arrow"
                shard = _Shard(uri, length)
            ids = batch.column("doc_id")
            for start, coded in coder.batches(batch.column("text")):
                n = np.array([len(x) for x in coded], np.int64) // 2
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                for x in coded:
                    shard.add(x)
                yield pa.record_batch([pa.array(np.full(len(n), part)), pa.array([uri] * len(n)), ids.slice(start, len(n)), pa.array(starts), pa.array(n)], ["part", "file", "doc_id", "local_start", "n_tokens"])
        if shard is not None:
            shard.close()

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Write the files below ``folder`` and return the table of documents with ``start``."""
    spark = docs.sparkSession
    fs, path = common.filesystem(folder)
    fs.create_dir(path, recursive=True)
    ordered = common.documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write(folder, tokenizer, end_id, length), INDEX).write.parquet(f"{folder}/documents")
    index = spark.read.schema(INDEX).parquet(f"{folder}/documents")
    starts = common.running_starts(index.groupBy("part").agg(F.sum("n_tokens").alias("total")), "part", "total", "base")
    return index.join(F.broadcast(starts), "part").select("file", "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "local_start", "n_tokens")


class TokenFile:
    """Random access to one file; local files are mapped and slices share their memory."""

    def __init__(self, uri: str) -> None:
        fs, path = common.filesystem(uri)
        local = fs.type_name == "local"
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.length = self.reader.schema.field("ids").type.list_size
        self._held = (-1, None)

    def _column(self, batch: int, name: str) -> pa.Array:
        if self._held[0] != batch:
            self._held = (batch, self.reader.get_batch(batch))
        return self._held[1].column(name)

    def sequence(self, row: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of one sequence; the ids are a view."""
        batch, at = divmod(row, BATCH_ROWS)
        ids, mask = (self._column(batch, c).values.slice(at * self.length, self.length) for c in ("ids", "mask"))
        return ids.to_numpy(), mask

    def slice(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start``; a view unless they cross a batch."""
        size, parts = BATCH_ROWS * self.length, []
        while n > 0:
            batch, at = divmod(start, size)
            parts.append(self._column(batch, "ids").values.slice(at, n).to_numpy())
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, "<u2"), *parts])


def _checksums(batches):
    held, uri = None, None
    for batch in batches:
        crc = []
        for f, s, n in zip(batch.column("file").to_pylist(), batch.column("local_start").to_pylist(), batch.column("n_tokens").to_pylist()):
            if f != uri:
                uri, held = f, TokenFile(f)
            crc.append(zlib.crc32(held.slice(s, n).astype("<u4").tobytes()))
        yield pa.record_batch([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_checksums(index: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, the ids read from the files."""
    return index.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
