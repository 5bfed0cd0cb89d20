"""Concatenate and cut: fixed windows over the token stream of all documents.

The documents of a partition, one behind the other, are a run of the global
token stream.  Pass one encodes each document once, notes where it starts in its
partition's run and writes both to the shared folder.  A prefix sum over the
partitions' totals turns local starts into global offsets.  Pass two cuts each
document at the multiples of the window; a sequence that spans two partitions
simply gets pieces from both, its boundary records, which :func:`sequences`
joins.  No row is shuffled, and no group is larger than a window.

A worker holds a batch, the encoder (pass one only) and some megabytes of texts or
documents on their way; what they took is given back after each.

Defined results: a null text is the empty one; an empty document still has its
end id; strings of special tokens become these tokens, as in the plain call; repeated rows are documents of their own; an empty table has no pieces;
columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .encoding import encoder

TOKENIZER, END_ID, WINDOW = "byte_bpe_50k.json", 1, 2048
#: Documents that are cut at a time.
CUT_ROWS = 1024
RUNS = "part long, doc_id long, local_start long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _runs(tokenizer: str, end: int):
    def encode(batches):
        common.give_back()
        part, at, coder = TaskContext.get().partitionId(), 0, encoder(tokenizer, "<u2", end)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for start, coded in coder.batches(texts):
                n = np.array([len(x) for x in coded], np.int64) // 2
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.record_batch([pa.array(np.full(len(n), part)), ids.slice(start, len(n)), pa.array(starts), pa.array(n), pa.array(coded, pa.binary())], ["part", "doc_id", "local_start", "n_tokens", "ids"])
                common.give_back()

    return encode


def _cut(window: int, keep_ids: bool):
    names = [c.split()[0] for c in PIECES.split(", ")][: None if keep_ids else -1]

    def cut(batches):
        common.fresh_worker()
        for batch in (whole.slice(at, CUT_ROWS) for whole in batches for at in range(0, whole.num_rows, CUT_ROWS)):
            ids, g, n = batch.column("ids"), batch.column("g").to_numpy(), batch.column("n_tokens").to_numpy()
            first, last = g // window, (g + n - 1) // window
            row = np.repeat(np.arange(len(g)), last - first + 1)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
            begin = np.maximum(seq * window, g[row])
            stop = np.minimum((seq + 1) * window, (g + n)[row])
            start, length = begin - g[row], stop - begin
            crc, raw = np.zeros(len(row), np.int64), []
            held, wide, packed = -1, b"", b""
            for k, (r, s, m) in enumerate(zip(row.tolist(), start.tolist(), length.tolist())):
                if r != held:
                    held, packed = r, ids[r].as_py()
                    wide = np.frombuffer(packed, "<u2").astype("<u4").tobytes()
                crc[k] = zlib.crc32(wide[4 * s : 4 * (s + m)])
                if keep_ids:
                    raw.append(packed[2 * s : 2 * (s + m)])
            columns = [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, length, crc, n[row], seq, begin - seq * window))]
            yield pa.record_batch(columns + ([pa.array(raw, pa.binary())] if keep_ids else []), names)
            common.give_back()

    return cut


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, window: int = WINDOW, keep_ids: bool = True) -> DataFrame:
    """One row for each piece of a document in a sequence of ``window`` tokens.

    ``ids`` holds the piece's ids as little-endian unsigned 16-bit integers.  Every
    sequence but the last is full.
    """
    runs = common.materialise(common.documents(docs).mapInArrow(_runs(tokenizer, end_id), RUNS), "packing-runs")
    starts = common.running_starts(runs.groupBy("part").agg(F.sum("n_tokens").alias("total")), "part", "total", "base")
    placed = runs.join(F.broadcast(starts), "part").select("doc_id", "n_tokens", "ids", (F.col("base") + F.col("local_start")).alias("g"))
    return placed.mapInArrow(_cut(window, keep_ids), PIECES if keep_ids else PIECES.rpartition(",")[0])


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id``, ``n_tokens`` and ``ids`` of each sequence: its pieces joined by offset."""
    by = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return by.select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
