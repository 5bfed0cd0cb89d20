"""Token counts from flat token files by a separator scan.

A flat token file is nothing but ids, little-endian unsigned 16-bit, each
document closed by the end-of-document id; it has no index.  To count, each file
is cut into blocks of a fixed number of ids, whatever they hold.  A scan task
searches its block for the end id with vector operations and reports the counts
between the separators it found, with two open edges: the ids before its first
separator and those behind its last.  A prefix scan over the blocks of a file
adds each open tail to the head of the block that closes it (through blocks with
no separator at all) and numbers the documents.

Defined results: an empty document counts its end id alone; ids behind the last
separator of a file are an unfinished document and are reported by
``open_tail``; an empty table has no files.  The end id must not occur inside a
document: :func:`write_flat` encodes strings of special tokens as ordinary text, and
no ordinary text encodes to that id.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .encoding import encoder

TOKENIZER, END_ID = "byte_bpe_50k.json", 50256
#: Ids in one scan block; bytes that one task scans.
BLOCK, BYTES_EACH = 1 << 22, 32 << 20
ROSTER = "file string, n_ids long, ordinal long, doc_id long"


def _write(folder: str, tokenizer: str, end: int):
    def write(batches):
        coder, out, ordinal, uri, n_ids = encoder(tokenizer, "<u2", end, ordinary=True), None, 0, "", 0
        for batch in batches:
            if out is None and batch.num_rows:
                uri = f"{folder}/flat-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.u16"
                fs, path = common.filesystem(uri)
                out = fs.open_output_stream(path, compression=None)
            ids = batch.column("doc_id")
            for start, coded in coder.batches(batch.column("text")):
                for x in coded:
                    out.write(x)
                    n_ids += len(x) // 2
                m = len(coded)
                yield pa.record_batch([pa.array([uri] * m), pa.array([None] * m, pa.int64()), pa.array(np.arange(ordinal, ordinal + m)), ids.slice(start, m)], ["file", "n_ids", "ordinal", "doc_id"])
                ordinal += m
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([uri]), pa.array([n_ids]), pa.array([None], pa.int64()), pa.array([None], pa.int64())], ["file", "n_ids", "ordinal", "doc_id"])

    return write


def write_flat(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """Write flat files below ``folder``.

    Returns (files: ``file, n_ids``; roster: ``file, ordinal, doc_id``).  The roster
    says which document is the n-th of a file, not how long it is or where it lies.
    """
    fs, path = common.filesystem(folder)
    fs.create_dir(path, recursive=True)
    common.documents(docs).mapInArrow(_write(folder, tokenizer, end_id), ROSTER).write.parquet(f"{folder}/roster")
    rows = docs.sparkSession.read.schema(ROSTER).parquet(f"{folder}/roster")
    return rows.where("n_ids IS NOT NULL").select("file", "n_ids"), rows.where("n_ids IS NULL").select("file", "ordinal", "doc_id")


def _scan(end: int):
    def scan(batches):
        for batch in batches:
            for uri, block, first, n in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "first", "n"))):
                fs, path = common.filesystem(uri)
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(2 * n, 2 * first), "<u2")
                at = np.flatnonzero(ids == end)
                counts = np.diff(at, prepend=-1)
                tail = len(ids) - (int(at[-1]) + 1 if len(at) else 0)
                yield pa.record_batch([pa.array([uri]), pa.array([block]), pa.array([len(at)], pa.int64()), pa.array([tail], pa.int64()), pa.array([counts.tolist()], pa.list_(pa.int64()))], ["file", "block", "ends", "tail", "counts"])

    return scan


def blocks_of(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """``file, block, first, n``: the blocks of all files, those that lie together in one task.

    A block's row is narrow but makes its task read the block, so the number of tasks
    follows the bytes to read.
    """
    size = files.agg(F.sum("n_ids")).first()[0] or 0
    blocks = files.select("file", "n_ids", F.explode(F.expr(f"sequence(0L, greatest(n_ids - 1, 0L) div {block})")).alias("block"))
    blocks = blocks.select("file", "block", (F.col("block") * block).alias("first"), F.least(F.lit(block), F.col("n_ids") - F.col("block") * block).alias("n"))
    return blocks.repartitionByRange(common.tasks(files.sparkSession, 2 * size, BYTES_EACH), "file", "block")


def count_tokens(files: DataFrame, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """``file, ordinal, n_tokens`` (with the end id) of each document of flat token files."""
    blocks = blocks_of(files, block)
    found = common.materialise(blocks.mapInArrow(_scan(end_id), "file string, block long, ends long, tail long, counts array<bigint>"), "token-blocks")
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    edges = found.select("file", "block", "ends", "tail")
    # The tail carried in: the tails since (and of) the last block that holds a separator.
    runs = edges.withColumn("run", F.coalesce(F.sum((F.col("ends") > 0).cast("long")).over(before), F.lit(0)))
    in_run = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lead = F.sum(F.col("lag_tail")).over(in_run)
    carried = runs.withColumn("lag_tail", F.coalesce(F.lag("tail").over(by_file), F.lit(0))).select("file", "block", lead.alias("carry"), F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("seen"))
    counts = found.where("ends > 0").join(carried, ["file", "block"]).select("file", "seen", "carry", F.posexplode("counts").alias("i", "n"))
    return counts.select("file", (F.col("seen") + F.col("i")).alias("ordinal"), (F.col("n") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))


def open_tail(files: DataFrame, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """``file, n_open``: ids behind the last separator of each file that has any."""
    done = count_tokens(files, end_id, block).groupBy("file").agg(F.sum("n_tokens").alias("closed"))
    return files.join(done, "file", "left").select("file", (F.col("n_ids") - F.coalesce("closed", F.lit(0))).alias("n_open")).where("n_open > 0")
