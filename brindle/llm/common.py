"""Shared folder, tables and file access for the operators of this package."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of sessions without the setting, by application.
_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset on a local
    master (tests) a temporary folder is made, as a cluster's nodes don't share one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="brindle-")
        root = _OWN[app]
    return root.rstrip("/")


#: Folders named since the driver began that were not removed, oldest first.
_MADE: list[str] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unused folder path below the shared folder (not yet created)."""
    _MADE.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def mark() -> int:
    """A point in time for :func:`remove_since`."""
    return len(_MADE)


def remove_since(spark: SparkSession, point: int, keep: DataFrame | None = None) -> None:
    """Delete the folders made since ``point``, those that ``keep`` reads excepted."""
    read = {f.rsplit("/", 1)[0].rstrip("/") for f in keep.inputFiles()} if keep is not None else set()
    bare = lambda p: p.split(":", 1)[-1].lstrip("/")
    read = {bare(r) for r in read}
    for path in _MADE[point:]:
        if not any(r == bare(path) or r.startswith(bare(path) + "/") for r in read):
            remove_dir(spark, path)


def unused(columns: list[str], name: str) -> str:
    """A column name like ``name`` that is none of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _MADE:
        _MADE.remove(path)


def replaced(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """``new``, which is written and doesn't read ``old`` any more; ``old``'s folder goes."""
    if old is not None:
        for folder in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
            remove_dir(new.sparkSession, folder)
    return new


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a URI or an absolute path; usable on executors."""
    return pafs.FileSystem.from_uri(uri)


#: Caches that operators keep in a worker process from task to task.
CACHES: list[dict] = []


#: Of the C library, where it has it: returns freed memory to the system.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return to the system what this process has freed.

    Arrow and the C library keep freed memory for later use: some 140 MB of a worker that
    encodes, which nothing else on the node can use while the worker lives.
    """
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def fresh_worker() -> None:
    """Drop what tasks of other operators have left in this worker process."""
    for cache in CACHES:
        cache.clear()
    give_back()


def documents(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def tasks(spark: SparkSession, work: int, each: int, most: int = 20_000) -> int:
    """A number of tasks for rows that make their task do much more work than their size tells.

    The adaptive planner sizes partitions by bytes, so such a shuffle must name its number.
    """
    return max(spark.sparkContext.defaultParallelism, min(most, -(-int(work) // each)))


def running_starts(totals: DataFrame, key: str, total: str, start: str) -> DataFrame:
    """Exclusive prefix sums of ``total`` in order of ``key``.

    ``totals`` has one row for each partition of a scan, so its size is bounded by
    the number of tasks and not by the number of rows; it may be broadcast.
    """
    rows, acc, out = totals.select(key, total).orderBy(key).collect(), 0, []
    for k, n in rows:
        out.append((k, acc))
        acc += n
    return totals.sparkSession.createDataFrame(out, f"{key} {totals.schema[key].dataType.simpleString()}, {start} long")


def groups(batches, keys: list[str]):
    """Tables of the rows with equal long ``keys``, from batches that are sorted by them."""
    import numpy as np

    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(columns[:, a].tolist())
            if key != held_key and held:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held_key, pa.Table.from_batches(held)
