"""Continuous ingest of tab-separated text into a log-structured table.

Each micro-batch becomes one run and is committed with its number, so a batch that
Spark runs again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..operators.lsm import LsmTable
from ..sources import tsv


def tsv_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The lines of the files that arrive in a folder, with their places."""
    return spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")


def parse_batch(lines: DataFrame) -> DataFrame:
    """``pos, k, v`` of a micro-batch of :func:`tsv_stream`."""
    placed = lines.select("value", F.struct("file_path", "file_block_start", F.monotonically_increasing_id().alias("row")).alias("pos"))
    return tsv.parse(placed, keep=("pos",))


def ingest_stream(stream: DataFrame, table: str, checkpoint: str, name: str = "tsv", config: EngineConfig | None = None, **trigger) -> StreamingQuery:
    """Start the query; ``trigger`` as for ``DataStreamWriter.trigger``, by default all that is there."""

    def commit(batch: DataFrame, number: int) -> None:
        LsmTable(batch.sparkSession, table, config).ingest(parse_batch(batch), batch=f"{name}-{number}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
