"""Tab-separated lines: key, first tab, value.

Lines end at ``\\n``, one ``\\r`` before it is dropped; blank lines and lines without
a tab are skipped; the value keeps further tabs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _bare(line: Column) -> Column:
    return F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def parse(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and text columns ``k, v`` of the accepted lines."""
    rows = lines.select(*keep, _bare(F.col(column)).alias("_line")).where(F.instr("_line", "\t") > 0)
    tab = F.instr("_line", "\t")
    return rows.select(*keep, F.substring(F.col("_line"), F.lit(1), tab - 1).alias("k"), F.substring(F.col("_line"), tab + 1, F.length("_line")).alias("v"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``pos, k, v`` of a file or folder; ``pos`` follows the files' names and the lines' order."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return parse(raw.select("value", F.struct("file_path", "file_block_start", "row").alias("pos")), keep=("pos",))


def split_lines(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, ``line_no`` (from 0) and ``value`` of the lines in a text column."""
    return df.select(*keep, F.posexplode(F.split(F.col(column), "\n")).alias("line_no", "value"))
