"""Neighbours in a global order without a global sort in one task."""

from __future__ import annotations

import math
import re

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:/+"


def with_previous(df: DataFrame, order: list[str], columns: list[str], buckets: int | None = None) -> DataFrame:
    """``df`` with ``prev_<c>`` for each of ``columns`` and ``is_first``.

    ``order[0]`` must be numeric and is cut into ``buckets`` (by default as many as
    shuffle partitions) of about equal size at its approximate quantiles, so the one
    shuffle and the window are by bucket.  The first row of a bucket takes its neighbour
    from a table with one row a bucket.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = F.col(order[0]).cast("double")
    fractions = F.array(*[F.lit(i / buckets) for i in range(1, buckets)]) if buckets > 1 else F.array(F.lit(0.5))
    cuts = df.agg(F.percentile_approx(x, fractions, 10_000).alias("c")).first()["c"] or []
    splits = [float("-inf"), *sorted({c for c in cuts if math.isfinite(c)}), float("inf")]
    placed = df.withColumn("_x", x)
    if len(splits) < 3:
        placed = placed.withColumn("_bucket", F.lit(0.0)).drop("_x")
    else:
        placed = Bucketizer(splits=splits, inputCol="_x", outputCol="_bucket", handleInvalid="keep").transform(placed).drop("_x")
    w = Window.partitionBy("_bucket").orderBy(*order)
    held = F.struct(*columns)
    inner = placed.withColumn("_prev", F.lag(held).over(w)).withColumn("_rank", F.row_number().over(w))
    key = F.struct(*order)
    last = placed.groupBy("_bucket").agg(F.max_by(held, key).alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(Window.orderBy("_bucket"))).select("_bucket", "_carry")
    joined = inner.join(F.broadcast(carried), "_bucket")
    prev = F.when(F.col("_rank") == 1, F.col("_carry")).otherwise(F.col("_prev"))
    return joined.select(*df.columns, *[prev[c].alias(f"prev_{c}") for c in columns], (prev.isNull()).alias("is_first"))


def file_positions(df: DataFrame) -> DataFrame:
    """A frame read from files with ``pos``: the place of each row in the order of the files' names and rows."""
    # Spark gives one file's path with one or three slashes behind its scheme.
    names = sorted(re.sub(_SCHEME, "/", f) for f in df.inputFiles())
    names = df.sparkSession.createDataFrame(list(enumerate(names)), "_file long, _name string")
    placed = df.select("*", F.regexp_replace("_metadata.file_path", _SCHEME, "/").alias("_name"), F.col("_metadata.row_index").alias("_row"))
    return placed.join(names, "_name").select((F.shiftleft("_file", 40) + F.col("_row")).alias("pos"), *df.columns)


def order_violations(df: DataFrame, pos: str, key: str, strict: bool = True) -> DataFrame:
    """One row: ``n``, ``n_null``, and ``n_violations`` of ascending key order along ``pos``."""
    near = with_previous(df.select(pos, key), [pos], [key])
    bad: Column = (F.col(f"prev_{key}") >= F.col(key)) if strict else (F.col(f"prev_{key}") > F.col(key))
    return near.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(key).isNull().cast("long")), F.lit(0)).alias("n_null"), F.coalesce(F.sum((~F.col("is_first") & bad).cast("long")), F.lit(0)).alias("n_violations"))


def latest_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key.

    An aggregate and not a window: partial aggregation leaves one row for each key and
    task, so that a key with a third of all rows costs no more than any other.
    """
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])
