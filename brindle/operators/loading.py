"""Building maps from positioned rows ``pos, k, v``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyDataError, InvalidKeyError, NotSortedError
from ..plans.order import latest_per_key, order_violations


def check(df: DataFrame, strict: bool = True) -> None:
    """Raise what a bulk load of ``df`` must raise."""
    r = order_violations(df, "pos", "k", strict).first()
    if r["n"] == 0:
        raise EmptyDataError
    if r["n_null"]:
        raise InvalidKeyError("null")
    if r["n_violations"]:
        raise NotSortedError


def bulk_load(df: DataFrame) -> DataFrame:
    """``k, v`` of rows that must ascend strictly; a repeated key is an error."""
    check(df)
    return df.select("k", "v")


def bulk_load_dedup(df: DataFrame) -> DataFrame:
    """``k, v`` of rows that must not descend; the last value of a key wins."""
    check(df, strict=False)
    return from_rows(df)


def from_rows(df: DataFrame) -> DataFrame:
    """``k, v`` of rows in any order of keys; the last position of a key wins."""
    return latest_per_key(df.where(F.col("k").isNotNull()), "k", "pos", ["v"])


def extend(base: DataFrame, delta: DataFrame) -> DataFrame:
    """``base`` (``k, v``) with the rows of ``delta`` (``pos, k, v``) put in, the last of a key winning."""
    rows = base.select("k", "v", F.lit(None).cast(delta.schema["pos"].dataType).alias("pos"), F.lit(0).alias("gen")).unionByName(delta.select("k", "v", "pos", F.lit(1).alias("gen")))
    return latest_per_key(rows.withColumn("_at", F.struct("gen", "pos")), "k", "_at", ["v"])


def get_or_insert(base: DataFrame, delta: DataFrame) -> DataFrame:
    """``base`` with those keys of ``delta`` that it lacks; of several rows the first wins."""
    rows = base.select("k", "v", F.lit(None).cast(delta.schema["pos"].dataType).alias("pos"), F.lit(0).alias("gen")).unionByName(delta.select("k", "v", "pos", F.lit(1).alias("gen")))
    return rows.groupBy("k").agg(F.min_by("v", F.struct("gen", "pos")).alias("v"))
