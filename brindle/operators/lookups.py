"""Point and ordered access to a frame of unique keys ``k`` with values ``v``.

Everything is a plain DataFrame expression; predicates reach the Parquet scan and
batch look-ups are joins that the planner may broadcast or sort.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounds import KeyRange


def get(df: DataFrame, key: Any) -> DataFrame:
    """The values of one key."""
    return df.where(F.col("k") == F.lit(key)).select("v")


def get_many(df: DataFrame, probes: DataFrame) -> DataFrame:
    """Each probe ``k`` with its value, null where there is none, and ``found``."""
    return probes.join(df.select("k", "v", F.lit(True).alias("_hit")), "k", "left").select(*probes.columns, "v", F.coalesce("_hit", F.lit(False)).alias("found"))


def contains(df: DataFrame, probes: DataFrame) -> DataFrame:
    """The probes whose key is there."""
    return probes.join(df.select("k"), "k", "left_semi")


def missing(df: DataFrame, probes: DataFrame) -> DataFrame:
    """The probes whose key isn't there."""
    return probes.join(df.select("k"), "k", "left_anti")


def scan(df: DataFrame) -> DataFrame:
    return df.orderBy("k")


def in_range(df: DataFrame, keys: KeyRange) -> DataFrame:
    return df.where(keys.predicate(F.col("k"))).orderBy("k")


def range_count(df: DataFrame, keys: KeyRange) -> DataFrame:
    return df.where(keys.predicate(F.col("k"))).agg(F.count(F.lit(1)).alias("n"))


def first_entry(df: DataFrame) -> DataFrame:
    return bottom_k(df, 1)


def last_entry(df: DataFrame) -> DataFrame:
    return top_k(df, 1)


def bottom_k(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("k").limit(n)


def top_k(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("k")).limit(n)


def length(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def is_empty(df: DataFrame) -> DataFrame:
    return df.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty"))
