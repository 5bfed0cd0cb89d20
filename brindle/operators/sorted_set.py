"""A sorted set: a sorted map without values."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.bounds import KeyRange
from .sorted_map import SortedMap


def _valued(df: DataFrame) -> DataFrame:
    return df.select(*df.columns, F.lit(True).alias("v"))


class SortedSet:
    def __init__(self, inner: SortedMap) -> None:
        self.map = inner

    @classmethod
    def new(cls, spark: SparkSession, path: str, key_type: str, config: Config | None = None) -> SortedSet:
        return cls(SortedMap.new(spark, path, f"k {key_type}, v boolean", config))

    @classmethod
    def bulk_load(cls, spark: SparkSession, path: str, df: DataFrame, config: Config | None = None) -> SortedSet:
        """From ``pos, k`` that don't descend; repeats are dropped; raises if empty."""
        return cls(SortedMap.bulk_load_dedup(spark, path, _valued(df), config))

    @classmethod
    def from_rows(cls, spark: SparkSession, path: str, df: DataFrame, config: Config | None = None) -> SortedSet:
        return cls(SortedMap.from_rows(spark, path, _valued(df.select("k").withColumn("pos", F.lit(0))), config))

    @classmethod
    def from_json(cls, spark: SparkSession, path: str, text: str, key_type: str) -> SortedSet:
        """From a JSON array of keys in any order."""
        out = cls.new(spark, path, key_type)
        if keys := json.loads(text):
            out.extend(keys)
        return out

    def to_json(self) -> str:
        from ..sources.json_pairs import keys_to_json

        return keys_to_json(self.map.to_df()).first()["json"]

    def insert(self, key: Any) -> bool:
        return self.map.insert(key, True)

    def remove(self, key: Any) -> bool:
        return self.map.remove(key)

    def contains(self, key: Any) -> bool:
        return self.map.contains_key(key)

    def __len__(self) -> int:
        return len(self.map)

    def is_empty(self) -> bool:
        return self.map.is_empty()

    def range(self, keys: KeyRange = KeyRange()) -> DataFrame:
        return self.map.range(keys).select("k")

    def first(self) -> Any:
        r = self.map.to_df().agg(F.min("k")).first()
        return r[0]

    def last(self) -> Any:
        r = self.map.to_df().agg(F.max("k")).first()
        return r[0]

    def extend(self, keys: Iterable[Any]) -> None:
        self.map.extend_pairs((k, True) for k in keys)

    def extend_rows(self, keys: DataFrame) -> None:
        """Add the keys ``k`` of a frame."""
        self.map.extend(_valued(keys.select("k").withColumn("pos", F.lit(0))))

    def remove_many(self, keys: DataFrame) -> None:
        """Delete the keys ``k`` of a frame."""
        self.map.remove_many(keys)

    def contains_many(self, probes: DataFrame) -> DataFrame:
        """Every row of ``probes`` (``k``) with whether its key is a member, ``found``."""
        return self.map.get_many(probes).drop("v")

    def pin(self) -> SortedSet:
        return SortedSet(self.map.pin())

    guard = pin
