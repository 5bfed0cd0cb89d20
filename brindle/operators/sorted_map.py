"""A sorted map as a folder of immutable, versioned runs.

Reads are DataFrames over one version; writes go in batches and publish the next
version.  The single-key methods exist for parity: each costs a Spark job, so
programs should use ``*_many`` and :meth:`SortedMap.apply`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..errors import InvalidKeyError
from ..functions.bounds import KeyRange, closed
from ..functions.keys import CODECS, codec_for, fixed_bytes
from ..plans.manifest import ManifestLog
from ..plans.order import latest_per_key
from ..plans.snapshots import key_from_json, range_to_json, resolve, write_run
from . import loading, lookups, model, replay


def _checked(df: DataFrame, config: Config) -> DataFrame:
    """``df``, whose keys must be 16 bytes if they are 128-bit numbers."""
    return fixed_bytes(df, "k", 16) if config.key_codec in ("u128", "i128") else df


class SortedMap:
    """Unique keys in ascending order.  ``version`` pins a snapshot; writes then fail."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None) -> None:
        self.spark, self.path, self._pinned = spark, path.rstrip("/"), version
        self.log = ManifestLog(spark, self.path)

    # Construction

    @classmethod
    def new(cls, spark: SparkSession, path: str, schema: str, config: Config | None = None) -> SortedMap:
        """An empty map; ``schema`` names the types of ``k`` and ``v``."""
        out = cls(spark, path)
        kind = T.StructType.fromDDL(schema)
        out._publish(-1, [], kind["k"].dataType, kind["v"].dataType, config or Config())
        return out

    @classmethod
    def bulk_load(cls, spark: SparkSession, path: str, df: DataFrame, config: Config | None = None) -> SortedMap:
        """From ``pos, k, v`` that ascend strictly; raises on empty or unsorted input."""
        loading.check(df)
        return cls._from(spark, path, df.select("k", "v"), (config or Config()).for_bulk_load())

    @classmethod
    def bulk_load_dedup(cls, spark: SparkSession, path: str, df: DataFrame, config: Config | None = None) -> SortedMap:
        """From ``pos, k, v`` that don't descend; the last value of a key wins."""
        return cls._from(spark, path, loading.bulk_load_dedup(df), (config or Config()).for_bulk_load())

    @classmethod
    def from_rows(cls, spark: SparkSession, path: str, df: DataFrame, config: Config | None = None) -> SortedMap:
        """From ``pos, k, v`` in any order of keys; the last position wins."""
        if not df.where("k IS NULL").isEmpty():
            raise InvalidKeyError("null")
        return cls._from(spark, path, loading.from_rows(df), config or Config())

    @classmethod
    def from_json(cls, spark: SparkSession, path: str, text: str, schema: str, config: Config | None = None) -> SortedMap:
        """From a JSON array of ``[k, v]``, which must be sorted unless empty."""
        from ..sources.json_pairs import parse_pairs

        if not json.loads(text):
            return cls.new(spark, path, schema, config)
        return cls.bulk_load_dedup(spark, path, parse_pairs(spark, text, schema), config)

    @classmethod
    def _from(cls, spark: SparkSession, path: str, df: DataFrame, config: Config) -> SortedMap:
        out = cls(spark, path)
        out._next(_checked(df, config).withColumn("deleted", F.lit(False)), config=config, base=[], kinds=(df.schema["k"].dataType, df.schema["v"].dataType))
        return out

    # Versions

    def _manifest(self) -> tuple[int, dict]:
        version = self.log.latest() if self._pinned is None else self._pinned
        if version is None:
            raise FileNotFoundError(f"no map at {self.path}")
        return version, self.log.read(version)

    def _schema(self, manifest: dict) -> T.StructType:
        return T.StructType([T.StructField("k", T._parse_datatype_json_string(manifest["k"])), T.StructField("v", T._parse_datatype_json_string(manifest["v"])), T.StructField("deleted", T.BooleanType())])

    def _publish(self, version: int, runs: list[dict], k: T.DataType, v: T.DataType, config: Config) -> None:
        if self._pinned is not None:
            raise RuntimeError("a pinned map can't be written")
        self.log.publish(version + 1, {"runs": runs, "k": k.json(), "v": v.json(), "config": asdict(config)})

    def _next(self, delta: DataFrame, config: Config | None = None, base: list[dict] | None = None, kinds=None) -> None:
        version = self.log.latest()
        if base is None:
            version, manifest = self._manifest()
            base, config = manifest["runs"], Config(**manifest["config"])
            schema = self._schema(manifest)
            kinds = (schema["k"].dataType, schema["v"].dataType)
        version = -1 if version is None else version
        run = write_run(delta, self.path, version + 1)
        runs = base + ([run] if run else [])
        self._publish(version, runs, *kinds, config)
        rows, gone = sum(r["rows"] for r in runs), sum(r["deleted"] for r in runs)
        if config.auto_rebuild and (len(runs) > config.rebuild_depth_threshold or rows and gone / rows > config.tombstone_ratio_threshold):
            self.rebuild()

    @property
    def config(self) -> Config:
        return Config(**self._manifest()[1]["config"])

    @property
    def version(self) -> int:
        return self._manifest()[0]

    def pin(self) -> SortedMap:
        """A view of the present version that later writes don't change."""
        return SortedMap(self.spark, self.path, self.version)

    guard = pin

    def vacuum(self, keep: int = 1) -> None:
        """Delete the versions but the last ``keep``, the runs that only they use, and scratch tables.

        Results of :meth:`apply` and pinned views that are still to be read need theirs.
        """
        self.log.files.delete(f"{self.path}/scratch")
        versions = self.log.versions()
        old, kept = versions[:-keep], versions[-keep:]
        used = {r["path"] for v in kept for r in self.log.read(v)["runs"]}
        for v in old:
            for r in self.log.read(v)["runs"]:
                if r["path"] not in used:
                    self.log.files.delete(r["path"])
            self.log.files.delete(self.log._name(v))

    # Reads

    def to_df(self, keys: KeyRange | None = None) -> DataFrame:
        """``k, v`` in no order, of all keys or of a range."""
        _, manifest = self._manifest()
        return resolve(self.spark, manifest["runs"], self._schema(manifest), keys)

    def get(self, key: Any) -> Any:
        """The value of one key, or None."""
        r = self.to_df(closed(key, key)).select("v").first()
        return None if r is None else r["v"]

    def get_many(self, probes: DataFrame) -> DataFrame:
        return lookups.get_many(self.to_df(), probes)

    def contains_key(self, key: Any) -> bool:
        return not self.to_df(closed(key, key)).isEmpty()

    def contains_many(self, probes: DataFrame) -> DataFrame:
        return lookups.contains(self.to_df(), probes)

    def missing_many(self, probes: DataFrame) -> DataFrame:
        return lookups.missing(self.to_df(), probes)

    def __len__(self) -> int:
        runs = self._manifest()[1]["runs"]
        return runs[0]["rows"] - runs[0]["deleted"] if len(runs) == 1 and not runs[0].get("hidden") else self.to_df().count()

    def is_empty(self) -> bool:
        return not self._manifest()[1]["runs"] or self.to_df().isEmpty()

    def __repr__(self) -> str:
        return f"SortedMap(len={len(self)})"

    def iter(self) -> DataFrame:
        return lookups.scan(self.to_df())

    def iter_sorted(self) -> list[tuple[Any, Any]]:
        return [tuple(r) for r in self.iter().collect()]

    def range(self, keys: KeyRange) -> DataFrame:
        return self.to_df(keys).orderBy("k")

    def range_count(self, keys: KeyRange) -> int:
        return self.to_df(keys).count()

    def first_key_value(self) -> tuple[Any, Any] | None:
        r = lookups.first_entry(self.to_df()).first()
        return None if r is None else tuple(r)

    def last_key_value(self) -> tuple[Any, Any] | None:
        r = lookups.last_entry(self.to_df()).first()
        return None if r is None else tuple(r)

    def allocated_bytes(self) -> int:
        """Bytes of the present version's files."""
        return sum(r["bytes"] for r in self._manifest()[1]["runs"])

    def tombstone_ratio(self) -> float:
        runs = self._manifest()[1]["runs"]
        rows = sum(r["rows"] for r in runs)
        return sum(r["deleted"] for r in runs) / rows if rows else 0.0

    def max_depth(self) -> int:
        """Levels of the placement tree over the present keys; 0 if there are none."""
        df, config = self.to_df(), self.config.for_bulk_load()
        codec = CODECS[config.key_codec] if config.key_codec else codec_for(df, "k")
        x = codec.model_input(F.col("k"))
        return model.max_depth(df.select(x.alias("x")), "x", self._table, config.expansion_factor, config.range_headroom)

    def _table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/scratch/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def to_json(self) -> str:
        from ..sources.json_pairs import pairs_to_json

        return pairs_to_json(self.to_df()).first()["json"]

    # Writes

    def apply(self, log: DataFrame) -> DataFrame:
        """Replay ``seq, op, k, v`` on the map and publish; the result of every operation.

        The map's own keys are narrowed to those of the log before the replay.
        """
        log = self._table(log.select("seq", "op", "k", "v"), "log")
        if not log.where("k IS NULL").isEmpty():
            raise InvalidKeyError("null")
        base = self.pin().to_df().join(log.select("k").distinct(), "k", "left_semi")
        rows = replay._marked(log, base).where("_gen = 1").withColumn("_at", F.col("seq"))
        last = latest_per_key(rows, "k", "_at", ["_after"]).where("_after IS NOT NULL")
        self._next(last.select("k", F.col("_after.v").alias("v"), (~F.col("_after.live")).alias("deleted")))
        return replay.results(log, base)

    def _put(self, key: Any, value: Any, deleted: bool = False) -> None:
        """Publish one row."""
        schema = self._schema(self._manifest()[1])
        self._next(_checked(self.spark.createDataFrame([(key, value, deleted)], schema), self.config))

    def insert(self, key: Any, value: Any) -> bool:
        """Put a value; whether the key was new."""
        if key is None:
            raise InvalidKeyError("null")
        new = not self.contains_key(key)
        self._put(key, value)
        return new

    def remove(self, key: Any) -> bool:
        """Delete a key; whether it was there."""
        there = self.contains_key(key)
        if there:
            self._put(key, None, deleted=True)
        return there

    def get_or_insert(self, key: Any, value: Any) -> Any:
        """The value of the key, which is ``value`` if it was new."""
        return self.get_or_insert_with(key, lambda: value)

    def get_or_insert_with(self, key: Any, make: Callable[[], Any]) -> Any:
        """The same; ``make`` is called only if the key is missing."""
        if key is None:
            raise InvalidKeyError("null")
        r = self.to_df(closed(key, key)).select("v").first()
        if r is not None:
            return r["v"]
        value = make()
        self._put(key, value)
        return value

    def extend(self, delta: DataFrame) -> None:
        """Upsert ``pos, k, v``; the last position of a key wins."""
        if not delta.where("k IS NULL").isEmpty():
            raise InvalidKeyError("null")
        self._next(_checked(loading.from_rows(delta), self.config).withColumn("deleted", F.lit(False)))

    def extend_pairs(self, pairs: Iterable[tuple[Any, Any]]) -> None:
        schema = self._schema(self._manifest()[1])
        row = T.StructType([T.StructField("pos", T.LongType()), schema["k"], schema["v"]])
        self.extend(self.spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs)], row))

    def remove_many(self, keys: DataFrame) -> None:
        """Delete all keys ``k`` of a frame."""
        kind = self._schema(self._manifest()[1])["v"].dataType
        self._next(keys.select("k").distinct().select("k", F.lit(None).cast(kind).alias("v"), F.lit(True).alias("deleted")))

    def clear(self) -> None:
        version, manifest = self._manifest()
        schema = self._schema(manifest)
        self._publish(version, [], schema["k"].dataType, schema["v"].dataType, Config(**manifest["config"]))

    def drain(self) -> DataFrame:
        """The sorted contents; the map is empty afterwards."""
        before = self.pin().iter()
        self.clear()
        return before

    def rebuild_range(self, keys: KeyRange) -> None:
        """Rewrite the keys of a range alone: as one run, older runs hiding theirs in the range.

        Where deletions or new versions crowd in one place this reads and writes that place only.
        """
        version, manifest = self._manifest()
        meets = lambda r: keys.may_meet(key_from_json(r["min"]), key_from_json(r["max"]))
        if not any(map(meets, manifest["runs"])):
            return
        schema = self._schema(manifest)
        live = resolve(self.spark, manifest["runs"], schema, keys)
        run = write_run(live.withColumn("deleted", F.lit(False)), self.path, version + 1)
        runs = [r | {"hidden": [*r.get("hidden", []), range_to_json(keys)]} if meets(r) else r for r in manifest["runs"]]
        self._publish(version, runs + ([run] if run else []), schema["k"].dataType, schema["v"].dataType, Config(**manifest["config"]))

    def rebuild(self) -> None:
        """Rewrite the same contents as one sorted run; nothing to do if empty."""
        version, manifest = self._manifest()
        if not manifest["runs"]:
            return
        schema = self._schema(manifest)
        run = write_run(resolve(self.spark, manifest["runs"], schema).withColumn("deleted", F.lit(False)), self.path, version + 1)
        self._publish(version, [run] if run else [], schema["k"].dataType, schema["v"].dataType, Config(**manifest["config"]))
