"""Runs of sorted rows and the frames that resolve them.

A run is a folder of Parquet files, range-partitioned and sorted by key, with
columns ``k``, ``v`` and ``deleted``.  Its entry in a manifest has what is needed to
skip it: rows, deleted rows, extreme keys, bytes, and the commit that wrote it.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bounds import UNBOUNDED, Bound, KeyRange
from .manifest import Files
from .order import latest_per_key


def key_to_json(key: Any) -> Any:
    if isinstance(key, (bytes, bytearray)):
        return {"b": base64.b64encode(bytes(key)).decode()}
    if isinstance(key, decimal.Decimal):
        return {"d": str(key)}
    if isinstance(key, datetime.datetime):
        return {"t": key.isoformat()}
    return key


def key_from_json(x: Any) -> Any:
    if not isinstance(x, dict):
        return x
    if "b" in x:
        return base64.b64decode(x["b"])
    return decimal.Decimal(x["d"]) if "d" in x else datetime.datetime.fromisoformat(x["t"])


def range_to_json(keys: KeyRange) -> list:
    """The ends of a range, each a key and whether it belongs to it, or None."""
    return [[key_to_json(b.key), b.included] if b.bounded else None for b in keys.ends()]


def range_from_json(ends: list) -> KeyRange:
    return KeyRange(*(UNBOUNDED if e is None else Bound(key_from_json(e[0]), e[1]) for e in ends))


def write_run(df: DataFrame, root: str, seq: int, **more: Any) -> dict | None:
    """Write ``k, v, deleted`` as a run and return its entry; None (and no files) if there are no rows."""
    spark = df.sparkSession
    path = f"{root}/runs/{uuid.uuid4().hex}"
    df.select("k", "v", "deleted").repartitionByRange("k").sortWithinPartitions("k").write.parquet(path)
    r = spark.read.schema(df.select("k", "v", "deleted").schema).parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("deleted").cast("long")).alias("d"), F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    files = Files(spark, root)
    if not r["n"]:
        files.delete(path)
        return None
    return {"path": path, "seq": seq, "rows": r["n"], "deleted": r["d"], "min": key_to_json(r["lo"]), "max": key_to_json(r["hi"]), "bytes": files.size(path)} | more


def resolve(spark: SparkSession, runs: list[dict], schema, keys: KeyRange | None = None, keep_deleted: bool = False) -> DataFrame:
    """``k, v`` (and ``deleted``) as the newest run of each key has them.

    Runs that can't meet ``keys`` are never opened; a single run without deletions is
    a bare scan.
    """
    if keys is not None:
        runs = [r for r in runs if keys.may_meet(key_from_json(r["min"]), key_from_json(r["max"]))]
    columns = ["k", "v", "deleted"] if keep_deleted else ["k", "v"]
    if not runs:
        return spark.createDataFrame([], schema).select(*columns)

    def read(run: dict) -> DataFrame:
        df = spark.read.schema(schema).parquet(run["path"])
        for ends in run.get("hidden", []):  # ranges that a newer run has taken over
            df = df.where(~range_from_json(ends).predicate(F.col("k")))
        return df if keys is None else df.where(keys.predicate(F.col("k")))

    if len(runs) == 1:
        df = read(runs[0])
        return df.select(*columns) if keep_deleted or not runs[0]["deleted"] else df.where("NOT deleted").select("k", "v")
    union = None
    for run in runs:
        part = read(run).withColumn("_seq", F.lit(run["seq"]).cast("long"))
        union = part if union is None else union.unionByName(part)
    newest = latest_per_key(union, "k", "_seq", ["v", "deleted"])
    return newest.select(*columns) if keep_deleted else newest.where("NOT deleted").select("k", "v")
