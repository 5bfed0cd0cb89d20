"""Replay of an operation log ``seq, op, k, v`` with the result of each operation.

``op`` is ``insert`` (true if the key was new), ``remove`` (true if it was there),
``get_or_insert`` (never overwrites; the value then stored), ``get`` and
``contains``.  The whole log is replayed by window functions, without a loop.  ``seq`` must
be unique.

A key's operations are cut into ranges of ``seq`` of about equal numbers of operations, so
that a key with most of the log is spread over as many tasks as any.  A range's windows tell
all that its own operations decide; what it begins with, whether the key is there and with
which value, is a prefix over one row for each key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSERT, REMOVE, GET_OR_INSERT, GET, CONTAINS = "insert", "remove", "get_or_insert", "get", "contains"


def _ranges(log: DataFrame) -> list:
    """Ends of ranges of ``seq`` with about as many operations each as there are shuffle partitions."""
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return []
    cuts = log.agg(F.percentile_approx("seq", F.array(*[F.lit(i / n) for i in range(1, n)]), 10_000).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def _marked(log: DataFrame, base: DataFrame | None) -> DataFrame:
    """The log, the base's rows as inserts before it, with ``_present`` before each operation and the states around it."""
    cuts = _ranges(log)
    part = F.lit(0) if not cuts else F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("seq")))
    rows = log.select("seq", "op", "k", "v", F.lit(1).alias("_gen"), part.cast("int").alias("_part"))
    if base is not None:
        start = base.select(F.lit(None).cast(log.schema["seq"].dataType).alias("seq"), F.lit(INSERT).alias("op"), "k", "v", F.lit(0).alias("_gen"), F.lit(-1).alias("_part"))
        rows = start.unionByName(rows)
    rows = rows.repartition("k", "_part")
    before = Window.partitionBy("k", "_part").orderBy("_gen", "seq").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("k", "_part").orderBy("_gen", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range

    def begins(df: DataFrame, state: Column, name: str) -> DataFrame:
        """``df`` with the last ``state`` of the ranges before each row's own."""
        last = df.groupBy("k", "_part").agg(F.max_by(state, F.when(state.isNotNull(), F.struct("_gen", "seq"))).alias("_last"))
        told = last.select("k", "_part", F.last("_last", ignorenulls=True).over(earlier).alias(name))
        return df.join(told, ["k", "_part"])

    state = F.when(F.col("op").isin(INSERT, GET_OR_INSERT), 1).when(F.col("op") == REMOVE, 0)
    rows = begins(rows, state, "_begin")
    rows = rows.withColumn("_present", F.coalesce(F.last(state, ignorenulls=True).over(before), "_begin", F.lit(0))).drop("_begin")
    writes = (F.col("op") == INSERT) | (F.col("op") == GET_OR_INSERT) & (F.col("_present") == 0)
    event = F.when(writes, F.struct(F.lit(True).alias("live"), F.col("v").alias("v"))).when(F.col("op") == REMOVE, F.struct(F.lit(False).alias("live"), F.lit(None).cast(log.schema["v"].dataType).alias("v")))
    rows = begins(rows.withColumn("_event", event), F.col("_event"), "_begin")
    around = lambda w: F.coalesce(F.last("_event", ignorenulls=True).over(w), "_begin")
    return rows.withColumn("_before", around(before)).withColumn("_after", around(upto)).drop("_event", "_begin", "_part")


def results(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """``seq, op, k, flag, value``: what each operation returned.

    ``flag`` is 1 or 0 as in the module's text; ``value`` is the value seen by ``get``
    and the one stored after ``get_or_insert``, else null.
    """
    rows = _marked(log, base).where("_gen = 1")
    flag = F.when(F.col("op") == INSERT, 1 - F.col("_present")).otherwise(F.col("_present"))
    seen = F.when((F.col("op") == GET) & F.col("_before.live"), F.col("_before.v")).when(F.col("op") == GET_OR_INSERT, F.col("_after.v"))
    return rows.select("seq", "op", "k", flag.cast("int").alias("flag"), seen.alias("value"))


def final_state(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """``k, v`` of the keys that the log leaves."""
    rows = _marked(log, base)
    last = rows.groupBy("k").agg(F.max_by("_after", F.struct("_gen", "seq")).alias("s"))
    return last.where("s.live").select("k", F.col("s.v").alias("v"))
