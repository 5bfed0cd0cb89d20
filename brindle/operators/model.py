"""Placement models: the linear model with the fewest conflicts, and tree statistics.

A model sends a key's input ``x`` to slot ``round(slope * x + intercept)``, kept
within the array.  Keys are sorted and models monotonic, so a conflict is a key in
its predecessor's slot.  Keys with one input are first counted and become one row, so that
no value is too frequent; the rows get their predecessor, are written once, and all 33
candidate models are judged in one aggregate, a sum for each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import scratch
from ..plans.order import with_previous

#: Slopes tried besides the interpolation (fixed value).
CANDIDATES = 32
EPSILON = 2.0**-52


def slot(x: Column, slope: Column, intercept: Column, size: Column) -> Column:
    """Rounded half away from zero and clamped to the array.

    The bounds are whole, so clamping may come first; what is left is not negative and is
    rounded by its exact fraction, which is far cheaper than the decimal ``round``.
    """
    at = F.greatest(F.least(slope * x + intercept, (size - 1).cast("double")), F.lit(0.0))
    whole = F.floor(at)
    return whole + (at - whole >= 0.5).cast("long")


def split_slot(ordinal: Column, midpoint: Column, size: Column) -> Column:
    """A model with a midpoint: the first slot up to it, else the last."""
    return F.when(ordinal <= midpoint, F.lit(0).cast("long")).otherwise((size - 1).cast("long"))


@dataclass(frozen=True)
class Model:
    slope: float
    intercept: float
    size: int
    conflicts: int
    candidate: int | None

    def slot(self, x: Column) -> Column:
        return slot(x, F.lit(self.slope), F.lit(self.intercept), F.lit(self.size))


def array_size(n: Column, expansion: float, headroom: float) -> Column:
    return F.greatest(F.ceil(n.cast("double") * F.lit(float(expansion)) * F.lit(1.0 + headroom)), n).cast("long")


def _candidates(stats: DataFrame, headroom: float) -> DataFrame:
    """``stats`` (n, lo, hi, gap, size) with arrays ``slopes`` and ``intercepts``; a null slope isn't tried."""
    span = F.col("hi") - F.col("lo")
    top = (F.col("size") - 1).cast("double")
    first = F.try_divide(top, span * F.lit(1.0 + headroom))
    rest = F.transform(F.sequence(F.lit(1), F.lit(CANDIDATES)), lambda j: F.when((F.col("gap") > EPSILON) & (F.try_divide(j.cast("double"), F.col("gap")) <= F.try_divide(top, span)), F.try_divide(j.cast("double"), F.col("gap"))))
    out = stats.withColumn("slopes", F.concat(F.array(first), rest))
    return out.withColumn("intercepts", F.transform("slopes", lambda s: F.lit(0.0) - s * F.col("lo")))


def _judged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``_b``, the candidate with the fewest conflicts, the earliest of equals.

    ``rows`` carry ``x``, its number ``m``, ``prev_x``, ``head``, ``size`` and the candidates.
    Each candidate is a sum of its own, so rows aren't multiplied before the aggregate.
    """
    def conflicts(j: int) -> Column:
        # :func:`slot` of a key and of the one before, as text, of which 33 are planned much faster than built.
        at = lambda x: f"greatest(least(slopes[{j}] * {x} + intercepts[{j}], CAST(size - 1 AS double)), 0D)"
        whole = lambda x: f"(floor({at(x)}) + CAST({at(x)} - floor({at(x)}) >= 0.5D AS long))"
        return F.expr(f"sum(IF(head, 0L, CAST({whole('x')} = {whole('prev_x')} AS long)))").alias(f"c{j}")

    counts = rows.groupBy(*keys).agg(F.any_value("slopes").alias("slopes"), F.any_value("intercepts").alias("intercepts"), F.sum(F.col("m") - 1).alias("again"), *map(conflicts, range(CANDIDATES + 1)))
    tried = F.expr("array(" + ", ".join(f"IF(slopes[{j}] IS NOT NULL, named_struct('conflicts', again + c{j}, 'candidate', {j}, 'slope', slopes[{j}], 'intercept', intercepts[{j}]), NULL)" for j in range(CANDIDATES + 1)) + ")")
    return counts.select(*keys, F.array_min(F.filter(tried, lambda c: c.isNotNull())).alias("_b"))


def _weighed(df: DataFrame, x: str, buckets: int | None = None) -> DataFrame:
    """``x, m, prev_x, head``: each different input, how many keys have it, and the one before."""
    # Zeros of either sign are one input.
    counted = df.select((F.col(x).cast("double") + F.lit(0.0)).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("m"))
    return with_previous(counted, ["x"], ["x"], buckets).withColumnRenamed("is_first", "head")


def fit(df: DataFrame, x: str, expansion: float = 2.0, headroom: float = 0.0, buckets: int | None = None) -> DataFrame:
    """One row ``n, slope, intercept, size, conflicts, candidate`` for the inputs in column ``x``; none if empty.

    One key gives the constant model of size 1; equal inputs all go to the middle.
    ``candidate`` is 0 for the interpolation, null where no slope was needed.
    """
    if expansion < 1.0:
        raise ValueError(f"expansion_factor must be >= 1.0, got {expansion}")
    if headroom < 0.0:
        raise ValueError(f"range_headroom must be >= 0, got {headroom}")
    rows = scratch.table(_weighed(df, x, buckets), "model-inputs")
    stats = rows.agg(F.sum("m").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.coalesce(F.max(F.col("x") - F.col("prev_x")), F.lit(0.0)).alias("gap")).where("n > 0")
    stats = _candidates(stats.withColumn("size", F.when(F.col("n") == 1, F.lit(1).cast("long")).otherwise(array_size(F.col("n"), expansion, headroom))), headroom)
    judged = _judged(rows.crossJoin(F.broadcast(stats)), ["n"])  # stats is one row
    best = stats.join(F.broadcast(judged), "n", "left")
    single, equal = F.col("n") == 1, (F.col("hi") - F.col("lo")) < EPSILON
    return best.select(
        "n",
        F.when(single | equal, 0.0).otherwise(F.col("_b.slope")).alias("slope"),
        F.when(single, 0.0).when(equal, F.floor(F.col("size") / 2).cast("double")).otherwise(F.col("_b.intercept")).alias("intercept"),
        "size",
        F.when(single, F.lit(0).cast("long")).when(equal, F.col("n") - 1).otherwise(F.col("_b.conflicts")).alias("conflicts"),
        F.when(~single & ~equal, F.col("_b.candidate")).alias("candidate"),
    )


def fit_model(df: DataFrame, x: str, expansion: float = 2.0, headroom: float = 0.0) -> Model:
    r = fit(df, x, expansion, headroom).first()
    if r is None:
        raise ValueError("keys must be non-empty")
    return Model(r["slope"], r["intercept"], r["size"], r["conflicts"], r["candidate"])


def degenerate_depth(m: int) -> int:
    """Levels of a balanced split of ``m`` keys that share their input."""
    return max(1, math.ceil(math.log2(m))) if m > 1 else 1


def max_depth(df: DataFrame, x: str, table, expansion: float = 2.0, headroom: float = 1.0) -> int:
    """Levels of the tree that a bulk load builds over the inputs in column ``x``.

    Every round fits a model in each node at once and keeps the keys that share a slot;
    the neighbour of a key never changes, so it is sought once.  ``table(df, name)``
    must write a frame and return it read back, which cuts the lineage of each round.
    """
    rows = table(_weighed(df, x).select(F.lit(0).cast("long").alias("node"), "x", "m", "prev_x", "head"), "model-level")
    deepest, level = 0, 0
    while True:
        stats = rows.groupBy("node").agg(F.sum("m").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.coalesce(F.max(F.when(~F.col("head"), F.col("x") - F.col("prev_x"))), F.lit(0.0)).alias("gap"))
        stats = table(stats, "model-nodes")
        equal = (F.col("n") > 1) & (F.col("hi") - F.col("lo") < EPSILON)
        found = stats.agg(F.count(F.lit(1)).alias("nodes"), F.max(F.when(equal, F.col("n"))).alias("most")).first()
        if not found["nodes"]:
            return deepest
        deepest = max(deepest, level + 1, level + degenerate_depth(found["most"]) if found["most"] else 0)
        open_nodes = _candidates(stats.where(~equal & (F.col("n") > 1)).withColumn("size", array_size(F.col("n"), expansion, headroom)), headroom)
        joined = rows.join(open_nodes, "node")
        best = open_nodes.join(_judged(joined, ["node"]).where("_b.conflicts > 0").select("node", "_b"), "node")
        placed = rows.join(best.select("node", "size", F.col("_b.slope").alias("slope"), F.col("_b.intercept").alias("intercept")), "node")
        at = lambda c: slot(F.col(c), F.col("slope"), F.col("intercept"), F.col("size"))
        placed = placed.withColumn("s", at("x")).withColumn("head", F.col("head") | (F.col("s") != at("prev_x")))
        placed = placed.select(F.xxhash64("node", "s", F.lit(level)).alias("node"), "x", "m", "prev_x", "head")
        shared = placed.groupBy("node").agg(F.sum("m").alias("n")).where("n > 1").select("node")
        rows = table(placed.join(shared, "node", "left_semi"), "model-level")
        level += 1
