"""Connected components of edge tables, by rounds of joins.

Large-star and small-star rounds (Kiveris et al. 2014) over edges that each task
first thins to a forest of its own.  A node in a third of all edges is one row
for each partition where its least neighbour is sought, and the join that tells
its neighbours may be split by the adaptive planner.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that a task holds at once while it thins them.
HELD = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the edges (a, b), roots left out."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _thin(batches):
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch.column("a").to_numpy()]), np.concatenate([b, batch.column("b").to_numpy()])
        if len(a) >= HELD:
            x, y = forest(a, b)
            if len(x) > HELD // 2:
                yield pa.record_batch([pa.array(x), pa.array(y)], ["a", "b"])
                x, y = x[:0], y[:0]
            a, b = x, y
    x, y = forest(a, b)
    yield pa.record_batch([pa.array(x), pa.array(y)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node reachable from each node that has an edge and isn't that root.

    ``edges`` has long columns ``a`` and ``b`` without nulls; loops and repeats don't matter.
    """
    edges = common.materialise(edges.where("a <> b").mapInArrow(_thin, "a long, b long").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select("a", "b", "m")
        small = small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        edges = common.replaced(common.materialise(small.where("a <> b").distinct(), "edges"), edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
