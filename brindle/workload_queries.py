"""Registered workloads: time series, mixed operations, gap filling, a feature store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.bounds import KeyRange
from .operators import replay
from .operators.sorted_map import SortedMap
from .plans import scratch
from .queries import _ORDERS, _orders
from .registry import query, table
from .stored_queries import _map

# Time series


@query("workload_append", "SELECT count(*) AS n, min(k) AS first, max(k) AS last FROM (SELECT epoch_us(ts) AS k FROM events UNION SELECT 1000000 + (SELECT max(epoch_us(ts)) FROM events) + event_id FROM events)")
def workload_append(spark, sf):
    """A map of a time series, and as many keys appended behind its last."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.unix_micros(F.col("ts").cast("timestamp")).alias("k"), F.col("value").alias("v"))
    m = SortedMap.from_rows(spark, scratch.folder(spark, "series"), rows)
    last = m.last_key_value()[0] if not m.is_empty() else 0
    m.extend(rows.withColumn("k", F.lit(last + 1_000_000) + F.col("pos")))
    return m.to_df().agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))


@query("workload_range_counts", "SELECT width, count(*) AS n FROM (SELECT unnest([10, 100, 1000]) AS width) JOIN orders ON o_orderkey >= 50 AND o_orderkey < 50 + width GROUP BY width")
def workload_range_counts(spark, sf):
    """Three ranges of the map in one scan."""
    k = F.col("o_orderkey")
    widths = F.explode(F.filter(F.array(*map(F.lit, (10, 100, 1000))), lambda w: k < 50 + w)).alias("width")
    return table(spark, sf, "orders").where((k >= 50) & (k < 1050)).select(widths).groupBy("width").agg(F.count(F.lit(1)).alias("n"))


@query("workload_range_and_write", f"SELECT (SELECT count(*) FROM {_ORDERS} WHERE k >= 500 AND k < 900) AS seen, (SELECT count(*) FROM {_ORDERS} WHERE k >= 500 AND k < 900) AS pinned, count(*) + (SELECT count(*) FROM events) AS n FROM orders")
def workload_range_and_write(spark, sf):
    """Ranges counted before and after writes behind the last key: the writes don't disturb them."""
    m = _map(spark, _orders(spark, sf))
    view, n = m.pin(), len(m)
    m.extend(table(spark, sf, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") + n).alias("k"), F.col("value").alias("v")))
    seen, pinned = m.range_count(KeyRange(500, 900)), view.range_count(KeyRange(500, 900))
    return spark.createDataFrame([(seen, pinned, len(m))], "seen long, pinned long, n long")


@query("workload_mixed", "SELECT op, flag, count(*) AS n FROM (SELECT 'get' AS op, (o_orderkey IS NOT NULL)::INT AS flag FROM (SELECT 2 * user_id AS k FROM events) LEFT JOIN orders ON o_orderkey = k UNION ALL SELECT 'insert', 1 FROM events) GROUP BY ALL")
def workload_mixed(spark, sf):
    """Reads, some of which miss, and inserts of new keys, by turns on one map."""
    m = _map(spark, _orders(spark, sf))
    n, events = len(m), table(spark, sf, "events")
    reads = events.select((2 * F.col("event_id")).alias("seq"), F.lit(replay.GET).alias("op"), (2 * F.col("user_id")).alias("k"), F.lit(None).cast("double").alias("v"))
    writes = events.select((2 * F.col("event_id") + 1).alias("seq"), F.lit(replay.INSERT).alias("op"), (2 * F.greatest(F.lit(n), F.lit(0)) + 1_000_000_000 + F.col("event_id")).alias("k"), F.col("value").alias("v"))
    return m.apply(reads.union(writes)).groupBy("op", "flag").agg(F.count(F.lit(1)).alias("n"))


@query("workload_random_insert", "SELECT p_partkey * 2654435761 % 50000 AS k, max_by(p_retailprice, p_partkey) AS v FROM part GROUP BY 1 ORDER BY k")
def workload_random_insert(spark, sf):
    """Scattered keys, some equal, put into an empty map."""
    m = SortedMap.new(spark, scratch.folder(spark, "map"), "k long, v double")
    m.extend(table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_partkey") * 2654435761 % 50000).alias("k"), F.col("p_retailprice").alias("v")))
    return m.iter()


@query("workload_gap_fill", "SELECT 2 * p_partkey AS k, p_retailprice AS v FROM part UNION ALL SELECT 2 * p_partkey + 1, -p_retailprice FROM part ORDER BY k")
def workload_gap_fill(spark, sf):
    """A bulk load of even keys, then the odd ones in between."""
    parts = table(spark, sf, "part")
    m = SortedMap.bulk_load(spark, scratch.folder(spark, "map"), parts.select(F.col("p_partkey").alias("pos"), (2 * F.col("p_partkey")).alias("k"), F.col("p_retailprice").alias("v")))
    m.extend(parts.select(F.col("p_partkey").alias("pos"), (2 * F.col("p_partkey") + 1).alias("k"), (-F.col("p_retailprice")).alias("v")))
    return m.iter()


@query("workload_basic_tour", "SELECT * FROM (VALUES ('after upserts', 3, 'a1', 'c'), ('after removal', 2, 'b', 'c'), ('range', 1, 'b', 'b')) AS t(step, n, first, last)")
def workload_basic_tour(spark, sf):
    """Insert, update, remove, iterate and range over string keys."""
    m = SortedMap.new(spark, scratch.folder(spark, "map"), "k string, v string")
    m.extend_pairs([("b", "b"), ("a", "a"), ("c", "c"), ("a", "a1")])
    told = [("after upserts", len(m), m.first_key_value()[1], m.last_key_value()[1])]
    m.remove("a")
    told.append(("after removal", len(m), m.first_key_value()[1], m.last_key_value()[1]))
    some = m.range(KeyRange("b", "c")).collect()
    told.append(("range", len(some), some[0]["v"], some[-1]["v"]))
    return spark.createDataFrame(told, "step string, n int, first string, last string")


# Feature store: five features a user, a label from their weighted sum

#: Weights of the features and the sum above which a user counts as converting (fixed values).
WEIGHTS, LABEL_ABOVE = (0.3, 0.2, 0.35, -0.1, 0.25), 0.35


def score(features: Column) -> Column:
    """The weighted sum of the first five features."""
    out = F.lit(0.0)
    for i, w in enumerate(WEIGHTS):
        out = out + F.get(features, F.lit(i)).cast("double") * F.lit(w)
    return out


_SCORE = "(0.0::DOUBLE" + "".join(f" + embedding[{i}]::DOUBLE * ({w})::DOUBLE" for i, w in enumerate(WEIGHTS, 1)) + ")"
_STORE = f"(SELECT vec_id AS k, {_SCORE} AS score, ({_SCORE} > {LABEL_ABOVE}::DOUBLE)::INT AS label FROM embeddings)"


def _features(spark, sf) -> SortedMap:
    """The store: a vector of features by user."""
    return _map(spark, table(spark, sf, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").alias("v")))


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", score(F.col("v"))).withColumn("label", (F.col("score") > LABEL_ABOVE).cast("int")).drop("v")


@query("feature_scores", f"SELECT k, score, label FROM {_STORE}")
def feature_scores(spark, sf):
    """Score and label of every user in the store."""
    return _scored(_features(spark, sf).to_df())


@query("feature_serving", f"SELECT e.event_id, e.user_id AS k, s.score, s.label, s.k IS NOT NULL AS found FROM events e LEFT JOIN {_STORE} s ON e.user_id = s.k")
def feature_serving(spark, sf):
    """A request for each event, served from the store by a batch look-up."""
    requests = table(spark, sf, "events").select("event_id", F.col("user_id").alias("k"))
    return _scored(_features(spark, sf).get_many(requests))


@query("feature_range_scan", f"SELECT k, score, label FROM {_STORE} WHERE k >= 100 AND k < 200 ORDER BY k")
def feature_range_scan(spark, sf):
    """A hundred users in order, scored from a range of the store."""
    return _scored(_features(spark, sf).range(KeyRange(100, 200)))


@query("feature_baseline", f"SELECT k, score, label FROM {_STORE} WHERE k >= 100 AND k < 200 ORDER BY k")
def feature_baseline(spark, sf):
    """The same from the unsorted table by a full scan, what the store is compared with."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").alias("v"))
    return _scored(rows).where((F.col("k") >= 100) & (F.col("k") < 200)).orderBy("k")


@query("feature_batch_lookup", "SELECT e.event_id, v.label FROM events e LEFT JOIN embeddings v ON e.user_id = v.vec_id")
def feature_batch_lookup(spark, sf):
    m = _map(spark, table(spark, sf, "embeddings").select(F.col("vec_id").alias("k"), F.col("label").alias("v")))
    return m.get_many(table(spark, sf, "events").select("event_id", F.col("user_id").alias("k"))).select("event_id", F.col("v").alias("label"))
