"""Registered queries over stored maps, sets and log-structured tables.

Each writes its own store to a fresh folder and goes through the operators' public
methods; nothing here repeats what an operator does.  Table keys are numbers as text.
"""

from __future__ import annotations

from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .config import Config, EngineConfig
from .functions import keys as K
from .functions.bounds import KeyRange, closed
from .operators.lsm import SCHEMA as LSM_SCHEMA
from .operators.lsm import LsmTable
from .operators.sorted_map import SortedMap
from .operators.sorted_set import SortedSet
from .plans import scratch
from .plans.order import file_positions
from .queries import _BASE, _LOG, _ORDERS, _base, _fit_sql, _log, _orders
from .registry import query, table
from .sources import sstable, wal
from .sources.json_pairs import pairs_to_json
from .streaming.ingest import ingest_stream, tsv_stream

# Maps


def _map(spark, rows: DataFrame, config: Config | None = None) -> SortedMap:
    """A stored map of ``k, v``."""
    return SortedMap.from_rows(spark, scratch.folder(spark, "map"), rows.select(F.lit(0).alias("pos"), "k", "v"), config)


def _one_row(spark, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


@query("map_empty", "SELECT 0::BIGINT AS n, TRUE AS is_empty, 'SortedMap(len=0)' AS repr, 2.0::DOUBLE AS expansion_factor, TRUE AS auto_rebuild")
def map_empty(spark, sf):
    """A new map has no entries and the default settings."""
    m = SortedMap.new(spark, scratch.folder(spark, "map"), "k long, v string")
    return _one_row(spark, "n long, is_empty boolean, repr string, expansion_factor double, auto_rebuild boolean", len(m), m.is_empty(), repr(m), m.config.expansion_factor, m.config.auto_rebuild)


@query("map_with_config", "SELECT count(*) AS n, 1.5::DOUBLE AS expansion_factor, 1.0::DOUBLE AS range_headroom, FALSE AS auto_rebuild FROM orders")
def map_with_config(spark, sf):
    """A bulk load keeps the settings it was given, through JSON, and leaves room."""
    config = Config.from_json(Config(expansion_factor=1.5, range_headroom=0.5, auto_rebuild=False).to_json())
    rows = file_positions(table(spark, sf, "orders")).select("pos", F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    m = SortedMap.bulk_load(spark, scratch.folder(spark, "map"), rows, config)
    return _one_row(spark, "n long, expansion_factor double, range_headroom double, auto_rebuild boolean", len(m), m.config.expansion_factor, m.config.range_headroom, m.config.auto_rebuild)


@query("map_bulk_load", f"SELECT k, v FROM {_ORDERS} ORDER BY k")
def map_bulk_load(spark, sf):
    """A validated bulk load of the orders in the file's order, read back in the keys'."""
    rows = file_positions(table(spark, sf, "orders")).select("pos", F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return SortedMap.bulk_load(spark, scratch.folder(spark, "map"), rows).iter()


@query("map_iter_sorted", "SELECT n_nationkey::BIGINT AS k, n_name AS v FROM nation")
def map_iter_sorted(spark, sf):
    m = _map(spark, table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v")))
    return spark.createDataFrame(m.iter_sorted(), "k long, v string")


@query("map_json", "SELECT '[' || string_agg('[' || n_nationkey || ',\"' || n_name || '\"]', ',' ORDER BY n_nationkey) || ']' AS json FROM nation")
def map_json(spark, sf):
    """A map made from JSON writes the same JSON."""
    text = pairs_to_json(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))).first()["json"]
    m = SortedMap.from_json(spark, scratch.folder(spark, "map"), text, "k int, v string")
    return _one_row(spark, "json string", m.to_json())


@query("map_single_operations", "SELECT * FROM (VALUES (1, 'insert', 'true'), (2, 'insert again', 'false'), (3, 'get', 'B'), (4, 'remove', 'true'), (5, 'get_or_insert_with', 'made'), (6, 'get_or_insert_with again', 'made'), (7, 'contains_key', 'true'), (8, 'len', (SELECT count(*) + 1 FROM region)::VARCHAR)) AS t(step, operation, result)")
def map_single_operations(spark, sf):
    """What the single-key methods return on a map of the regions."""
    m = _map(spark, table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("v")))
    told = [m.insert(-1, "A"), m.insert(-1, "B"), m.get(-1), m.remove(-1), m.get_or_insert_with(-2, lambda: "made"), m.get_or_insert_with(-2, lambda: "not made"), m.contains_key(-2), len(m)]
    names = ["insert", "insert again", "get", "remove", "get_or_insert_with", "get_or_insert_with again", "contains_key", "len"]
    return spark.createDataFrame([(i, n, str(x).lower() if isinstance(x, bool) else str(x)) for i, (n, x) in enumerate(zip(names, told), 1)], "step int, operation string, result string")


@query("remove_keys", f"SELECT k, v FROM {_ORDERS} o WHERE k NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def remove_keys(spark, sf):
    m = _map(spark, _orders(spark, sf))
    m.remove_many(table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")))
    return m.to_df()


@query("map_statistics", f"WITH gone AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT (SELECT count(*) FROM {_ORDERS} WHERE k NOT IN (SELECT k FROM gone)) AS n, (SELECT count(*) FROM gone)::DOUBLE / ((SELECT count(*) FROM orders) + (SELECT count(*) FROM gone)) AS tombstone_ratio, TRUE AS has_bytes")
def map_statistics(spark, sf):
    """Length, share of deletions among all stored rows, and whether the files have a size."""
    m = _map(spark, _orders(spark, sf), Config(auto_rebuild=False))
    m.remove_many(table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")))
    return _one_row(spark, "n long, tombstone_ratio double, has_bytes boolean", len(m), m.tombstone_ratio(), m.allocated_bytes() > 0)


@query("map_auto_rebuild", f"SELECT k, v, 1 AS runs FROM {_ORDERS} WHERE k >= (SELECT count(*) * 3 // 5 FROM orders)")
def map_auto_rebuild(spark, sf):
    """Deleting the lower three fifths passes the threshold of deletions: the map rewrites itself as one run."""
    orders = _orders(spark, sf)
    m = _map(spark, orders, Config(tombstone_ratio_threshold=0.3))
    n = len(m)
    m.remove_many(orders.where(F.col("k") < n * 3 // 5).select("k"))
    return m.to_df().withColumn("runs", F.lit(len(m._manifest()[1]["runs"])))


@query("map_rebuild", f"SELECT k, v, 2 AS before, 1 AS after FROM {_ORDERS} WHERE k NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def map_rebuild(spark, sf):
    """Two runs become one with the same contents."""
    m = _map(spark, _orders(spark, sf), Config(auto_rebuild=False))
    m.remove_many(table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")))
    before = len(m._manifest()[1]["runs"])
    m.rebuild()
    return m.to_df().select("k", "v", F.lit(before).alias("before"), F.lit(len(m._manifest()[1]["runs"])).alias("after"))


@query("map_rebuild_range", f"SELECT k, v FROM {_ORDERS} WHERE k NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY k")
def map_rebuild_range(spark, sf):
    """Only a range of the keys is rewritten; the contents stay."""
    m = _map(spark, _orders(spark, sf), Config(auto_rebuild=False))
    m.remove_many(table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")))
    m.rebuild_range(KeyRange(100, 900))
    return m.iter()


@query("map_clear", "SELECT 0::BIGINT AS n, count(*) AS pinned FROM orders")
def map_clear(spark, sf):
    """A cleared map is empty; a view that was pinned before still has everything."""
    m = _map(spark, _orders(spark, sf))
    view = m.pin()
    m.clear()
    return _one_row(spark, "n long, pinned long", len(m), len(view))


@query("map_drain", f"SELECT k, v, 0::BIGINT AS n_left FROM {_ORDERS} ORDER BY k")
def map_drain(spark, sf):
    m = _map(spark, _orders(spark, sf))
    return m.drain().withColumn("n_left", F.lit(len(m)).cast("long"))


@query("map_max_depth", f"SELECT CASE WHEN conflicts = 0 THEN 1 END AS depth, (SELECT count(*) FROM orders) AS n FROM ({_fit_sql('SELECT o_orderkey::DOUBLE AS x FROM orders', 2.0, 1.0)})")
def map_max_depth(spark, sf):
    """Evenly spaced keys need one level: their model has no conflicts."""
    m = _map(spark, _orders(spark, sf))
    return _one_row(spark, "depth int, n long", m.max_depth(), len(m))


_WIDE = "printf('%016X%016X', o_custkey, o_orderkey)"


@query("map_u128", f"SELECT {_WIDE} AS k, o_totalprice AS v FROM orders WHERE o_custkey >= 10 AND o_custkey < 40 ORDER BY k")
def map_u128(spark, sf):
    """Unsigned 128-bit keys, customer above order, and a range of customers."""
    key = F.unhex(F.concat(F.lpad(F.hex("o_custkey"), 16, "0"), F.lpad(F.hex("o_orderkey"), 16, "0")))
    m = _map(spark, table(spark, sf, "orders").select(key.alias("k"), F.col("o_totalprice").alias("v")), Config(key_codec="u128"))
    return m.range(KeyRange(K.encode_u128(10 << 64), K.encode_u128(40 << 64))).select(F.hex("k").alias("k"), "v")


@query("map_i128", "SELECT c_custkey, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 1 ORDER BY c_custkey DESC")
def map_i128(spark, sf):
    """Signed 128-bit keys: odd customers are stored under their negated key, which sorts before zero."""
    sign = lambda k: F.when(k < 0, F.lit("7FFFFFFFFFFFFFFF")).otherwise(F.lit("8000000000000000"))  # noqa: E731  the upper half, its sign bit flipped
    k = F.when(F.col("c_custkey") % 2 == 1, -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    key = F.unhex(F.concat(sign(k), F.lpad(F.hex(k), 16, "0")))
    m = _map(spark, table(spark, sf, "customer").select(key.alias("k"), F.struct("c_custkey", F.col("c_acctbal").alias("v")).alias("v")), Config(key_codec="i128"))
    return m.range(KeyRange(None, K.encode_i128(0))).select("v.c_custkey", "v.v")


# The operation log on a stored map

_START = f"{_LOG.replace('FROM events', f'FROM events UNION ALL SELECT -1 AS seq, k, v, {chr(39)}insert{chr(39)} AS op FROM {_BASE}')}"


@query("stored_map_apply", f"WITH {_START} SELECT k, after.v AS v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM seen) WHERE r = 1 AND after.live")
def stored_map_apply(spark, sf):
    """The whole log applied to a stored map of all customers, its contents read back."""
    m = _map(spark, _base(spark, sf))
    m.apply(_log(spark, sf))
    return m.iter()


@query("stored_map_apply_log", f"WITH {_START} SELECT seq, op, k, (CASE WHEN op = 'insert' THEN 1 - present ELSE present END)::INT AS flag, CASE WHEN op = 'get' AND prior.live THEN prior.v WHEN op = 'get_or_insert' THEN after.v END AS value FROM seen WHERE seq >= 0")
def stored_map_apply_log(spark, sf):
    """What each operation of the log returned."""
    return _map(spark, _base(spark, sf)).apply(_log(spark, sf))


# Sets


def _set(spark, keys: DataFrame) -> SortedSet:
    return SortedSet.from_rows(spark, scratch.folder(spark, "set"), keys)


def _partkeys(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"))


@query("set_distinct", "SELECT DISTINCT l_partkey AS k FROM lineitem")
def set_distinct(spark, sf):
    return _set(spark, _partkeys(spark, sf)).range()


@query("set_range", "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey >= 10 AND l_partkey < 60 ORDER BY k")
def set_range(spark, sf):
    return _set(spark, _partkeys(spark, sf)).range(KeyRange(10, 60))


@query("set_first_last", "SELECT min(l_partkey) AS first, max(l_partkey) AS last, count(DISTINCT l_partkey) AS n, FALSE AS is_empty FROM lineitem")
def set_first_last(spark, sf):
    s = _set(spark, _partkeys(spark, sf))
    return _one_row(spark, "first long, last long, n long, is_empty boolean", s.first(), s.last(), len(s), s.is_empty())


@query("set_extend", "SELECT l_partkey AS k FROM lineitem UNION SELECT p_partkey FROM part")
def set_extend(spark, sf):
    s = _set(spark, _partkeys(spark, sf))
    s.extend_rows(table(spark, sf, "part").select(F.col("p_partkey").alias("k")))
    return s.range()


@query("set_contains", "SELECT p_partkey AS k, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS found FROM part")
def set_contains(spark, sf):
    s = _set(spark, table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("k")))
    return s.contains_many(table(spark, sf, "part").select(F.col("p_partkey").alias("k")))


@query("set_bulk_load", "SELECT DISTINCT ts AS k FROM events ORDER BY k")
def set_bulk_load(spark, sf):
    """The times of the events, which ascend with repeats."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("ts").alias("k"))
    return SortedSet.bulk_load(spark, scratch.folder(spark, "set"), rows).range()


@query("set_single_operations", "SELECT * FROM (VALUES (1, 'insert', TRUE), (2, 'insert again', FALSE), (3, 'contains', TRUE), (4, 'remove', TRUE), (5, 'remove again', FALSE), (6, 'contains', FALSE), (7, 'is_empty', FALSE)) AS t(step, operation, result)")
def set_single_operations(spark, sf):
    s = _set(spark, table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("k")))
    told = [("insert", s.insert(-1)), ("insert again", s.insert(-1)), ("contains", s.contains(-1)), ("remove", s.remove(-1)), ("remove again", s.remove(-1)), ("contains", s.contains(-1)), ("is_empty", s.is_empty())]
    return spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(told, 1)], "step int, operation string, result boolean")


@query("set_pin", "SELECT count(*) AS pinned, count(*) + 3 AS now FROM nation")
def set_pin(spark, sf):
    """A pinned set doesn't see later members."""
    s = _set(spark, table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k")))
    view = s.pin()
    s.extend([-1, -2, -3, -3])
    return _one_row(spark, "pinned long, now long", len(view), len(s))


@query("set_stored_json", "SELECT '[' || string_agg(DISTINCT n_regionkey, ',' ORDER BY n_regionkey) || ']' AS json FROM nation")
def set_stored_json(spark, sf):
    s = SortedSet.from_json(spark, scratch.folder(spark, "set"), str([r[0] for r in table(spark, sf, "nation").select("n_regionkey").collect()]), "int")
    return _one_row(spark, "json string", s.to_json())


@query("stored_set", "SELECT DISTINCT user_id AS k FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) ORDER BY k")
def stored_set(spark, sf):
    s = _set(spark, table(spark, sf, "events").select(F.col("user_id").alias("k")))
    s.remove_many(table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("k")))
    return s.range()


# Log-structured tables

#: Three runs by event number, the one of level 0 the newest; errors delete.
_RUNS = "SELECT event_id % 3 AS level, event_id, user_id AS k, CASE WHEN event_type <> 'error' THEN value END AS v, event_type = 'error' AS deleted FROM events"
_NEWEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level, event_id DESC) AS r FROM ({_RUNS})) WHERE r = 1"


def _table(spark, **config) -> LsmTable:
    return LsmTable(spark, scratch.folder(spark, "table"), EngineConfig(**config))


def _bytes(c: str):
    return F.encode(F.col(c).cast("string"), "UTF-8").alias(c)


def _decoded(df: DataFrame, key: str = "long", value: str = "double") -> DataFrame:
    return df.select(F.decode("k", "UTF-8").cast(key).alias("k"), F.decode("v", "UTF-8").cast(value).alias("v"))


def _runs(spark, sf) -> DataFrame:
    dead = F.col("event_type") == "error"
    rows = table(spark, sf, "events").select((F.col("event_id") % 3).alias("level"), F.col("event_id").alias("pos"), F.col("user_id").alias("k"), F.when(~dead, F.col("value")).alias("v"))
    return rows.select("level", "pos", _bytes("k"), _bytes("v"))


def _three_runs(spark, sf) -> LsmTable:
    t, rows = _table(spark), _runs(spark, sf)
    for level in (2, 1, 0):
        t.ingest(rows.where(F.col("level") == level))
    return t


@query("lsm_resolve", f"SELECT k, v FROM ({_NEWEST}) WHERE NOT deleted")
def lsm_resolve(spark, sf):
    return _decoded(_three_runs(spark, sf).to_df())


@query("lsm_tombstones", f"SELECT k FROM ({_NEWEST}) WHERE deleted")
def lsm_tombstones(spark, sf):
    return _three_runs(spark, sf).resolved().where("deleted").select(F.decode("k", "UTF-8").cast("long").alias("k"))


@query("lsm_manifest", f"SELECT level, count(*) AS rows, sum(deleted::BIGINT)::BIGINT AS deleted, min(k::VARCHAR) AS min_key, max(k::VARCHAR) AS max_key FROM (SELECT *, row_number() OVER (PARTITION BY level, k ORDER BY event_id DESC) AS r FROM ({_RUNS})) WHERE r = 1 GROUP BY level")
def lsm_manifest(spark, sf):
    """The runs as the manifest has them after the table is opened anew."""
    again = LsmTable(spark, _three_runs(spark, sf).path).manifest_df()
    newest_first = F.row_number().over(Window.orderBy(F.desc("seq"))) - 1  # three rows
    return again.select(newest_first.cast("long").alias("level"), "rows", "deleted", F.decode("min_key", "UTF-8").alias("min_key"), F.decode("max_key", "UTF-8").alias("max_key"))


@query("lsm_compact", "SELECT user_id AS k, value AS v, FALSE AS deleted, 1 AS level FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def lsm_compact(spark, sf):
    """All events in four batches: the fourth fills level 0, whose merge leaves one run at level 1 without deletions."""
    t, rows = _table(spark), _runs(spark, sf)
    last = (rows.agg(F.max("pos")).first()[0] or 0) + 1
    for i in range(4):
        t.ingest(rows.where((F.col("pos") >= last * i // 4) & (F.col("pos") < last * (i + 1) // 4)))
    parts = [_decoded(spark.read.schema(LSM_SCHEMA).parquet(r["path"])).select("k", "v", F.lit(r["deleted"] > 0).alias("deleted"), F.lit(r["level"]).alias("level")) for r in t.runs()]
    return reduce(DataFrame.unionByName, parts)


@query("lsm_compact_levels", f"SELECT level, k, v, deleted FROM (SELECT *, row_number() OVER (PARTITION BY level, k ORDER BY event_id DESC) AS r FROM ({_RUNS})) WHERE r = 1 AND NOT (deleted AND level = 2)")
def lsm_compact_levels(spark, sf):
    """Every level of all events, two runs each, merged by the table; only the oldest level drops its deletions."""
    t, rows = _table(spark), _runs(spark, sf)
    middle = (rows.agg(F.max("pos")).first()[0] or 0) // 2
    for level in (2, 1, 0):
        part = rows.where(F.col("level") == level)
        t.ingest(part.where(F.col("pos") <= middle))
        t.ingest(part.where(F.col("pos") > middle))
        for n in range(level + 1):
            t.compact_level(n)
    parts = [spark.read.schema(LSM_SCHEMA).parquet(r["path"]).select(F.lit(r["level"] - 1).cast("long").alias("level"), F.decode("k", "UTF-8").cast("long").alias("k"), F.decode("v", "UTF-8").cast("double").alias("v"), "deleted") for r in t.runs()]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "level long, k long, v double, deleted boolean"))


_NATIONS = "SELECT n_nationkey::VARCHAR AS k, n_name AS v FROM nation"


def _nations(spark, sf) -> list[tuple[bytes, bytes]]:
    """The nations as pairs of bytes."""
    return [(str(r["n_nationkey"]).encode(), r["n_name"].encode()) for r in table(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]


@query("lsm_put_get", "SELECT * FROM (VALUES ('buffered', 'one'), ('deleted', NULL), ('flushed', 'one'), ('overwritten', 'two'), ('unknown', NULL), ('reopened', 'two')) AS t(state, value)")
def lsm_put_get(spark, sf):
    """What a key reads as while it is buffered, deleted, flushed, overwritten, and after reopening."""
    t, told = _table(spark), []
    read = lambda state, k: told.append((state, v.decode() if (v := t.get(k)) is not None else None))
    t.put(b"a", b"one")
    read("buffered", b"a")
    t.delete(b"a")
    read("deleted", b"a")
    t.put(b"a", b"one")
    t.flush()
    read("flushed", b"a")
    t.put(b"a", b"two")
    read("overwritten", b"a")
    read("unknown", b"b")
    t.flush()
    t = LsmTable(spark, t.path)
    read("reopened", b"a")
    return spark.createDataFrame(told, "state string, value string")


@query("lsm_flush_reopen", f"SELECT k, v, 1 AS runs FROM ({_NATIONS}) WHERE k <> '7'")
def lsm_flush_reopen(spark, sf):
    """Puts and a deletion, flushed to one run, in a table that is opened anew."""
    t = _table(spark)
    t.ingest_iter(_nations(spark, sf))
    t.delete(b"7")
    t.flush()
    t.flush()  # nothing to do
    again = LsmTable(spark, t.path)
    return _decoded(again.to_df(), "string", "string").withColumn("runs", F.lit(len(again.runs())))


@query("lsm_reopen_log", f"SELECT k, v, 0 AS runs FROM ({_NATIONS}) WHERE k NOT IN ('3', '4')")
def lsm_reopen_log(spark, sf):
    """Writes that were never flushed are found in the log, with either kind of buffer."""
    t = _table(spark)
    t.ingest_iter(_nations(spark, sf))
    t.delete(b"3")
    t.put(b"4", b"")
    again = LsmTable(spark, t.path, EngineConfig(memtable="sorted"))
    return _decoded(again.scan(), "string", "string").withColumn("runs", F.lit(len(again.runs())))


@query("lsm_auto_flush", "SELECT n_nationkey::VARCHAR AS k, n_name AS v, TRUE AS flushed FROM nation")
def lsm_auto_flush(spark, sf):
    """A buffer of 150 bytes flushes itself on the way; levels are merged as they fill."""
    t = _table(spark, flush_threshold=150, memtable="sorted")
    t.ingest_iter(_nations(spark, sf))
    return _decoded(t.to_df(), "string", "string").withColumn("flushed", F.lit(len(t.runs()) > 0 and t.memtable.approximate_bytes() < 150))


@query("lsm_ingest_sorted", "SELECT c_name AS k, c_mktsegment AS v FROM customer")
def lsm_ingest_sorted(spark, sf):
    """Customers in the order of their zero-padded names, straight to a run."""
    t = _table(spark)
    t.put(b"Customer#000000001", b"overwritten by the later ingest")
    t.ingest_sorted(table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.encode("c_name", "UTF-8").alias("k"), F.encode("c_mktsegment", "UTF-8").alias("v")))
    return _decoded(t.to_df(), "string", "string")


@query("lsm_scan_range", "SELECT c_name AS k, c_mktsegment AS v FROM customer WHERE c_name >= 'Customer#000000010' AND c_name < 'Customer#00000005' ORDER BY k")
def lsm_scan_range(spark, sf):
    t = _table(spark)
    t.ingest(table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.encode("c_name", "UTF-8").alias("k"), F.encode("c_mktsegment", "UTF-8").alias("v")))
    return _decoded(t.scan(KeyRange(b"Customer#000000010", b"Customer#00000005")), "string", "string")


@query("lsm_get_many", "SELECT l_orderkey AS k, o_totalprice AS v FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def lsm_get_many(spark, sf):
    t = _table(spark)
    t.ingest(table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")).select("pos", _bytes("k"), _bytes("v")))
    return _decoded(t.get_many(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).select(_bytes("k"))))


@query("wal_source", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS seq, 'insert' AS op, n_nationkey::VARCHAR AS k, n_name AS v FROM nation UNION ALL SELECT (SELECT count(*) FROM nation), 'remove', '5', NULL")
def wal_source(spark, sf):
    """The log files of a table as a source, in the order of the writes."""
    spark.dataSource.register(wal.WalDataSource)
    t = _table(spark)
    t.ingest_iter(_nations(spark, sf))
    t.delete(b"5")
    rows = spark.read.format("kvwal").option("path", f"{t.path}/wal").load()
    seq = F.row_number().over(Window.orderBy("file", "seq")) - 1  # a buffer's writes
    return rows.select(seq.cast("long").alias("seq"), "op", F.decode("k", "UTF-8").alias("k"), F.decode("v", "UTF-8").alias("v"))


_TABLE_LATEST = "SELECT user_id::VARCHAR AS k, event_type AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1"


@query("stored_table_ingest", f"SELECT k, v FROM ({_TABLE_LATEST}) WHERE v <> 'error'")
def stored_table_ingest(spark, sf):
    """Five batches of events, an empty value deleting; compaction merges four of the runs on the way."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.encode(F.col("user_id").cast("string"), "UTF-8").alias("k"), F.encode(F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")), "UTF-8").alias("v"))
    t = _table(spark)
    last = (rows.agg(F.max("pos")).first()[0] or 0) + 1
    for i in range(5):
        t.ingest(rows.where((F.col("pos") >= last * i // 5) & (F.col("pos") < last * (i + 1) // 5)))
    return _decoded(t.to_df(), "string", "string")


@query("stored_table_stream", "SELECT user_id::VARCHAR AS k, (event_type || chr(9) || event_id) AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def stored_table_stream(spark, sf):
    """Events written as tab-separated text, in files whose names ascend, streamed into a table, and read back."""
    folder = scratch.folder(spark, "tsv")
    lines = table(spark, sf, "events").select("event_id", F.concat_ws("\t", "user_id", "event_type", "event_id").alias("value"))
    lines.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("value").write.text(f"{folder}/in")
    ingest_stream(tsv_stream(spark, f"{folder}/in"), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return _decoded(LsmTable(spark, f"{folder}/table").to_df(), "string", "string")


# Sorted string tables


def _sst(spark, sf) -> str:
    """Customers written as sorted string tables."""
    spark.dataSource.register(sstable.SstDataSource)
    path = scratch.folder(spark, "sst")
    rows = table(spark, sf, "customer").select(F.encode("c_name", "UTF-8").alias("k"), F.encode("c_mktsegment", "UTF-8").alias("v"))
    rows.repartitionByRange("k").sortWithinPartitions("k").write.format("sst").option("path", path).mode("append").save()
    return path


def _between(df: DataFrame, lo: str, hi: str) -> DataFrame:
    return df.where((F.col("k") >= F.encode(F.lit(lo), "UTF-8")) & (F.col("k") < F.encode(F.lit(hi), "UTF-8")))


_SOME = "SELECT c_name AS k, c_mktsegment AS v FROM customer WHERE c_name >= 'Customer#000000010' AND c_name < 'Customer#00000005'"


@query("sst_round_trip", "SELECT c_name AS k, c_mktsegment AS v FROM customer")
def sst_round_trip(spark, sf):
    return _decoded(sstable.load(spark, _sst(spark, sf)), "string", "string")


@query("sst_pruned_range", _SOME)
def sst_pruned_range(spark, sf):
    """A key range whose filters reach the source, which skips blocks by their first keys."""
    back = sstable.load(spark, _sst(spark, sf))
    return _decoded(_between(back, "Customer#000000010", "Customer#00000005"), "string", "string")


@query("sst_point_get", "SELECT c_name AS k, c_mktsegment AS v FROM customer WHERE c_custkey IN (7, 77, 777) UNION ALL SELECT 'Customer#x', NULL")
def sst_point_get(spark, sf):
    """Single keys from the tables' block indexes, without a scan."""
    fs, path = sstable.open_fs(_sst(spark, sf))
    readers = [sstable.TableReader(fs.open_input_file(x.path)) for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".sst")]
    names = [r["c_name"] for r in table(spark, sf, "customer").where("c_custkey IN (7, 77, 777)").select("c_name").collect()]
    found = {n: next((v for r in readers if (v := r.get(n.encode())) is not None), None) for n in [*names, "Customer#x"]}
    return spark.createDataFrame([(k, v.decode() if v is not None else None) for k, v in found.items()], "k string, v string")
