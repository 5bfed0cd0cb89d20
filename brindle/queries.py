"""The registered queries over the star-schema tables and their SQL.

``orders`` by ``o_orderkey`` is the map of record, ``lineitem`` the probe side,
``events`` (position and sequence ``event_id``, key ``user_id``) the operation log,
``customer`` the one with string keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys as K
from .functions.bounds import KeyRange, closed, excluded, included
from .operators import loading, lookups, model, replay
from .plans.order import file_positions, order_violations
from .registry import QUERIES, SQL, query, table
from .sources import json_pairs, tsv

__all__ = ["QUERIES", "SQL", "flagship"]


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_name").alias("k"), F.col("c_custkey").alias("v"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("k"), F.col("value").alias("v"))


#: Half of these probes miss: the keys and as many beyond them.
def _probes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k0"), F.col("l_linenumber").alias("line")).select(F.when(F.col("line") % 2 == 0, F.col("k0")).otherwise(-F.col("k0") - 1).alias("k"))


_PROBES = "(SELECT CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey ELSE -l_orderkey - 1 END AS k FROM lineitem)"
_ORDERS = "(SELECT o_orderkey AS k, o_totalprice AS v FROM orders)"

# Point and batch access


@query("map_get", "SELECT o_totalprice AS v FROM orders WHERE o_orderkey = 100")
def map_get(spark, sf):
    return lookups.get(_orders(spark, sf), 100)


@query("map_get_batch", f"SELECT p.k, o.v, o.k IS NOT NULL AS found FROM {_PROBES} p LEFT JOIN {_ORDERS} o ON p.k = o.k")
def map_get_batch(spark, sf):
    return lookups.get_many(_orders(spark, sf), _probes(spark, sf))


@query("contains_semi", f"SELECT k FROM {_PROBES} p WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = p.k)")
def contains_semi(spark, sf):
    return lookups.contains(_orders(spark, sf), _probes(spark, sf))


@query("missing_anti", f"SELECT k FROM {_PROBES} p WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = p.k)")
def missing_anti(spark, sf):
    return lookups.missing(_orders(spark, sf), _probes(spark, sf))


@query("len", "SELECT count(*) AS n FROM orders")
def length(spark, sf):
    return lookups.length(_orders(spark, sf))


@query("is_empty", "SELECT count(*) = 0 AS is_empty FROM orders")
def is_empty(spark, sf):
    return lookups.is_empty(_orders(spark, sf))


# Ranges

_RANGES = {
    "range_half_open": (KeyRange(100, 200), "k >= 100 AND k < 200"),
    "range_incl": (closed(100, 200), "k BETWEEN 100 AND 200"),
    "range_excl": (KeyRange(excluded(100), excluded(200)), "k > 100 AND k < 200"),
    "range_excl_start": (KeyRange(excluded(100), included(200)), "k > 100 AND k <= 200"),
    "range_from": (KeyRange(1200), "k >= 1200"),
    "range_to": (KeyRange(None, 300), "k < 300"),
    "range_to_incl": (KeyRange(None, included(300)), "k <= 300"),
    "range_full": (KeyRange(), "TRUE"),
    "range_reversed": (KeyRange(200, 100), "FALSE"),
}
for _name, (_range, _where) in _RANGES.items():
    query(_name, f"SELECT k, v FROM {_ORDERS} WHERE {_where} ORDER BY k")(lambda spark, sf, r=_range: lookups.in_range(_orders(spark, sf), r))


@query("range_count", f"SELECT count(*) AS n FROM {_ORDERS} WHERE k BETWEEN 100 AND 999")
def range_count(spark, sf):
    return lookups.range_count(_orders(spark, sf), closed(100, 999))


@query("range_string", "SELECT c_name AS k, c_custkey AS v FROM customer WHERE c_name >= 'Customer#000000010' AND c_name < 'Customer#00000005' ORDER BY k")
def range_string(spark, sf):
    return lookups.in_range(_names(spark, sf), KeyRange("Customer#000000010", "Customer#00000005"))


@query("iter", f"SELECT k, v FROM {_ORDERS} ORDER BY k")
def iterate(spark, sf):
    return lookups.scan(_orders(spark, sf))


@query("iter_string_keys", "SELECT c_name AS k, c_custkey AS v FROM customer ORDER BY k")
def iter_string_keys(spark, sf):
    return lookups.scan(_names(spark, sf))


@query("first_entry", f"SELECT k, v FROM {_ORDERS} ORDER BY k LIMIT 1")
def first_entry(spark, sf):
    return lookups.first_entry(_orders(spark, sf))


@query("last_entry", f"SELECT k, v FROM {_ORDERS} ORDER BY k DESC LIMIT 1")
def last_entry(spark, sf):
    return lookups.last_entry(_orders(spark, sf))


@query("bottom_k", f"SELECT k, v FROM {_ORDERS} ORDER BY k LIMIT 25")
def bottom_k(spark, sf):
    return lookups.bottom_k(_orders(spark, sf), 25)


@query("top_k", f"SELECT k, v FROM {_ORDERS} ORDER BY k DESC LIMIT 25")
def top_k(spark, sf):
    return lookups.top_k(_orders(spark, sf), 25)


# Loading

_VIOLATIONS = "SELECT count(*) AS n, coalesce(sum((k IS NULL)::BIGINT), 0)::BIGINT AS n_null, coalesce(sum((p {op} k)::BIGINT), 0)::BIGINT AS n_violations FROM (SELECT {k} AS k, lag({k}) OVER (ORDER BY {pos}) AS p FROM {t})"


@query("bulk_load_check", "SELECT count(*) AS n, 0::BIGINT AS n_null, 0::BIGINT AS n_violations FROM orders")
def bulk_load_check(spark, sf):
    """The keys in the order of the file's rows, which ascends."""
    return order_violations(file_positions(table(spark, sf, "orders")).withColumnRenamed("o_orderkey", "k"), "pos", "k")


_DAY = "epoch_us(date_trunc('day', o_orderdate)) // 86400000000 * 10000000000"


@query("bulk_load_check_arrival", _VIOLATIONS.format(op=">=", k="o_orderkey", pos=f"{_DAY} + o_orderkey", t="orders"))
def bulk_load_check_arrival(spark, sf):
    """The keys in the order in which the orders arrived, day by day: not sorted."""
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    return order_violations(table(spark, sf, "orders").select((day * 10_000_000_000 + F.col("o_orderkey")).alias("pos"), F.col("o_orderkey").alias("k")), "pos", "k")


@query("bulk_load_check_unsorted", _VIOLATIONS.format(op=">=", k="user_id", pos="event_id", t="events"))
def bulk_load_check_unsorted(spark, sf):
    return order_violations(_events(spark, sf), "pos", "k")


@query("bulk_load_check_dedup", _VIOLATIONS.format(op=">", k="ts", pos="event_id", t="events"))
def bulk_load_check_dedup(spark, sf):
    return order_violations(table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("ts").alias("k")), "pos", "k", strict=False)


@query("bulk_load", f"SELECT k, v FROM {_ORDERS}")
def bulk_load(spark, sf):
    return loading.bulk_load(file_positions(table(spark, sf, "orders")).select("pos", F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")))


@query("dedup_keep_last", "SELECT ts AS k, v FROM (SELECT ts, value AS v, row_number() OVER (PARTITION BY ts ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def dedup_keep_last(spark, sf):
    return loading.bulk_load_dedup(table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("ts").alias("k"), F.col("value").alias("v")))


_LAST = "(SELECT user_id AS k, value AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1)"
_BASE = "(SELECT c_custkey AS k, c_acctbal AS v FROM customer)"


def _base(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))


@query("from_iter_last_wins", f"SELECT k, v FROM {_LAST}")
def from_iter_last_wins(spark, sf):
    return loading.from_rows(_events(spark, sf))


@query("extend_upsert", f"SELECT coalesce(l.k, b.k) AS k, CASE WHEN l.k IS NOT NULL THEN l.v ELSE b.v END AS v FROM {_BASE} b FULL JOIN {_LAST} l ON b.k = l.k")
def extend_upsert(spark, sf):
    return loading.extend(_base(spark, sf), _events(spark, sf))


_FIRST = "(SELECT user_id AS k, value AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1)"


@query("get_or_insert", f"SELECT coalesce(b.k, f.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.v ELSE f.v END AS v FROM {_BASE} b FULL JOIN {_FIRST} f ON b.k = f.k")
def get_or_insert(spark, sf):
    return loading.get_or_insert(_base(spark, sf), _events(spark, sf))


# Replay

_OPS = {"view": replay.GET, "error": replay.REMOVE, "click": replay.GET_OR_INSERT}
_LOG = """
    log AS (
        SELECT event_id AS seq, user_id AS k, value AS v,
               CASE event_type WHEN 'view' THEN 'get' WHEN 'error' THEN 'remove' WHEN 'click' THEN 'get_or_insert' ELSE 'insert' END AS op
        FROM events
    ), marked AS (
        SELECT *, coalesce(last_value(CASE WHEN op IN ('insert', 'get_or_insert') THEN 1 WHEN op = 'remove' THEN 0 END IGNORE NULLS)
                           OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS present
        FROM log
    ), changed AS (
        SELECT *, CASE WHEN op = 'insert' OR op = 'get_or_insert' AND present = 0 OR op = 'remove' THEN {'live': op <> 'remove', 'v': CASE WHEN op <> 'remove' THEN v END} END AS event FROM marked
    ), seen AS (
        SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
               last_value(event IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after
        FROM changed
    )
"""


def _log(spark, sf):
    op = F.lit(replay.INSERT)
    for kind, name in _OPS.items():
        op = F.when(F.col("event_type") == kind, name).otherwise(op)
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("k"), F.col("value").alias("v"))


@query("replay_results", f"WITH {_LOG} SELECT seq, op, k, (CASE WHEN op = 'insert' THEN 1 - present ELSE present END)::INT AS flag, CASE WHEN op = 'get' AND prior.live THEN prior.v WHEN op = 'get_or_insert' THEN after.v END AS value FROM seen")
def replay_results(spark, sf):
    return replay.results(_log(spark, sf))


@query("replay_final_state", f"WITH {_LOG} SELECT k, after.v AS v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM seen) WHERE r = 1 AND after.live")
def replay_final_state(spark, sf):
    return replay.final_state(_log(spark, sf))


# Key functions

_HEX8 = "rpad(substr(hex(encode(c_name)), 1, 16), 16, '0')"


def _unhex_sql(h: str) -> str:
    """The value of 16 hex digits as HUGEINT, digit by digit."""
    return " + ".join(f"(strpos('0123456789ABCDEF', substr({h}, {i}, 1)) - 1)::HUGEINT * {16 ** (16 - i)}::HUGEINT" for i in range(1, 17))


@query("key_model_input", f"SELECT c_custkey, ({_unhex_sql(_HEX8)})::DOUBLE AS x FROM customer")
def key_model_input(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", K.CODECS["string"].model_input(F.col("c_name")).alias("x"))


@query("key_ordinal_prefix", "SELECT c_custkey, rpad(substr(hex(encode(c_name)), 1, 32), 32, '0') AS ordinal FROM customer")
def key_ordinal_prefix(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.hex(K.CODECS["string"].ordinal(F.col("c_name"))).alias("ordinal"))


@query("key_integer", "SELECT o_orderkey, o_orderkey::DOUBLE AS x, o_orderkey::DECIMAL(38,0) AS ordinal FROM orders")
def key_integer(spark, sf):
    c = K.CODECS["i64"]
    return table(spark, sf, "orders").select("o_orderkey", c.model_input(F.col("o_orderkey")).alias("x"), c.ordinal(F.col("o_orderkey")).alias("ordinal"))


# Placement models


def _fit_sql(xs: str, expansion: float, headroom: float) -> str:
    """The 33 candidates, their conflicts, and the best of them."""
    m = 1.0 + headroom
    return f"""
        WITH x AS (SELECT x, lag(x) OVER (ORDER BY x) AS p, row_number() OVER (ORDER BY x) = 1 AS head FROM ({xs})),
        s AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, max(x - p) AS gap, greatest(ceil(count(*)::DOUBLE * {expansion}::DOUBLE * {m}::DOUBLE), count(*))::BIGINT AS size FROM x),
        c AS (
            SELECT s.*, j AS candidate, CASE WHEN j = 0 THEN (size - 1)::DOUBLE / ((hi - lo) * {m}::DOUBLE) WHEN j / gap <= (size - 1)::DOUBLE / (hi - lo) THEN j / gap END AS slope
            FROM s, (SELECT unnest(range(0, 33))::DOUBLE AS j)
        ),
        t AS (SELECT n, size, candidate, slope, 0.0::DOUBLE - slope * lo AS intercept, lo FROM c WHERE slope IS NOT NULL),
        k AS (
            SELECT t.n, t.size, candidate, slope, intercept,
                   sum((NOT head AND greatest(least(round(slope * x + intercept), (size - 1)::DOUBLE), 0) = greatest(least(round(slope * p + intercept), (size - 1)::DOUBLE), 0))::BIGINT)::BIGINT AS conflicts
            FROM x, t GROUP BY ALL
        )
        SELECT n, slope, intercept, size, conflicts, candidate::INT AS candidate FROM k ORDER BY conflicts, candidate LIMIT 1
    """


_TS = "SELECT epoch_us(ts)::DOUBLE AS x FROM events"


def _ts(spark, sf):
    return table(spark, sf, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("x"))


@query("fmcd_fit", _fit_sql(_TS, 2.0, 0.0))
def fmcd_fit(spark, sf):
    return model.fit(_ts(spark, sf), "x")


@query("fmcd_fit_headroom", _fit_sql("SELECT o_orderkey::DOUBLE AS x FROM orders", 2.0, 1.0))
def fmcd_fit_headroom(spark, sf):
    return model.fit(table(spark, sf, "orders").select(F.col("o_orderkey").cast("double").alias("x")), "x", 2.0, 1.0)


_PRICES = "SELECT DISTINCT o_totalprice AS x FROM orders"


@query("fmcd_fit_random", _fit_sql(_PRICES, 1.5, 0.0))
def fmcd_fit_random(spark, sf):
    return model.fit(table(spark, sf, "orders").select(F.col("o_totalprice").alias("x")).distinct(), "x", 1.5)


def _slot_sql(x: str, slope: str, icpt: str, size: str) -> str:
    return f"greatest(least(round({slope} * {x} + {icpt}), ({size} - 1)::DOUBLE), 0)::BIGINT"


@query("predict_slots", f"SELECT p_partkey, {_slot_sql('p_partkey::DOUBLE', '0.75::DOUBLE', '-3.0::DOUBLE', '1000')} AS slot FROM part")
def predict_slots(spark, sf):
    return table(spark, sf, "part").select("p_partkey", model.slot(F.col("p_partkey").cast("double"), F.lit(0.75), F.lit(-3.0), F.lit(1000)).alias("slot"))


@query("fmcd_conflicts", f"SELECT slot, count(*) AS n FROM (SELECT {_slot_sql('p_retailprice', '0.25::DOUBLE', '-100.0::DOUBLE', '500')} AS slot FROM part) GROUP BY slot HAVING count(*) > 1")
def fmcd_conflicts(spark, sf):
    slots = table(spark, sf, "part").select(model.slot(F.col("p_retailprice"), F.lit(0.25), F.lit(-100.0), F.lit(500)).alias("slot"))
    return slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("binary_split", "SELECT p_partkey, CASE WHEN p_partkey <= 40 THEN 0 ELSE 1 END::BIGINT AS slot FROM part")
def binary_split(spark, sf):
    return table(spark, sf, "part").select("p_partkey", model.split_slot(F.col("p_partkey"), F.lit(40), F.lit(2)).alias("slot"))


# Formats

_LINES = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN event_type ELSE user_id::VARCHAR || chr(9) || event_type || chr(9) || 'x' || CASE WHEN event_id % 4 = 2 THEN chr(13) ELSE '' END END AS line FROM events"


@query("ingest_tsv_parse", f"SELECT event_id, substr(l, 1, strpos(l, chr(9)) - 1) AS k, substr(l, strpos(l, chr(9)) + 1) AS v FROM (SELECT event_id, CASE WHEN ends_with(line, chr(13)) THEN left(line, -1) ELSE line END AS l FROM ({_LINES})) WHERE strpos(l, chr(9)) > 0")
def ingest_tsv_parse(spark, sf):
    m: Column = F.col("event_id") % 4
    text = F.concat(F.col("user_id").cast("string"), F.lit("\t"), F.col("event_type"), F.lit("\tx"), F.when(m == 2, F.lit("\r")).otherwise(F.lit("")))
    lines = table(spark, sf, "events").select("event_id", F.when(m == 0, F.lit("")).when(m == 1, F.col("event_type")).otherwise(text).alias("value"))
    return tsv.parse(lines, keep=("event_id",))


@query("json_serialize", "SELECT '[' || string_agg('[' || n_nationkey || ',\"' || n_name || '\"]', ',' ORDER BY n_nationkey) || ']' AS json FROM nation")
def json_serialize(spark, sf):
    return json_pairs.pairs_to_json(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")))


@query("json_roundtrip", "SELECT n_nationkey AS k, n_name AS v FROM nation")
def json_roundtrip(spark, sf):
    return loading.from_rows(json_pairs.parse_pairs_column(json_serialize(spark, sf), "json", "int", "string"))


@query("set_json", "SELECT '[' || string_agg(DISTINCT n_regionkey, ',' ORDER BY n_regionkey) || ']' AS json FROM nation")
def set_json(spark, sf):
    return json_pairs.keys_to_json(table(spark, sf, "nation").select(F.col("n_regionkey").alias("k")))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Validated bulk load of ``orders``, then keys 100..=199 in order, with their number and extremes."""
    df = loading.bulk_load(file_positions(table(spark, sf, "orders")).select("pos", F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")))
    part = closed(100, 199)
    facts = df.where(part.predicate(F.col("k"))).agg(F.count(F.lit(1)).alias("range_count"), F.min("k").alias("first_key"), F.max("k").alias("last_key"))
    return lookups.in_range(df, part).crossJoin(F.broadcast(facts)).orderBy("k")  # facts is one row


from . import stored_queries, workload_queries  # noqa: E402, F401  they register theirs
