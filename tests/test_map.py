import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brindle.config import Config
from brindle.errors import ConcurrentWriteError, EmptyDataError, InvalidKeyError, NotSortedError
from brindle.functions.bounds import KeyRange, closed
from brindle.operators import loading, replay
from brindle.operators.sorted_map import SortedMap
from brindle.operators.sorted_set import SortedSet

ROW = "pos long, k long, v string"


def rows(spark, pairs, schema=ROW):
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs)], schema)


def loaded(spark, tmp_path, pairs):
    return SortedMap.bulk_load(spark, str(tmp_path / "m"), rows(spark, pairs))


def test_bulk_load_checks(spark, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(EmptyDataError):
        SortedMap.bulk_load(spark, path, rows(spark, []))
    for bad in ([(3, "a"), (1, "b"), (2, "c")], [(1, "a"), (1, "b")]):
        with pytest.raises(NotSortedError):
            SortedMap.bulk_load(spark, path, rows(spark, bad))
    with pytest.raises(NotSortedError):
        SortedMap.bulk_load_dedup(spark, path, rows(spark, [(2, "a"), (1, "b")]))
    with pytest.raises(InvalidKeyError):
        SortedMap.bulk_load(spark, path, rows(spark, [(None, "a"), (1, "b")]))
    m = SortedMap.bulk_load_dedup(spark, path, rows(spark, [(1, "a"), (1, "A"), (2, "b"), (3, "c"), (3, "C")]))
    assert m.iter_sorted() == [(1, "A"), (2, "b"), (3, "C")] and m.config.range_headroom == 1.0


def test_sortedness_over_many_buckets(spark):
    n = 5000
    good = spark.range(n).selectExpr("id AS pos", "id * 3 AS k", "'x' AS v")
    loading.check(good)
    for at in (1, n // 2, n - 1):
        bad = good.selectExpr("pos", f"CASE WHEN pos = {at} THEN -1 ELSE k END AS k", "v")
        with pytest.raises(NotSortedError):
            loading.check(bad)


def test_reads(spark, tmp_path):
    m = loaded(spark, tmp_path, [(i * 3, f"v{i}") for i in range(100)])
    assert m.get(30) == "v10" and m.get(31) is None and m.contains_key(297) and not m.contains_key(1)
    assert len(m) == 100 and not m.is_empty() and repr(m) == "SortedMap(len=100)"
    assert m.first_key_value() == (0, "v0") and m.last_key_value() == (297, "v99")
    assert [r["k"] for r in m.range(KeyRange(10, 20)).collect()] == [12, 15, 18] and m.range_count(closed(9, 18)) == 4
    assert m.range(KeyRange(20, 10)).count() == 0
    probes = spark.createDataFrame([(0,), (1,), (3,), (3,)], "k long")
    assert sorted((r["k"], r["v"], r["found"]) for r in m.get_many(probes).collect()) == [(0, "v0", True), (1, None, False), (3, "v1", True), (3, "v1", True)]
    assert sorted(r["k"] for r in m.contains_many(probes).collect()) == [0, 3, 3] and [r["k"] for r in m.missing_many(probes).collect()] == [1]
    assert m.allocated_bytes() > 0 and m.max_depth() >= 1


def test_writes_and_snapshots(spark, tmp_path):
    m = SortedMap.new(spark, str(tmp_path / "m"), "k long, v string")
    assert m.is_empty() and m.first_key_value() is None and m.drain().count() == 0
    assert m.insert(5, "a") is True and m.insert(5, "b") is False and m.get(5) == "b"
    assert m.get_or_insert(5, "z") == "b" and m.get_or_insert(6, "c") == "c"
    calls = []
    assert m.get_or_insert_with(6, lambda: calls.append(1) or "q") == "c" and not calls
    assert m.get_or_insert_with(7, lambda: calls.append(1) or "q") == "q" and calls
    pinned = m.pin()
    assert m.remove(5) is True and m.remove(5) is False and m.get(5) is None
    assert pinned.get(5) == "b" and len(pinned) == 3
    with pytest.raises(RuntimeError):
        pinned.clear()
    m.extend_pairs([(9, "x"), (1, "y"), (9, "w")])
    assert m.iter_sorted() == [(1, "y"), (6, "c"), (7, "q"), (9, "w")]
    m.rebuild()
    assert m.iter_sorted() == [(1, "y"), (6, "c"), (7, "q"), (9, "w")] and m.tombstone_ratio() == 0
    m.remove_many(spark.createDataFrame([(1,), (2,)], "k long"))
    assert len(m) == 3
    drained = m.drain()
    assert [r["k"] for r in drained.collect()] == [6, 7, 9] and m.is_empty()
    m.vacuum()
    assert len(m.log.versions()) == 1
    with pytest.raises(InvalidKeyError):
        m.extend_pairs([(None, "x")])


def test_auto_rebuild(spark, tmp_path):
    m = SortedMap.new(spark, str(tmp_path / "m"), "k long, v string", Config(rebuild_depth_threshold=2))
    for i in range(4):
        m.extend_pairs([(i, "v")])
    assert len(m._manifest()[1]["runs"]) <= 2 and len(m) == 4


def test_second_writer_fails(spark, tmp_path):
    m = SortedMap.new(spark, str(tmp_path / "m"), "k long, v string")
    with pytest.raises(ConcurrentWriteError):
        m.log.publish(0, {})


def test_a_dead_writers_claim_expires(spark, tmp_path, monkeypatch):
    from brindle.plans import manifest

    m = SortedMap.new(spark, str(tmp_path / "m"), "k long, v string")
    m.log.files.write(f"{m.log.folder}/{1:012d}.claim", b"")
    with pytest.raises(ConcurrentWriteError):
        m.clear()
    monkeypatch.setattr(manifest, "STALE_SECONDS", -1)
    m.clear()
    assert m.version == 1


def test_json(spark, tmp_path):
    m = SortedMap.from_json(spark, str(tmp_path / "a"), '[[1,"a\\"b"],[2,"c"]]', "k long, v string")
    assert m.iter_sorted() == [(1, 'a"b'), (2, "c")] and m.to_json() == '[[1,"a\\"b"],[2,"c"]]'
    assert SortedMap.from_json(spark, str(tmp_path / "b"), "[]", "k long, v string").to_json() == "[]"
    with pytest.raises(NotSortedError):
        SortedMap.from_json(spark, str(tmp_path / "c"), '[[2,"a"],[1,"b"]]', "k long, v string")


def test_string_keys_with_long_shared_prefixes(spark, tmp_path):
    ks = ["", "a"] + [f"{'p' * 32}{i:03d}" for i in range(20)] + ["é", "😀"]
    m = SortedMap.from_rows(spark, str(tmp_path / "s"), spark.createDataFrame([(i, k, i) for i, k in enumerate(reversed(ks))], "pos long, k string, v long"))
    assert [k for k, _ in m.iter_sorted()] == sorted(ks, key=lambda s: s.encode()) and m.get("") is not None
    assert m.range_count(KeyRange("p", "q")) == 20 and m.max_depth() >= 5


def test_set(spark, tmp_path):
    df = spark.createDataFrame([(i, k) for i, k in enumerate([1, 1, 2, 5])], "pos long, k long")
    s = SortedSet.bulk_load(spark, str(tmp_path / "s"), df)
    assert len(s) == 3 and s.contains(2) and not s.contains(3) and s.first() == 1 and s.last() == 5
    assert s.insert(3) and not s.insert(3) and s.remove(1) and not s.remove(1)
    s.extend([9, 9, 7])
    assert [r["k"] for r in s.range().collect()] == [2, 3, 5, 7, 9] and [r["k"] for r in s.range(KeyRange(3, 7)).collect()] == [3, 5]
    assert s.to_json() == "[2,3,5,7,9]" and SortedSet.from_json(spark, str(tmp_path / "t"), "[3,1]", "long").first() == 1
    with pytest.raises(EmptyDataError):
        SortedSet.bulk_load(spark, str(tmp_path / "u"), df.limit(0))


OPS = st.lists(st.tuples(st.sampled_from(["insert", "remove", "get_or_insert", "get", "contains"]), st.integers(0, 12), st.integers(0, 99)), min_size=1, max_size=80)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(OPS, st.dictionaries(st.integers(0, 12), st.integers(0, 99), max_size=6))
def test_replay_against_a_dictionary(spark, ops, start):
    log = spark.createDataFrame([(i, o, k, v) for i, (o, k, v) in enumerate(ops)], "seq long, op string, k long, v long")
    base = spark.createDataFrame(list(start.items()), "k long, v long")
    state, expect = dict(start), []
    for op, k, v in ops:
        there, value = k in state, None
        if op == "insert":
            flag, state[k] = not there, v
        elif op == "remove":
            flag = state.pop(k, None) is not None or there
        elif op == "get_or_insert":
            flag, value = there, state.setdefault(k, v)
        else:
            flag, value = there, state.get(k) if op == "get" else None
        expect.append((int(flag), value))
    assert [(r["flag"], r["value"]) for r in replay.results(log, base).orderBy("seq").collect()] == expect
    assert {r["k"]: r["v"] for r in replay.final_state(log, base).collect()} == state


def test_the_whole_log_is_applied_to_a_whole_base(spark, sf):
    """Every event has its result, get_or_insert among them, and meets a customer's value where there is one."""
    from brindle import queries

    got = {r["seq"]: r for r in queries.QUERIES["stored_map_apply_log"](spark, sf).collect()}
    base = {r["c_custkey"]: r["c_acctbal"] for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    events = sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda e: e["event_id"])
    assert len(got) == len(events)
    for e in events:
        k, r = e["user_id"], got[e["event_id"]]
        if e["event_type"] == "click":
            assert (r["op"], r["flag"], r["value"]) == ("get_or_insert", int(k in base), base.setdefault(k, e["value"]))
        elif e["event_type"] == "error":
            assert (r["op"], r["flag"]) == ("remove", int(base.pop(k, None) is not None))
        elif e["event_type"] == "view":
            assert (r["op"], r["flag"], r["value"]) == ("get", int(k in base), base.get(k))
        else:
            assert (r["op"], r["flag"]) == ("insert", int(k not in base))
            base[k] = e["value"]
