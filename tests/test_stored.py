"""Stored maps beyond the queries: ranges that are rewritten, key kinds, hot keys in replay, errors as JSON."""

import random

import pytest

from brindle import errors
from brindle.config import Config, EngineConfig
from brindle.errors import ConcurrentWriteError, CorruptionError, EmptyDataError, InvalidKeyError, NotSortedError
from brindle.functions import keys as K
from brindle.functions.bounds import KeyRange, closed, excluded, included
from brindle.operators import replay
from brindle.operators.sorted_map import SortedMap
from brindle.plans import scratch
from brindle.plans.order import file_positions


def rows(spark, pairs):
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs)], "pos long, k long, v string")


def test_rebuild_range(spark, tmp_path):
    m = SortedMap.from_rows(spark, str(tmp_path / "m"), rows(spark, [(i, f"a{i}") for i in range(40)]), Config(auto_rebuild=False))
    m.remove_many(spark.range(10, 20).withColumnRenamed("id", "k"))
    m.extend(rows(spark, [(15, "new"), (30, "new"), (99, "far")]))
    before, pinned = m.iter_sorted(), m.pin()
    for keys in (closed(8, 16), KeyRange(excluded(16), included(25)), KeyRange(None, 3), KeyRange(200, 300)):
        m.rebuild_range(keys)
        assert m.iter_sorted() == before and len(m) == len(before)
    assert m.get(15) == "new" and m.get(12) is None and m.get(30) == "new"
    m.remove(15)
    m.insert(12, "again")
    assert m.get(15) is None and m.get(12) == "again" and [r["k"] for r in m.range(KeyRange(8, 22)).collect()] == [8, 9, 12, 20, 21]
    m.rebuild()
    assert len(m._manifest()[1]["runs"]) == 1 and m.get(12) == "again" and pinned.iter_sorted() == before


@pytest.mark.parametrize("codec, encode, numbers", [("u128", K.encode_u128, [0, 5, 1 << 64, (1 << 128) - 1]), ("i128", K.encode_i128, [-(1 << 127), -1, 0, 7, (1 << 127) - 1])])
def test_wide_keys(spark, tmp_path, codec, encode, numbers):
    df = spark.createDataFrame([(i, bytearray(encode(n)), str(n)) for i, n in enumerate(numbers)], "pos long, k binary, v string")
    m = SortedMap.from_rows(spark, str(tmp_path / "m"), df, Config(key_codec=codec))
    assert [v for _, v in m.iter_sorted()] == [str(n) for n in sorted(numbers)] and m.max_depth() >= 1
    assert m.get(encode(numbers[1])) == str(numbers[1]) and m.config.key_codec == codec
    with pytest.raises(Exception, match="not 16 bytes"):
        m.extend(spark.createDataFrame([(0, bytearray(b"short"), "x")], "pos long, k binary, v string"))


def plain_replay(log):
    """The log one operation after the other."""
    state, out = {}, []
    for seq, op, k, v in sorted(log):
        there = k in state
        if op == replay.INSERT:
            state[k] = v
            out.append((seq, op, k, int(not there), None))
        elif op == replay.REMOVE:
            state.pop(k, None)
            out.append((seq, op, k, int(there), None))
        elif op == replay.GET_OR_INSERT:
            out.append((seq, op, k, int(there), state.setdefault(k, v)))
        else:
            out.append((seq, op, k, int(there), state.get(k) if op == replay.GET else None))
    return out, state


@pytest.mark.parametrize("seed", range(2))
def test_a_hot_key_is_replayed_in_ranges(spark, seed):
    """One key in nine tenths of the operations: results as one by one, and no task has much more than its share."""
    rng = random.Random(seed)
    ops = [replay.INSERT, replay.REMOVE, replay.GET_OR_INSERT, replay.GET, replay.CONTAINS]
    weights = [(1, 1, 1, 1, 1), (1, 1, 9, 40, 40)][seed]
    log = [(i, rng.choices(ops, weights)[0], 7 if rng.random() < 0.9 else rng.randrange(20), float(i)) for i in range(2000)]
    df = spark.createDataFrame(log, "seq long, op string, k long, v double")
    base = spark.createDataFrame([(7, -1.0), (50, -2.0)], "k long, v double")
    for start in (None, base):
        given = [] if start is None else [(-2, replay.INSERT, 7, -1.0), (-1, replay.INSERT, 50, -2.0)]
        expect, state = plain_replay(given + log)
        assert sorted(map(tuple, replay.results(df, start).collect())) == [r for r in expect if r[0] >= 0]
        assert {r["k"]: r["v"] for r in replay.final_state(df, start).collect()} == state
    cuts = replay._ranges(df)
    assert len(cuts) >= 3 and max(b - a for a, b in zip([0, *cuts], [*cuts, 2000])) < 700


def test_places_in_files(spark, tmp_path):
    """Positions follow the files' names and the rows in them."""
    path = str(tmp_path / "t")
    spark.range(100).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(path)
    placed = file_positions(spark.read.parquet(path)).orderBy("pos").collect()
    assert [r["id"] for r in placed] == list(range(100)) and len({r["pos"] >> 40 for r in placed}) == 4


@pytest.mark.parametrize("e", [EmptyDataError(), NotSortedError(), InvalidKeyError("null"), CorruptionError("bad magic"), ConcurrentWriteError("version 3")])
def test_errors_as_json(e):
    again = errors.from_json(e.to_json())
    assert type(again) is type(e) and str(again) == str(e)


def test_settings_as_json():
    for c in (Config(key_codec="u128", tombstone_ratio_threshold=0.25), EngineConfig(memtable="sorted", flush_threshold=9)):
        assert type(c).from_json(c.to_json()) == c


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        assert scratch.folder(spark, "x").startswith("file:")

        class Far:
            conf, sparkContext = spark.conf, type("C", (), {"master": "spark://host:7077"})

        with pytest.raises(RuntimeError):
            scratch.folder(Far, "x")
