import io

import pytest
from hypothesis import given
from hypothesis import strategies as st

from brindle.config import EngineConfig
from brindle.errors import ConcurrentWriteError, CorruptionError
from brindle.functions.bounds import KeyRange
from brindle.operators.lsm import LsmTable, Memtable, SortedMemtable
from brindle.sources import sstable, tsv, wal
from brindle.streaming.ingest import ingest_stream, tsv_stream

BIG = EngineConfig(flush_threshold=1 << 30)


def pairs(table):
    return [(bytes(r["k"]), bytes(r["v"])) for r in table.scan().collect()]


def sorted_rows(spark, kv):
    return spark.createDataFrame([(i, bytearray(k), bytearray(v)) for i, (k, v) in enumerate(kv)], "pos long, k binary, v binary")


def test_put_get_delete_and_reopen(spark, tmp_path):
    t = LsmTable(spark, str(tmp_path / "t"), BIG)
    t.put(b"a", b"1")
    t.put(b"b", b"2")
    t.put(b"c", b"")  # an empty value deletes
    assert t.get(b"a") == b"1" and t.get(b"c") is None and t.get(b"x") is None
    t.flush()
    t.delete(b"a")
    assert t.get(b"a") is None and t.get(b"b") == b"2"
    again = LsmTable(spark, str(tmp_path / "t"), BIG)  # runs and the unflushed log are found
    assert again.get(b"a") is None and again.get(b"b") == b"2" and pairs(again) == [(b"b", b"2")]
    again.flush()
    assert pairs(LsmTable(spark, str(tmp_path / "t"))) == [(b"b", b"2")]


def test_auto_flush_and_levels(spark, tmp_path):
    t = LsmTable(spark, str(tmp_path / "t"), EngineConfig(flush_threshold=20))
    t.put(b"key-0001", b"value-0001-long")
    assert t.memtable.is_empty() and t.level_count(0) == 1
    t.flush()
    assert t.level_count(0) == 1


def test_compaction_keeps_the_newest_and_no_deleted_key_returns(spark, tmp_path):
    t = LsmTable(spark, str(tmp_path / "t"), BIG)
    for i in range(4):
        t.put(b"k", b"v%d" % i)
        t.put(b"only-%d" % i, b"x")
        if i == 3:
            t.delete(b"only-0")
        t.flush()
    assert t.level_count(0) == 0 and t.level_count(1) == 1
    assert t.get(b"k") == b"v3" and t.get(b"only-0") is None
    t.delete(b"k")  # older value now at level 1
    for i in range(4):
        t.put(b"f%d" % i, b"y")
        t.flush()
    assert t.level_count(1) == 2 and t.get(b"k") is None
    assert sum(r["deleted"] for r in t.runs()) == 1  # the deletion stays while older runs exist
    t.compact_level(1)
    assert t.get(b"k") is None and sum(r["deleted"] for r in t.runs()) == 0
    before = pairs(t)
    t.vacuum()
    assert pairs(t) == before and t.manifest_df().count() == 1


def test_ingest(spark, tmp_path):
    t = LsmTable(spark, str(tmp_path / "t"), BIG)
    assert t.ingest_iter([(b"a", b"1"), (b"a", b"2")]) == 2 and t.get(b"a") == b"2" and t.ingest_iter([]) == 0
    assert t.ingest_sorted(sorted_rows(spark, [(b"a", b"9"), (b"c", b"3")])) == 2 and t.get(b"a") == b"9"
    for bad in ([(b"b", b"1"), (b"a", b"2")], [(b"a", b"1"), (b"a", b"2")]):
        with pytest.raises(CorruptionError):
            t.ingest_sorted(sorted_rows(spark, bad))
    assert t.ingest_sorted(sorted_rows(spark, [])) == 0
    t.put(b"b", b"5")
    t.put(b"a", b"6")
    assert pairs(t) == [(b"a", b"6"), (b"b", b"5"), (b"c", b"3")]
    assert [bytes(r["k"]) for r in t.scan(KeyRange(b"b", b"c")).collect()] == [b"b"]
    probes = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"z"),)], "k binary")
    assert {bytes(r["k"]): r["v"] and bytes(r["v"]) for r in t.get_many(probes).collect()} == {b"a": b"6", b"z": None}


def test_tsv(spark, tmp_path):
    (tmp_path / "x.tsv").write_bytes(b"alpha\t111\nmalformed\n\nbeta\t2\t3\r\nalpha\t9\n\tempty key\n")
    rows = [(r["k"], r["v"]) for r in tsv.read(spark, str(tmp_path / "x.tsv")).orderBy("pos").collect()]
    assert rows == [("alpha", "111"), ("beta", "2\t3"), ("alpha", "9"), ("", "empty key")]
    t = LsmTable(spark, str(tmp_path / "t"))
    assert t.ingest_tsv(str(tmp_path / "x.tsv")) == 4 and t.get(b"alpha") == b"9" and t.get(b"beta") == b"2\t3"


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.tsv").write_text("a\t1\nb\t2\n")
    run = lambda: ingest_stream(tsv_stream(spark, str(source)), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    run()
    (source / "2.tsv").write_text("a\t3\n")
    run()
    t = LsmTable(spark, str(tmp_path / "t"))
    assert pairs(t) == [(b"a", b"3"), (b"b", b"2")]
    assert t.ingest(sorted_rows(spark, [(b"q", b"q")]), batch="tsv-0") == 0 and t.get(b"q") is None  # applied before


@pytest.mark.parametrize("kind", [Memtable, SortedMemtable])
def test_memtable(kind):
    m = kind()
    m.insert(b"b", b"22")
    m.insert(b"a", b"1")
    m.delete(b"b")
    m.insert(b"c", b"3")
    assert m.scan(b"a\0", b"c") == [(b"b", b"")] and m.scan() == [(b"a", b"1"), (b"b", b""), (b"c", b"3")]
    m = kind()
    m.insert(b"b", b"22")
    m.insert(b"a", b"1")
    m.delete(b"b")
    assert m.get(b"b") == b"" and m.get(b"x") is None and len(m) == 2 and m.approximate_bytes() == 3
    assert m.drain_sorted() == [(b"a", b"1"), (b"b", b"")] and m.is_empty()


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


@given(st.dictionaries(st.binary(max_size=20), st.binary(max_size=30), max_size=60), st.sampled_from([1, 32, 4096]))
def test_sstable_round_trip(rows, block):
    f = Bytes()
    w = sstable.TableWriter(f, block)
    for k, v in sorted(rows.items()):
        w.add(k, v)
    assert w.finish() == len(rows)
    r = sstable.TableReader(f)
    assert list(r.scan()) == sorted(rows.items()) and r.count == len(rows)
    assert all(r.get(k) == v for k, v in rows.items()) and r.get(b"\xff" * 21) is None


def test_sstable_layout_and_errors():
    f = Bytes()
    w = sstable.TableWriter(f)
    w.add(b"k", b"vv")
    with pytest.raises(CorruptionError):
        w.add(b"k", b"x")
    w.finish()
    entry = b"\x01\0\0\0k\x02\0\0\0vv"
    assert f.getvalue() == entry + b"\x01\0\0\0k" + (0).to_bytes(8, "little") + len(entry).to_bytes(8, "little") + len(entry).to_bytes(8, "little") + (1).to_bytes(8, "little") + (0x5353544C).to_bytes(4, "little")
    with pytest.raises(CorruptionError):
        sstable.TableReader(Bytes(b"short"))
    with pytest.raises(CorruptionError):
        sstable.TableReader(Bytes(b"x" * 40))


def test_sst_source(spark, tmp_path):
    spark.dataSource.register(sstable.SstDataSource)
    path = str(tmp_path / "tables")
    df = spark.range(1000).selectExpr("encode(lpad(id, 6, '0'), 'UTF-8') AS k", "encode(string(id), 'UTF-8') AS v")
    df.repartitionByRange(3, "k").sortWithinPartitions("k").write.format("sst").option("path", path).option("blockBytes", 64).mode("append").save()
    back = spark.read.format("sst").option("path", path).load()
    assert back.count() == 1000
    back = spark.read.format("sst").option("path", path).option("pushFilters", "true").load()
    some = back.where("k >= encode('000100', 'UTF-8') AND k < encode('000110', 'UTF-8')")
    assert sorted(bytes(r["v"]) for r in some.collect()) == [str(i).encode() for i in range(100, 110)]


RECORDS = st.lists(st.one_of(st.tuples(st.just(wal.PUT), st.binary(max_size=9), st.binary(max_size=9)), st.tuples(st.just(wal.DELETE), st.binary(max_size=9), st.none())), max_size=20)


@given(RECORDS, st.integers(0, 6))
def test_wal_round_trip(records, cut):
    data = wal.encode(records)
    assert list(wal.decode(data)) == records
    if records:
        short = list(wal.decode(data[: len(data) - 1 - cut % 4]))
        assert short == records[: len(short)]


def test_blocks_outside_a_range_are_not_planned(tmp_path):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    rows = [(b"%06d" % i, b"x") for i in range(1000)]
    with open(tmp_path / "a.sst", "wb") as f:
        w = sstable.TableWriter(f, 64)
        for k, v in rows:
            w.add(k, v)
        w.finish()
    r = sstable._FilteringReader(str(tmp_path))
    list(r.pushFilters([GreaterThanOrEqual(("k",), b"000100"), LessThan(("k",), b"000110")]))
    read = [k for p in r.partitions() for batch in r.read(p) for k in batch.column("k").to_pylist()]
    assert {b"%06d" % i for i in range(100, 110)} <= set(read) and len(read) < 30


def test_every_block_belongs_to_one_task(tmp_path, monkeypatch):
    with open(tmp_path / "a.sst", "wb") as f:
        w = sstable.TableWriter(f, 64)
        for i in range(1000):
            w.add(b"%06d" % i, b"x")
        w.finish()
    monkeypatch.setattr(sstable, "TASK_BYTES", 700)
    r = sstable._Reader(str(tmp_path))
    assert len(r.partitions()) > 10
    assert [k for p in r.partitions() for batch in r.read(p) for k in batch.column("k").to_pylist()] == [b"%06d" % i for i in range(1000)]


def test_a_log_is_read_in_chunks():
    records = [(wal.PUT, b"k%d" % i, b"v" * i) for i in range(100)] + [(wal.DELETE, b"gone", None)]
    assert list(wal.decode_stream(io.BytesIO(wal.encode(records)), chunk=7)) == records


def test_a_failed_flush_loses_nothing(spark, tmp_path, monkeypatch):
    """A put, a flush whose publication fails once, another put and flush: both keys stay, also after reopening."""
    t = LsmTable(spark, str(tmp_path / "t"), BIG)
    t.put(b"a", b"1")
    real = t._publish
    monkeypatch.setattr(t, "_publish", lambda manifest: (_ for _ in ()).throw(OSError("store is away")))
    with pytest.raises(OSError):
        t.flush()
    monkeypatch.setattr(t, "_publish", real)
    assert t.get(b"a") == b"1" and LsmTable(spark, t.path, BIG).get(b"a") == b"1"
    t.put(b"b", b"2")
    t.flush()
    assert pairs(t) == [(b"a", b"1"), (b"b", b"2")] == pairs(LsmTable(spark, t.path, BIG)) and t.memtable.is_empty()


def test_a_publication_that_fails_leaves_no_claim(spark, tmp_path, monkeypatch):
    t = LsmTable(spark, str(tmp_path / "t"), BIG)
    t.put(b"a", b"1")
    monkeypatch.setattr(t.log.files, "rename", lambda a, b: False)
    with pytest.raises(ConcurrentWriteError):
        t.flush()
    monkeypatch.undo()
    t.flush()
    assert pairs(LsmTable(spark, t.path)) == [(b"a", b"1")]


def test_batches_of_a_stream_take_bounded_room(spark, tmp_path):
    t = LsmTable(spark, str(tmp_path / "t"), BIG)
    for n in range(4):
        assert t.ingest(sorted_rows(spark, [(b"k", b"%d" % n)]), batch=f"a-{n}") == 1
    assert t.ingest(sorted_rows(spark, [(b"k", b"old")]), batch="a-2") == 0 and t.ingest(sorted_rows(spark, [(b"j", b"x")]), batch="b-1") == 1
    assert t._manifest()["batches"] == {"a": 3, "b": 1} and t.get(b"k") == b"3"


def test_ingest_iter_is_cut_at_the_threshold(spark, tmp_path, monkeypatch):
    t, logged = LsmTable(spark, str(tmp_path / "t"), EngineConfig(flush_threshold=100)), []
    real = t._append
    monkeypatch.setattr(t, "_append", lambda records: (logged.append(len(records)), real(records))[1])
    assert t.ingest_iter((b"%04d" % i, b"x" * 16) for i in range(12)) == 12
    assert logged == [5, 5, 2] and len(pairs(t)) == 12 and not t.memtable.is_empty()


def test_wal_source_and_corruption(spark, tmp_path):
    with pytest.raises(CorruptionError):
        list(wal.decode(b"\x07rest"))
    (tmp_path / "1.wal").write_bytes(wal.encode([(wal.PUT, b"a", b"1"), (wal.DELETE, b"b", None)]) + b"\x01\x02")
    spark.dataSource.register(wal.WalDataSource)
    rows = spark.read.format("kvwal").option("path", str(tmp_path)).load().orderBy("seq").collect()
    assert [(r["op"], bytes(r["k"])) for r in rows] == [("insert", b"a"), ("remove", b"b")]


def test_every_level_of_all_events_is_compacted(spark, sf, monkeypatch):
    """The query goes through compact_level and returns each level's keys, from all events."""
    from brindle import queries

    called, real = [], LsmTable.compact_level
    monkeypatch.setattr(LsmTable, "compact_level", lambda self, n: (called.append(n), real(self, n))[1])
    rows = queries.QUERIES["lsm_compact_levels"](spark, sf).collect()
    expect = {(e["event_id"] % 3, e["user_id"]) for e in spark.read.parquet(f"{sf}/events.parquet").collect() if e["event_type"] != "error"}
    assert called == [0, 1, 2, 0, 1, 0] and {r["level"] for r in rows} == {0, 1, 2}
    assert {(r["level"], r["k"]) for r in rows if not r["deleted"]} <= expect
