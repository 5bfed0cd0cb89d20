"""op8."""

import hashlib
import random

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import induced, repeats


def brute(rows):
    """Every string of 100 bytes in order; covered bytes go."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for q in range(len(b) - 99):
            s = b[q : q + 100]
            if s in seen:
                gone[q : q + 100] = b"\1" * 100
            seen.add(s)
        runs = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def made():
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(n))
    passages = [prose(60) for _ in range(4)]
    texts = []
    for _ in range(80):
        parts = [prose(rng.randrange(1, 40))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randrange(60, 400)], prose(rng.randrange(1, 20))]
        texts.append(" ".join(parts))
    texts += texts[:5] + [texts[7][:-1] + "x", "a" * 500, "ab" * 300, "ab" * 300, "x" * 99, "x" * 100, "y" * 100, "y" * 100, "", None, texts[3] + texts[4] + texts[3], "q" * 101]
    rng.shuffle(texts)
    return list(enumerate(texts))


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df).collect()}


@pytest.mark.parametrize("small", [None, "blocks", "hot", "both"])
def test_against_brute_force(spark, monkeypatch, small):
    if small in ("blocks", "both"):
        monkeypatch.setattr(repeats, "BLOCK_BYTES", 700)
        monkeypatch.setattr(repeats, "BLOCK_ANCHORS", 40)
    if small in ("hot", "both"):
        monkeypatch.setattr(repeats, "HOT", 3)
    rows = made()
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


class _Task:
    get = classmethod(lambda cls: cls())

    def partitionId(self):
        return 3


def pieces(table, size):
    return iter(table.combine_chunks().to_batches(max_chunksize=size))


def lines(batches):
    return sorted((str(r) for b in batches for r in b.to_pylist()))


@pytest.mark.parametrize("size, limit", [(1, 1), (2, 5), (7, 60), (50, 1000)])
def test_groups_that_span_batches(tmp_path, monkeypatch, size, limit):
    """Verdicts don't depend on how the sorted rows are cut into batches."""
    monkeypatch.setattr(repeats, "TaskContext", _Task)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 900)
    monkeypatch.setattr(repeats, "BLOCK_ANCHORS", 60)
    docs = pa.table({"doc_id": pa.array([i for i, _ in made()], pa.int64()), "text": pa.array([t or "" for _, t in made()])})
    found = pa.Table.from_batches([b for b in repeats._scan(f"file://{tmp_path}")(pieces(docs, 17)) if b.num_rows])
    order = pa.compute.sort_indices(found, [("key", "ascending"), ("context", "ascending"), ("doc_id", "ascending"), ("part", "ascending"), ("at", "ascending")], null_placement="at_start")
    found = found.take(order)
    monkeypatch.setattr(repeats, "BLOCK_ANCHORS", 10**9)
    whole = lines(repeats._judge(pieces(found, 10**6)))
    monkeypatch.setattr(repeats, "BLOCK_ANCHORS", limit)
    assert lines(repeats._judge(pieces(found, size))) == whole
    judged = pa.Table.from_batches(list(repeats._judge(pieces(found, 10**6))))
    check = judged.filter(pa.compute.equal(judged["kind"], repeats.CHECK)).drop_columns(["file"])
    shard = next(tmp_path.glob("*.bin"))
    check = check.append_column("file", pa.array([f"file://{shard}"] * check.num_rows)).sort_by([("part", "ascending"), ("at", "ascending")])
    contexts = pa.Table.from_batches(list(repeats._contexts(pieces(check, size)))).sort_by("gram")

    def covered(batches):
        return {(r["part"], p) for b in batches for r in b.to_pylist() for p in range(r["at"], r["x"])}

    whole = covered(repeats._within(pieces(contexts, 10**6)))
    monkeypatch.setattr(repeats, "BLOCK_STRINGS", limit)
    assert covered(repeats._within(pieces(contexts, size))) == whole and whole


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.sampled_from([4, 1000]))
def test_induced_sorting(body, held):
    t = [*body, 0]
    found = list(induced.sort_suffixes(t, held))
    assert [p for p, _ in found] == sorted(range(len(t)), key=lambda i: t[i:])
    for (a, _), (b, lcp) in zip(found, found[1:]):
        assert lcp == next(k for k in range(len(t)) if a + k == len(t) or b + k == len(t) or t[a + k] != t[b + k])


def test_induced_sorting_spills(monkeypatch):
    """Real text with little memory: queues and sorts spill, runs are merged, memory holds what it may."""
    monkeypatch.setattr(induced, "FAN", 4)
    monkeypatch.setattr(induced, "BLOCK", 16)
    queues, real = [], induced.DiskQueue
    monkeypatch.setattr(induced, "DiskQueue", lambda held: queues.append(real(held)) or queues[-1])
    text = "".join(t or "" for _, t in made())[:6000].encode()
    t = [x + 2 for x in text] + [0]
    found = list(induced.sort_suffixes(t, held=50))
    order = sorted(range(len(t)), key=lambda i: t[i : i + 7000])
    assert [p for p, _ in found] == order
    for (a, _), (b, lcp) in zip(found, found[1:]):
        assert lcp == min(induced.CAP, next(k for k in range(len(t)) if t[a + k] != t[b + k]))
    assert sum(q.spilled for q in queues) > 500 and all(len(q.heap) <= 51 and len(q.runs) <= 5 for q in queues)


def test_sorter_merges_its_runs(monkeypatch):
    monkeypatch.setattr(induced, "FAN", 3)
    s, rng = induced.Sorter(held=5), random.Random(2)
    items = [(rng.randrange(100), i) for i in range(200)]
    for x in items:
        s.push(x)
    assert list(s) == sorted(items) and len(s.runs) < 4


def test_disk_queue():
    rng, queue = random.Random(1), induced.DiskQueue(held=10)
    items = [(rng.randrange(50), i) for i in range(500)]
    for x in items:
        queue.push(x)
    assert [queue.pop() for _ in items] == sorted(items) and queue.peek() is None


def test_induced_shard(spark, no_docs):
    rows = made()
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats_in_shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and repeats.remove_repeats_in_shard(no_docs).count() == 0


def test_small_table(docs):
    assert result(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(odd_docs, no_docs):
    rows = repeats.remove_repeats(odd_docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd_docs.count() and by[3]["n_bytes"] == by[4]["n_bytes"] == 0 and by[6]["n_removed"] == by[6]["n_bytes"] > 0 and by[1]["n_removed"] == 0
    assert by[6]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and by[None]["n_removed"] == 0
    assert repeats.remove_repeats(no_docs).count() == 0
