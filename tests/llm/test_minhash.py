"""op3."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import graph, minhash
from brindle.llm.shingles import Shingler, jaccard_counts, super_minhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(sets):
    """Least member reachable, by comparing all pairs."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aB é\t\n\x0b\x1c", max_size=40), max_size=5))
def test_shingles(texts):
    got = Shingler().sets(texts)
    expect = [plain_set(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in expect]
    for a, x in zip(got, expect):
        for b, y in zip(got, expect):
            assert jaccard_counts(a, b)[0] == len(x & y)


def sequential(elements, m, seed=1):
    """Element by element, each with its whole permutation."""
    from brindle.llm.shingles import _B, _M1, mix

    best = [2**64 - 1] * m
    for e in elements:
        x = mix(np.array([e], np.uint64) ^ np.uint64(seed))
        perm = list(range(m))
        for j in range(m):
            state = mix(x + np.uint64((2 * j + 1) * int(_B) & (1 << 64) - 1))
            k = j + int(state[0] >> np.uint64(40)) % (m - j)
            perm[j], perm[k] = perm[k], perm[j]
            value = j << 56 | int((mix(state ^ _M1) >> np.uint64(8))[0])
            best[perm[j]] = min(best[perm[j]], value)
    return best


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sets(st.integers(0, 2**64 - 1), max_size=30), min_size=1, max_size=4))
def test_super_minhash_equals_the_sequential_form(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    got = super_minhash(arrays, 16)
    assert got.tolist() == [sequential(a, 16) for a in arrays]


def test_estimates_have_low_variance():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        base = rng.integers(0, 2**63, 140).astype(np.uint64)
        a, b = np.unique(base[:120]), np.unique(base[20:])
        sig = super_minhash([a, b], 128)
        both, union = jaccard_counts(a, b)
        errors.append((sig[0] == sig[1]).mean() - both / union)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.043


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def families():
    """Groups of copies with one to a few edited words, a large one among them, and chains."""
    rng, texts = random.Random(11), []
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    for size in (2, 3, 5, 40):
        base = prose(120)
        texts += [edited(rng, base, rng.randrange(0, 5)) for _ in range(size)]
    chain = prose(100)
    for i in range(12):  # each like its neighbour, the ends unlike each other
        chain = chain[:]
        chain[8 * i : 8 * i + 2] = [f"c{i}", f"d{i}"]
        texts.append(" ".join(chain))
    texts += [" ".join(prose(80)) for _ in range(30)]
    texts += ["A b c", "a B c", "a b c d e", "a b c d", "", "  ", "a b c"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [4, 256])
def test_components(spark, families, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    df = spark.createDataFrame(families, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    sets = {i: plain_set(t) for i, t in families}
    expect = plain_components(sets)
    assert {i: r["component_id"] for i, r in got.items()} == expect
    assert all(got[i]["n_shingles"] == len(s) and got[i]["kept"] == (expect[i] == i) for i, s in sets.items())
    kept = sorted(r["doc_id"] for r in minhash.keep_first(df).collect())
    assert kept == [i for i in sorted(expect) if expect[i] == i]


def test_small_tables_match_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == plain_components({r["doc_id"]: plain_set(r["text"]) for r in rows})


def test_odd_rows(odd_docs, no_docs):
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(odd_docs).collect())
    by = {(i, c) for i, _, c in got}
    assert {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8), (0, None)} <= by and len(got) == 11
    assert [n for i, n, _ in got if i in (3, 4, 8)] == [0, 0, 0]
    kept = minhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 8, 9]
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.keep_first(no_docs).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_connected_components(spark, edges):
    root = {i: i for e in edges for i in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}


def test_names_of_columns_do_not_clash(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "x")]
    names = ["row", "drop", "digest", "order_id", "Drop_", "__drop", "fp"]
    for some in (rows, rows[1:] + rows[:1], rows[:2]):
        df = spark.createDataFrame(some, "doc_id long, text string").select("*", *[F.lit(n).alias(n) for n in names])
        kept = minhash.keep_first(df)
        assert kept.columns == df.columns and all(r[n] == n for r in kept.collect() for n in names)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({1, *(i for i, _ in some if i == 3)})


def test_a_large_bucket_is_copied_once(spark, monkeypatch):
    """20,000 classes in one bucket, most of them linked: rows dealt and meetings grow in proportion."""
    monkeypatch.setattr(minhash, "BLOCK", 256)
    told = {}
    real = minhash.common.materialise
    monkeypatch.setattr(minhash.common, "materialise", lambda df, name: told.setdefault(name, real(df, name)))
    rng = np.random.default_rng(0)
    for n in (5_000, 20_000):
        told.clear()
        folder = minhash.common.fresh_dir(spark, "sets")
        fs, path = minhash.common.filesystem(folder)
        fs.create_dir(path, recursive=True)
        sets = np.sort(rng.integers(1, 2**62, (n, 4)).astype(np.uint64), axis=1)  # sets that share nothing
        with fs.open_output_stream(f"{path}/s") as f:
            f.write(sets.tobytes())
        reps = spark.createDataFrame(pa.table({"rep": np.arange(n), "n_shingles": np.full(n, 4), "fp": pa.array([bytes([1])] * n), "file": [f"{folder}/s"] * n, "at": 4 * np.arange(n), "brief": pa.array([rng.bytes(128) for _ in range(n)]), "bands": pa.array([[7]] * n, pa.list_(pa.int64()))}))
        known = spark.range(n).selectExpr("7L AS key", "id AS rep", "CASE WHEN id < 300 THEN id ELSE 300L END AS comp")
        assert minhash._across(known, reps).count() == 0
        blocks = told["links-inside"].where("key IS NOT NULL").count()
        assert blocks <= n // 256 + 4 and told["block-pairs"].count() <= 3 * blocks


def test_keep_first_decides_by_row(spark):
    """Rows with one doc_id: a unique text stays beside a dropped copy, and equal rows leave one."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, text("a")), (2, text("a") + " more"), (2, text("b")), (3, text("c")), (3, text("c")), (4, text("b")), (5, ""), (5, ""), (None, text("a"))]
    kept = minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(kept, key=str) == sorted([(1, text("a")), (2, text("b")), (3, text("c")), (5, ""), (5, ""), (None, text("a"))], key=str)
