"""op5."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, dim string"


def brute(rows, cosine=embeddings.COSINE):
    ok = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(np.array(v, np.float32), float), label)
    links, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (x, l) in ok.items():
        for b, (y, m) in ok.items():
            if a < b and l == m and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in links}


def made(seed=1, n=300, dim=16):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    centres = rng.normal(size=(25, dim))
    for _ in range(n):
        c = centres[rng.integers(25)] if rng.random() < 0.7 else rng.normal(size=dim)
        rows.append((i, [float(x) for x in (c + rng.normal(size=dim) * rng.choice([0.02, 0.15, 0.35])) * rng.uniform(0.1, 9)], int(rng.integers(3))))
        i += 1
    return rows + [(i + k, rows[5][1], rows[5][2]) for k in range(6)]


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, 9, "d") for r in rows], SCHEMA)
    return {r["vec_id"]: r for r in embeddings.near_duplicates(df, **more).collect()}


@pytest.mark.parametrize("list_size, block", [(512, 1024), (20, 1024), (20, 7)])
def test_against_brute_force(spark, monkeypatch, list_size, block):
    monkeypatch.setattr(embeddings, "LIST_SIZE", list_size)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = made()
    got = found(spark, rows, probes=10_000)
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_recall_with_few_probes(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LIST_SIZE", 10)
    rows = made(2, 500)
    got, expect = found(spark, rows, probes=8), brute(rows)
    assert all(got[i]["n_links"] <= n for i, (n, _) in expect.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(n for n, _ in expect.values())


@pytest.mark.parametrize("probes", [1, 4])
def test_exact_beyond_the_probes(spark, monkeypatch, probes):
    """Partners all around, in lists beyond the probes too: no link is lost, on neither side."""
    monkeypatch.setattr(embeddings, "LIST_SIZE", 10)
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 16))
    near = x + 0.37 * np.linalg.norm(x, axis=1)[:, None] * (z := rng.normal(size=x.shape)) / np.linalg.norm(z, axis=1)[:, None]
    rows = [(i, v, 1) for i, v in enumerate(np.concatenate([x, near]).tolist())]
    expect = brute(rows)
    assert sum(n for n, _ in expect.values()) > 200
    assert {i: (r["n_links"], r["component_id"]) for i, r in found(spark, rows, probes=probes).items()} == expect


@pytest.mark.parametrize("kind, labels", [("string", ["a", "A", ""]), ("long", [3_000_000_000, -1, 3])])
def test_labels_of_any_type(spark, kind, labels):
    rows = made(5, 120)
    expect = brute(rows)
    df = spark.createDataFrame([(*r, 9, "d") for r in rows], SCHEMA)
    label = F.element_at(F.array(*map(F.lit, labels)), F.col("label") + 1).cast(kind)
    got = embeddings.near_duplicates(df.withColumn("label", label)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == expect


def test_blocks_far_apart_are_not_read(spark, monkeypatch):
    """Tight clusters on a circle of lists: the work grows with the near pairs; no link is lost."""
    monkeypatch.setattr(embeddings, "LIST_SIZE", 8)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 12))
    rows = [(i, (centres[i % 40] + 0.02 * rng.normal(size=12)).tolist(), 1) for i in range(400)]
    quantiser = embeddings.Quantiser.fitted(embeddings._unit(centres), 40)
    far = {"la": [0], "lb": [1], "ra": [0.05], "rb": [0.05]}
    assert embeddings._apart(quantiser, far, 0.37) and not embeddings._apart(quantiser, far | {"lb": [0]}, 0.37)
    assert {i: (r["n_links"], r["component_id"]) for i, r in found(spark, rows).items()} == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [3e38, 0.0], 1), (12, [1e-38, 1e-40], 1), (13, [1.0, 0.0], 2)]
    got = {i: (r["n_links"], r["component_id"]) for i, r in found(spark, rows).items()}
    assert got[1] == (3, 1) and got[2] == (3, 1) and got[11] == (3, 1) and got[12] == (3, 1)
    assert all(got[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 13))
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1, 0, ""), (1, [1.0, 0.0], 1, 0, ""), (None, [1.0, 0.0], 1, 0, "")], SCHEMA)
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in embeddings.near_duplicates(twice).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert embeddings.near_duplicates(twice.limit(0)).count() == 0
