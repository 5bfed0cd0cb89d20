"""op7: held-out accuracy, the fold, and defined results."""

import math
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import toxicity as t


def test_fold(spark):
    df = spark.range(500).select("id", t.in_held_out(F.col("id")).alias("h"))
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in df.collect())


def made(spark, n=1200):
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(400)]
    bad = ["vileness", "vilest", "vilely", "awful", "grim beast"]
    rows, labels = [], []
    for i in range(n):
        text = [words[k] for k in rng.integers(0, 400, rng.integers(3, 200))]
        toxic = int(rng.random() < 0.15)
        if toxic:
            for _ in range(2):
                text.insert(int(rng.integers(0, len(text))), str(rng.choice(bad)) + ",")
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), [y for *_, y in labels]


def test_held_out_accuracy(spark):
    docs, labels, truth = made(spark)
    rows = [r for r in t.classify(docs, labels).collect() if r["held_out"]]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in rows)
    caught = sum(r["predicted"] for r in rows if truth[r["doc_id"]])
    assert right >= 0.97 * len(rows) and caught >= 0.9 * sum(truth[r["doc_id"]] for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    kept = {r["doc_id"] for r in t.keep_clean(docs, labels).collect()}
    assert sum(truth[i] for i in kept) <= 0.1 * sum(truth) and len(kept) >= 0.98 * (len(truth) - sum(truth))


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    docs, labels, _ = made(spark, 300)
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(encode(string(doc_id), 'UTF-8')) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = t.train(docs, labels), t.train(docs, turned)
    assert a.places.tolist() == b.places.tolist() and a.weights.tolist() == b.weights.tolist() and a.intercept == b.intercept


def scalar_ftrl(rows, epochs):
    """The published recursion, one coordinate at a time over dictionaries; the bias is a coordinate without L1."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == "bias" else t.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((t.BETA + math.sqrt(n[i])) / t.ALPHA + t.L2)

    for _ in range(epochs):
        for places, label in rows:
            w = {i: weight(i) for i in [*places, "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i, x in w.items():
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / t.ALPHA
                z[i] += g - sigma * x
                n[i] += g * g
    return z, n, {i: weight(i) for i in list(z)}


def test_ftrl_equals_the_scalar_form():
    rng = np.random.default_rng(8)
    rows = [(sorted(rng.choice(60, rng.integers(0, 20), replace=False).tolist()), int(rng.random() < 0.3)) for _ in range(400)]
    rows = [([*p, 100] if y else p, y) for p, y in rows]
    model = t.Ftrl()
    for _ in range(2):
        for places, label in rows:
            model.learn(np.array(places, int), label)
    z, n, w = scalar_ftrl(rows, 2)
    for i in range(101):
        assert math.isclose(model.z[i], z.get(i, 0.0), abs_tol=1e-9) and math.isclose(model.n[i], n.get(i, 0.0), abs_tol=1e-9)
    places, weights, bias = model.weights()
    assert {i: x for i, x in w.items() if x and i != "bias"}.keys() == set(places.tolist()) and 100 in places
    assert np.allclose(weights, [w[i] for i in places.tolist()]) and math.isclose(bias, w["bias"], abs_tol=1e-9)


def test_trained_as_the_scalar_form(spark):
    """The whole of train() against features and recursion written out for the same rows in the same order."""
    docs, labels, truth = made(spark, 200)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = [r["id"] for r in spark.range(200).where(~t.in_held_out(F.col("id"))).orderBy(F.xxhash64("id", F.lit(1)), "id").collect()]
    features, rows = t.Features(), []
    for i in order:
        rows.append((sorted(set(features.of([texts[i]])[1].tolist())), truth[i]))
    _, _, w = scalar_ftrl(rows, t.EPOCHS)
    model = t.train(docs, labels)
    expect = {i: x for i, x in w.items() if x and i != "bias"}
    assert dict(zip(model.places.tolist(), model.weights.tolist())).keys() == expect.keys()
    assert all(math.isclose(x, expect[i], rel_tol=1e-6) for i, x in zip(model.places.tolist(), model.weights.tolist()))


@given(st.sets(st.integers(0, (1 << t.BITS) - 1)))
def test_places_are_packed(places):
    assert t.unpack_places(t.pack_places(np.array(sorted(places), np.int64))).tolist() == sorted(places)


def test_names_of_columns_do_not_clash(spark):
    docs, labels, _ = made(spark, 100)
    names = ["__text", "__toxicity", "toxicity", "text_", "score", "toxic", "places"]
    kept = t.keep_clean(docs.select("*", *[F.lit(n).alias(n) for n in names]), labels)
    rows = kept.collect()
    assert kept.columns == ["doc_id", "text", *names] and rows and all(r[n] == n for r in rows for n in names)


def test_sparse_and_repeatable(spark):
    docs, labels, _ = made(spark, 600)
    a, b = t.train(docs, labels), t.train(docs.repartition(5), labels.repartition(3))
    assert a.weights.tolist() == b.weights.tolist() and 0 < len(a.places) < 2000


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (5, None), (77, 1), (9, 0)], "doc_id long, toxic int")
    rows = t.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(r["score"] is not None for r in rows)
    assert t.classify(no_docs, labels).count() == 0
    none = t.classify(odd_docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0} and {r["predicted"] for r in none} == {0}
    kept = t.keep_clean(odd_docs, labels.limit(0))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
