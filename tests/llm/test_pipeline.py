"""The stages one by one against plain statements of what they decide."""

import re

import corpus_pipeline
import __spark_entry__ as entry
from brindle.llm import common, decontamination, queries
from test_minhash import plain_components, plain_set
from test_pii import plain as plain_spans

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.materialise(stage(spark, docs, sf), f"test-{name}")
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    clean = {r["doc_id"] for r in kept["toxicity"][1].collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(1 for i, y in toxic.items() if not y and i in clean) >= 0.97 * sum(1 for y in toxic.values() if not y)
    before, after = kept["near_duplicates"]
    roots = plain_components({r["doc_id"]: plain_set(r["text"]) for r in before.collect()})
    assert sorted(r["doc_id"] for r in after.collect()) == [i for i in sorted(roots) if roots[i] == i]
    before, after = kept["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    matcher = decontamination.Matcher(items)
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect() if not matcher.find(r["text"])}
    clean_texts = [decontamination.normal(r["text"]) for r in after.collect()]
    assert not any(decontamination.normal(t) in text for text in clean_texts for _, t in items)
    before, after = kept["personal_data"]
    texts = {r["doc_id"]: r["text"] for r in after.collect()}
    for r in before.collect():
        text, out = texts[r["doc_id"]], r["text"]
        assert not re.search(EMAIL, text) and text.count("<EMAIL>") >= sum(k == 0 for _, k, _ in plain_spans(out))
    before, after = kept["packing"]
    assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == set(texts)



def test_registered(spark, sf):
    names = entry.queries()
    assert {"pipeline", *queries.QUERIES} <= set(names) and len([n for n in names if re.match(r"op\d+_", n)]) == 10


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 0 and rows.schema.names[:3] == ["doc_id", "start", "length"]
