"""op2."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import decontamination as d

WORD = st.text("abc d", max_size=14)


def edit(item, text):
    """Least edit distance of the item to any substring, by the full table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i - 1] + (x != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=400, deadline=None)
@given(WORD, st.text("abc d", max_size=40))
def test_myers(item, text):
    assert d.distance(item, text) == edit(item, text)


def test_pieces():
    k, parts = d.pieces("x" * 100)
    assert k == 8 and len(parts) == 9 and "".join(p for _, p in parts) == "x" * 100
    assert d.pieces("short item")[0] == 0 and d.pieces("x" * 39)[0] == 3


def mutate(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice("xyz")
        elif kind == 1:
            out.insert(i, rng.choice("xyz"))
        elif len(out) > 1:
            del out[i]
    return "".join(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randrange(8, 30))) for i in range(12)] + [(50, "tiny text"), (51, None), (52, " "), (53, None)]
    items.append((60, items[0][1]))
    rows = []
    for i in range(60):
        item = items[i % 12][1]
        rows.append((i, f"{prose(20)} {mutate(rng, item, rng.randrange(0, 2 + len(item) // 12))} {prose(20)}"))
    rows += [(70, items[1][1].upper().replace(" ", "\n  ")), (71, None), (72, ""), (73, "some TINY   text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["budget"]) for r in d.matches(docs, bench).collect()}
    expect = {}
    for i, text in rows:
        for j, item in items:
            clean = d.normal(item or "")
            if text and clean:
                k = d.pieces(clean)[0]
                n = edit(clean, d.normal(text))
                if n <= k:
                    expect[i, j] = (n, k)
    assert got == expect and (70, 1) in got and (73, 50) in got and len(got) > 30
    kept = {r["doc_id"] for r in d.drop_contaminated(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in expect}


def test_shards(spark, sf, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    one, many = d.shards(bench), d.shards(bench, chars=2000)
    assert len(one) == 1 and len(many) > 3 and sorted(sum(map(d.read_shard, many), [])) == sorted(d.read_shard(one[0]))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found, kept = sorted(map(tuple, d.matches(docs, bench).collect())), sorted(r["doc_id"] for r in d.drop_contaminated(docs, bench).collect())
    real = d.shards
    monkeypatch.setattr(d, "shards", lambda b: real(b, chars=2000))
    assert sorted(map(tuple, d.matches(docs, bench).collect())) == found and sorted(r["doc_id"] for r in d.drop_contaminated(docs, bench).collect()) == kept


def test_short_items_have_a_budget(spark):
    """One letter dropped from an item of 39 and of 40 characters."""
    item = "the small grey heron waits by the brook"
    assert len(item) == 39
    docs = spark.createDataFrame([(1, f"so {item[:20]}{item[21:]} again"), (2, f"so {item[:20]}{item[21:]}s again")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item + "s")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): (r["distance"], r["budget"]) for r in d.matches(docs, bench).collect()} == {(1, 1): (1, 3), (1, 2): (2, 3), (2, 1): (1, 3), (2, 2): (1, 3)}


def test_odd_rows(spark, sf, odd_docs, no_docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert d.matches(no_docs, bench).count() == 0 and d.matches(odd_docs, bench.limit(0)).count() == 0
    kept = d.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    fox = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in d.matches(odd_docs, fox).collect()) == [1, 2, 2]
