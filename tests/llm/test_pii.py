"""op1."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    """The contract's patterns, straight."""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text("@.a-_%+ 019()5é\n", max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["x.y@mail.example.com", "10.1.2.3", "999.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 123-4567", "a@b", "..", "word", "1.2.3.4.5.6.7.8", "@"]), max_size=8), st.sampled_from([" ", "", ",", "\n"]))
def test_base_spans_of_real_forms(parts, glue):
    text = glue.join(parts)
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1(" * 70_000, "@" * 100_000, "a.b@" * 50_000):
        pii.tokens(text, pii.base_spans(text))


def test_find(docs, spark):
    rows = {r["doc_id"]: r for r in pii.find(docs).collect()}
    for d in docs.collect():
        r, spans = rows[d["doc_id"]], plain(d["text"])
        told = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[1] == i for x in spans) for i in range(4)]
        all_spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in all_spans if not x.startswith("id:")] == (told.split(",") if told else []) and len(all_spans) == len(spans) + r["n_id"]


def bootstrapped(spark):
    """Members are numbers behind a cue; some have a form that no base pattern knows."""
    rows = [(i, f"alpha beta contact 10.0.{i % 200}.{i % 7} thanks gamma") for i in range(40)]
    rows += [(100 + i, f"delta contact Z{i}9Q77 thanks epsilon") for i in range(3)]
    rows += [(200 + i, f"released in version {i}.0 of the year {1900 + i} thanks") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_unseen_identifiers_are_discovered(spark):
    rows = {r["doc_id"]: r for r in pii.find(bootstrapped(spark)).collect()}
    assert [rows[100 + i]["spans"] for i in range(3)] == [f"id:14:{19 + len(str(i))}" for i in range(3)]
    assert all(rows[200 + i]["spans"] == "" for i in range(40)) and all(rows[i]["n_ip"] == 1 for i in range(40))


def test_redaction(spark):
    df = bootstrapped(spark)
    masked = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert masked[100] == "delta contact <ID> thanks epsilon" and masked[0] == "alpha beta contact <IP> thanks gamma" and "version 3.0" in masked[203]
    # No name of a column is used inside in a way that would clash; repeated rows are masked each.
    names = ["digest", "extra", "span", "part", "row", "extra_", "Digest_", "__digest", "__extra"]
    more = df.union(df).select("*", *[F.lit(n).alias(n) for n in names])
    rows = pii.redact(more).collect()
    assert len(rows) == 2 * df.count() and all(r["text"] == masked[r["doc_id"]] and all(r[n] == n for n in names) for r in rows)


def plain_word(token):
    word = re.sub(r"\d", "0", re.sub(r"^[\W_]+|[\W_]+$", "", token.lower()))
    return word if len(word) <= pii.LONG else hashlib.blake2b(word.encode(), digest_size=16).hexdigest()


def plain_tokens(text):
    """(start, end, identifier, known, patterns) of seeds and candidates, by splitting the text at each."""
    base = plain(text)
    out = [(s, e, text[s:e].lower(), True) for s, _, e in base]
    for m in re.finditer(r"\S+", text):
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", m.group())
        if re.search("[0-9]", bare) and not any(s < m.end() and e > m.start() for s, _, e in base):
            at = text.index(bare, m.start())
            out.append((at, at + len(bare), bare.lower(), False))
    rows = []
    for s, e, ident, known in out:
        left, right = re.split(r"\s+", text[:s].rstrip())[-1], re.split(r"\s+", text[e:].lstrip())[0]
        rows.append((s, e, ident, known, ["L:" + plain_word(left), "R:" + plain_word(right)]))
    return rows


def plain_graph(texts):
    """Rounds over dictionaries: the identifiers that are chosen."""
    edges = Counter((p, i, known) for t in texts for _, _, i, known, ps in plain_tokens(t) for p in ps)
    score = {}
    for _, i, known in edges:
        score[i] = max(score.get(i, 0.0), float(known))
    seeds = {i for i, x in score.items() if x == 1}
    for _ in range(pii.ROUNDS):
        around = defaultdict(list)
        for p, i, _ in edges:
            around[p].append(score.get(i))
        around = {p: [x for x in xs if x is not None] for p, xs in around.items()}
        pattern = {p: (sum(xs) / len(xs), sum(x >= pii.ID_SCORE for x in xs)) for p, xs in around.items() if xs}
        told = {p: x if n >= pii.SUPPORT else 0.0 for p, (x, n) in pattern.items()}
        sums = defaultdict(lambda: [0.0, 0])
        for (p, i, known), n in edges.items():
            if not known and p in told:
                sums[i, p[0]][0] += n * told[p]
                sums[i, p[0]][1] += n
        score = dict.fromkeys(seeds, 1.0)
        for (i, _), (x, n) in sums.items():
            if i not in seeds:
                score[i] = max(score.get(i, 0.0), x / n)
    good = {p for p, (x, n) in pattern.items() if n >= pii.SUPPORT and x >= pii.PATTERN_SCORE}
    return {i for p, i, known in edges if not known and p in good and score.get(i, 0) >= pii.ID_SCORE}


def test_the_graph_equals_dictionaries(spark):
    rng = random.Random(3)
    words = ["call", "mail", "id", "of", "the", "room", "from", "to"]
    one = lambda: rng.choice([f"10.{rng.randrange(9)}.{rng.randrange(99)}.1", f"a{rng.randrange(50)}@b.org", f"X{rng.randrange(30)}", f"{rng.randrange(40)}", rng.choice(words), f"+1 ({rng.randrange(200, 999)}) 555-0199"])
    texts = [" ".join([rng.choice(words), one(), rng.choice(words), rng.choice(["id:", "id", "code"]), rng.choice([f"10.0.0.{rng.randrange(99)}", f"X{rng.randrange(30)}"]), rng.choice(["end", "end."]), one()]) for _ in range(150)]
    found = pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    expect = plain_graph(texts)
    assert {r["ident"] for r in pii.chosen_ids(found).collect()} == {pii._ident(i) for i in expect} and len(expect) > 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["call", "Call:", "(me", "now", "a@b.org", "x@y", "Z9", "-", "ümlaut", "@joe", "w" * 70]), max_size=8).map(" ".join), max_size=4), st.integers(1, 50))
def test_neighbours(texts, memo):
    """Against the contexts of each token without a digit that isn't in a base identifier."""
    cues = {f"{side}:{w}" for side in "LR" for w in ("call", "now", "joe", plain_word("w" * 70))}
    expect = set()
    for text in texts:
        base = plain(text)
        for m in re.finditer(r"\S+", text):
            bare = re.sub(r"^[\W_]+|[\W_]+$", "", m.group())
            if bare and not re.search("[0-9]", bare) and not any(s < m.end() and e > m.start() for s, _, e in base):
                at = text.index(bare, m.start())
                expect |= {(pii._key_of(c), pii._ident(bare)) for c in pii.Places(text).context(at, at + len(bare)) if c in cues}
    bits = bytearray(pii.BITS // 8)
    for c in cues:
        for at in (pii._key_of(c) % pii.BITS, (pii._key_of(c) >> 29) % pii.BITS):
            bits[at >> 3] |= 1 << (at & 7)
    neighbours = pii.Neighbours(bytes(bits))
    got = set()
    for text in texts:
        got |= set(zip(*(x.tolist() for x in neighbours.of([text]))))
    assert got == expect == set(zip(*(x.tolist() for x in pii.Neighbours(bytes(bits)).of(texts))))


def test_filters(spark):
    """The filter that Spark makes holds the keys that Python looks up."""
    words = ["L:the", "R:über", "L:" + "x" * 40]
    bits = pii.members(spark.createDataFrame([(w,) for w in words], "p string").select(pii.pattern_key(F.col("p"))))
    assert all(pii.may_hold(bits, pii._key_of(w)) for w in words) and sum(pii.may_hold(bits, pii._key_of(f"L:{i}")) for i in range(2000)) < 5
    assert not any(pii.members(spark.createDataFrame([], "k long")))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["x.y@mail.org", "10.1.2.3", "Z9", "word", "(Q7)", "1234", "-", "x" * 70]), max_size=7), st.sampled_from([" ", "   ", " " * 90, "\n"]))
def test_contexts(parts, glue):
    """The next word on either side, however far away and however long."""
    text = glue.join(parts)
    got = [(t["start"], t["end"], pii._ident(text[t["start"] : t["end"]]), t["known"], t["context"]) for t in pii.tokens(text, pii.base_spans(text))]
    assert sorted(got) == sorted((s, e, pii._ident(text[s:e]), k, c) for s, e, _, k, c in plain_tokens(text))


def test_odd_rows(odd_docs, no_docs):
    found = pii.find(odd_docs)
    assert found.count() == odd_docs.count() and pii.find(no_docs).count() == 0
    nine = found.where("doc_id = 9").first()
    assert (nine["n_email"], nine["n_phone"]) == (1, 1)
    masked = pii.redact(odd_docs)
    assert masked.columns == odd_docs.columns and masked.count() == odd_docs.count()
    r = masked.where("doc_id = 9").first()
    assert r["text"].endswith("mail <EMAIL> <PHONE>") and r["n_chars"] == len(r["text"]) and r["score"] == 1.0
    assert masked.where("doc_id = 3").first()["text"] is None and pii.redact(no_docs).count() == 0


def test_identifiers_without_a_digit_are_discovered(spark):
    """A handle behind a cue is an identifier; a common word there isn't."""
    rows = [(i, f"alpha beta contact 10.0.{i % 200}.{i % 7} thanks gamma") for i in range(40)]
    rows += [(100, "delta contact @janedoe thanks epsilon"), (101, "delta contact us thanks epsilon")]
    rows += [(200 + i, f"they told us a story of {w} and us again") for i, w in enumerate(["snow", "rain", "wind"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["spans"], r["n_id"]) for r in pii.find(df).collect()}
    assert got[100] == ("id:15:22", 1) and got[101] == ("", 0) and all(got[200 + i] == ("", 0) for i in range(3))
    masked = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert masked[100] == "delta contact @<ID> thanks epsilon" and masked[101] == rows[41][1]


def test_a_hot_identifier_suppresses_no_other(spark):
    rows = [(i, f"alpha contact 10.0.{i}.1 thanks") for i in range(40)] + [(100 + i, "delta contact Z9Q77 thanks") for i in range(400)] + [(900, "delta contact Z8Q77 thanks")]
    got = {r["doc_id"]: r["n_id"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == got[900] == 1
