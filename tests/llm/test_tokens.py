"""op4, op6, op10: encoding, packing, Arrow files, separator scan."""

import ctypes
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm import arrow_tokens, common, encoding, packing, token_counts
from brindle.llm.encoding import Encoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ENCODERS = {n: Encoder(n, "<u2", 1) for n in NAMES}
#: Flags untouched: the library's plain call.
PLAIN = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in NAMES}
#: Digits as letters.
LETTERS = str.maketrans("0123456789", "qrstuvwxyz")
SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "a <|endoftext|> b"]

TEXT = st.text(st.one_of(st.sampled_from(" \n\t.,'abcdeAB19é́　\x0b\x7f\x1c\x85|<>Σς"), st.characters(codec="utf-8")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4), st.sampled_from(NAMES))
def test_pieces_give_the_ids_of_the_whole_text(texts, name):
    got = [np.frombuffer(b, "<u2").tolist() for b in ENCODERS[name].encode(texts)]
    assert got == [PLAIN[name].encode(t, add_special_tokens=False).ids + [1] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(TEXT, st.sampled_from(SPECIAL)), max_size=4).map("".join), max_size=4), st.sampled_from(NAMES))
def test_special_tokens_as_in_the_plain_call(texts, name):
    got = [np.frombuffer(b, "<u2").tolist() for b in ENCODERS[name].encode(texts)]
    assert got == [PLAIN[name].encode(t, add_special_tokens=False).ids + [1] for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_forms_of_a_word_are_one_entry(name):
    """Marks behind a word are no reason to encode it again."""
    coder = Encoder(name, "<u2", 1)
    words = [f"so{a}{b}ro" for a in "abcdefgh" for b in "klmnèß"]
    texts = ["x " + " ".join(w + tail for w in words) for tail in ["", ",", ".", "!!", ".%%%", "&&&", ":"]]
    assert [np.frombuffer(b, "<u2").tolist() for b in coder.encode(texts)] == [PLAIN[name].encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert len(coder.memo) <= len(words) + 2


@pytest.mark.parametrize("name", NAMES)
def test_every_letter_and_mark_of_plain_words(name):
    letters = [chr(i) for i in range(0x250, 0x600)] + [chr(i) for i in range(0x21, 0x250)]
    texts = [f"{c} a{c}b {c}{c.upper()}{c.lower()}\na{c} b{c}, {c}a.\n{c}" for c in letters] + [f"a{m} bé{m}{m}{m}\nab{m}{m}{m}{m} {m}" for m in map(chr, range(0x21, 0x7F))]
    got = [np.frombuffer(b, "<u2").tolist() for b in ENCODERS[name].encode(texts)]
    assert got == [PLAIN[name].encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_memory_is_bounded_and_keeps_what_is_met(monkeypatch):
    monkeypatch.setattr(encoding, "MEMO_PIECES", 20)
    coder, merged = Encoder(NAMES[0], "<u2", 1), []
    monkeypatch.setattr(coder, "_merge", lambda words, f=coder._merge: (merged.extend(words), f(words))[1])
    for i in range(50):
        text = f"x common w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}"
        assert np.frombuffer(coder.encode([text])[0], "<u2").tolist() == [*PLAIN[NAMES[0]].encode(text, add_special_tokens=False).ids, 1]
        assert len(coder.memo) + len(coder.old) <= 26
    assert merged.count("common") == 1 and len(merged) == 52


def test_special_tokens_as_text():
    coder, plain = Encoder(NAMES[0], "<u2", 50256, ordinary=True), Tokenizer.from_file(public_tokenizers.path(NAMES[0]))
    plain.encode_special_tokens = True
    ids = np.frombuffer(coder.encode(["a <|endoftext|> b"])[0], "<u2").tolist()
    assert ids == [*plain.encode("a <|endoftext|> b", add_special_tokens=False).ids, 50256] and ids.count(50256) == 1


def ids_of(df, name, end, ordinary=False):
    coder = Tokenizer.from_file(public_tokenizers.path(name))
    coder.encode_special_tokens = ordinary
    return [(r["doc_id"], coder.encode(r["text"] or "", add_special_tokens=False).ids + [end]) for r in df.select("doc_id", "text").collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("window", [7, 2048])
def test_packing(odd_docs, window):
    rows = packing.pack(odd_docs, window=window).collect()
    pieces = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in pieces:  # gapless, no sequence longer than the window, all but the last full
        assert (r["sequence_id"], r["offset"]) == divmod(at, window) and r["offset"] + r["length"] <= window and r["length"] > 0
        at += r["length"]
    docs = ids_of(odd_docs, packing.TOKENIZER, packing.END_ID)
    assert at == sum(len(x) for _, x in docs)
    for r in sorted(rows, key=lambda r: r["start"]):
        ids = np.frombuffer(bytes(r["ids"]), "<u2").tolist()
        assert len(ids) == r["length"] and crc(ids) == r["ids_crc32"]
    by_doc = {}
    for d, x in docs:
        by_doc.setdefault(d, []).append(x)
    for d, xs in by_doc.items():
        own = [r for r in rows if r["doc_id"] == d]
        assert sum(r["length"] for r in own) == sum(map(len, xs)) and {r["doc_tokens"] for r in own} == {len(x) for x in xs}
        if len(xs) == 1:
            own.sort(key=lambda r: r["start"])
            assert sum((np.frombuffer(bytes(r["ids"]), "<u2").tolist() for r in own), []) == xs[0]
    seqs = packing.sequences(packing.pack(odd_docs, window=window)).collect()
    assert sum(r["n_tokens"] for r in seqs) == at and sorted(r["sequence_id"] for r in seqs) == list(range(-(-at // window)))


def test_packing_leaves_no_freed_memory_in_a_worker(spark):
    """Of 24 MB of texts with many different words, what was freed on the way isn't held by the worker."""

    def held(batches):
        def mb():
            return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

        words = np.array([f"w{i}abcd".translate(LETTERS) for i in range(400_000)], object)
        texts = pa.array([" ".join(np.random.default_rng(seed).choice(words, 120_000)) for seed in range(24)])
        for _ in packing._runs(packing.TOKENIZER, packing.END_ID)([pa.record_batch([pa.array(range(24)), texts], ["doc_id", "text"])]):
            pass
        before = mb()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        yield pa.record_batch([pa.array([before - mb()])], ["mb"])

    [row] = spark.range(0, 1, 1, 1).mapInArrow(held, "mb double").collect()
    assert row["mb"] < 24


def test_cutting_needs_no_encoder_and_goes_by_few_documents(monkeypatch):
    monkeypatch.setattr(packing, "CUT_ROWS", 2)
    encoding.encoder(packing.TOKENIZER, "<u2", packing.END_ID)
    sizes = [3, 1, 10, 4, 2]
    runs = [np.arange(n, dtype="<u2").tobytes() for n in sizes]
    batch = pa.record_batch([pa.array(range(5)), pa.array(sizes), pa.array(runs, pa.binary()), pa.array(np.cumsum(sizes) - sizes)], ["doc_id", "n_tokens", "ids", "g"])
    out = list(packing._cut(4, True)([batch]))
    assert not encoding._ENCODERS and len(out) == 3
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["sequence_id"], r["offset"]) for r in rows] == [divmod(at, 4) for at in np.cumsum([0, *(r["length"] for r in rows[:-1])]).tolist()]
    assert [b"".join(r["ids"] for r in rows if r["doc_id"] == d) for d in range(5)] == runs


def test_packing_nothing(no_docs):
    assert packing.pack(no_docs).count() == 0


def test_arrow_round_trip(spark, odd_docs):
    index = arrow_tokens.write_tokens(odd_docs, common.fresh_dir(spark, "t"), length=16)
    rows = sorted(arrow_tokens.read_checksums(index).collect(), key=lambda r: r["start"])
    docs = sorted(ids_of(odd_docs, arrow_tokens.TOKENIZER, arrow_tokens.END_ID), key=lambda d: (d[0] is not None, d[0] or 0))
    at = 0
    for r, (d, ids) in zip(rows, docs, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), crc(ids))
        at += len(ids)


def test_arrow_files_are_equal_rows_that_share_memory(spark, docs):
    index = arrow_tokens.write_tokens(docs.limit(20), common.fresh_dir(spark, "t"), length=64)
    uri = index.first()["file"]
    f = arrow_tokens.TokenFile(uri)
    assert f.reader.schema.field("ids").type == pa.list_(pa.field("item", pa.uint16(), nullable=False), 64)
    before = pa.total_allocated_bytes()
    ids, mask = f.sequence(1)
    assert len(ids) == 64 and len(mask) == 64 and ids.base is not None and pa.total_allocated_bytes() == before
    total = sum(f.reader.get_batch(i).column("mask").values.to_numpy(zero_copy_only=False).sum() for i in range(f.reader.num_record_batches))
    assert total == sum(r["n_tokens"] for r in index.where(index["file"] == uri).collect())


def test_arrow_nothing(spark, no_docs):
    assert arrow_tokens.read_checksums(arrow_tokens.write_tokens(no_docs, common.fresh_dir(spark, "t"))).count() == 0


@pytest.mark.parametrize("block", [1, 3, 50, 1 << 20])
def test_counts(spark, odd_docs, block):
    few = odd_docs.where("n_chars < 1000 OR n_chars IS NULL") if block < 50 else odd_docs
    files, roster = token_counts.write_flat(few, common.fresh_dir(spark, "t"))
    found = roster.join(token_counts.count_tokens(files, block=block), ["file", "ordinal"]).collect()
    expect = sorted((d is not None, d or 0, len(x)) for d, x in ids_of(few, token_counts.TOKENIZER, token_counts.END_ID, ordinary=True))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in found) == expect
    assert token_counts.open_tail(files, block=block).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.integers(1, 7))
def test_separator_scan(spark, tmp_path_factory, ids, block):
    path = tmp_path_factory.mktemp("flat") / "f.u16"
    path.write_bytes(np.array(ids, "<u2").tobytes())
    files = spark.createDataFrame([(f"file://{path}", len(ids))], "file string, n_ids long")
    expect, n = [], 0
    for x in ids:
        n += 1
        if x == 0:
            expect.append(n)
            n = 0
    got = sorted(token_counts.count_tokens(files, end_id=0, block=block).collect(), key=lambda r: r["ordinal"])
    assert [(r["ordinal"], r["n_tokens"]) for r in got] == list(enumerate(expect))
    assert [r["n_open"] for r in token_counts.open_tail(files, 0, block).collect()] == ([n] if n else [])


def test_scan_tasks_follow_the_bytes(spark, monkeypatch):
    """Files of 4 GB in blocks of 8 MB: at least a task for each 128 MB."""
    files = spark.createDataFrame([("a", 1 << 30), ("b", 1 << 30)], "file string, n_ids long")
    blocks = token_counts.blocks_of(files)
    assert blocks.count() == 512 and blocks.rdd.getNumPartitions() >= 32
    sizes = blocks.rdd.mapPartitions(lambda rows: [sum(r["n"] for r in rows) * 2]).collect()
    assert max(sizes) <= 128 << 20


def test_counts_of_nothing(spark, no_docs):
    files, roster = token_counts.write_flat(no_docs, common.fresh_dir(spark, "t"))
    assert roster.count() == 0 and token_counts.count_tokens(files).count() == 0
