"""Repeated byte strings: every byte covered by a string that starts earlier too.

A string of ``LENGTH`` bytes is judged by content-defined anchors instead of a full
suffix array (the README says why, with figures).  Of the ``LENGTH - GRAM + 1``
grams of ``GRAM`` bytes in a string the one with the least hash, the leftmost if
several, is its anchor, so equal strings have equal anchors at equal places and a
gram that occurs once settles about ``LENGTH - GRAM`` strings at once.

1. Each task copies its documents to a compressed shard file and finds their
   anchors.  The context of an anchor is all that strings with this anchor can
   cover.  An anchor whose context occurred earlier in the task's block makes all
   its strings repeats.  Of the others one row for each gram is passed on.
2. Those rows are dealt out by gram.  A gram brings one row for each block, however
   often it occurs.  Equal contexts make all but the first occurrence repeats;
   grams with unequal contexts are to be checked string by string.
3. Only there the contexts are read from the shards and dealt out by gram; of equal
   strings all but the first are repeats.  A gram with more than ``HOT`` contexts is
   dealt out string by string instead, after each task has compared its own.
4. The repeats' intervals go back to their shards, are merged, and each document is
   cut.

Strings are equal if two hashes of 64 bits are, that of their gram and that of the whole,
made from two polynomials and scrambled; within a block of one task that of the whole alone.
Of ``m`` different strings of one gram ``m * m / 2**65`` pairs are expected to be taken for
equal: 3e-4 for a gram with 10**8.

Defined results: a null text is the empty one and loses nothing; texts under
``LENGTH`` bytes lose nothing; "earlier" is by ``doc_id``, then by place; rows with one
``doc_id`` are in the order of the scan; a null ``doc_id`` comes first; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .induced import Numbers, Sorter, Store, sort_suffixes
from .shingles import mix

LENGTH, GRAM = 100, 32
#: Raw bytes in a compressed block of a shard; anchors in a block of the first comparison.
BLOCK_BYTES, BLOCK_ANCHORS = 1 << 18, 400_000
#: String hashes that a checking task compares at once.
BLOCK_STRINGS = 400_000
#: Contexts of one gram that a task may hold.
HOT = 50_000
DOC, SINGLE, MIXED, CHECK, REPEAT, SHARD = range(6)
#: ``key``: what a row is dealt out by, the gram where there is one.
FOUND = "kind int, key long, context long, doc_id long, part long, at long, x long, y long, file string"
JUDGED = "kind int, gram long, doc_id long, part long, at long, x long, y long, file string"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
FIELDS = [c.split()[0] for c in FOUND.split(", ")]

_RNG = np.random.Generator(np.random.PCG64(2024))
_TABLES = [_RNG.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class _Powers:
    """Powers of the two bases and of their inverses modulo 2**64."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, [], []

    def reach(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            rows = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n, b, np.uint64)]))
            self.up = [rows(b) for b in _BASES]
            self.down = [rows(pow(b, -1, 1 << 64)) for b in _BASES]


_POWERS = _Powers()


class Hasher:
    """Hashes of any substrings of a byte array, from prefix sums of two polynomials."""

    def __init__(self, data: np.ndarray) -> None:
        _POWERS.reach(len(data))
        self.sums = []
        for table, up in zip(_TABLES, _POWERS.up):
            s = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * up[: len(data)], out=s[1:])
            self.sums.append(s)

    def grams(self, size: int) -> np.ndarray:
        """The first polynomial of every substring of ``size`` bytes."""
        s = self.sums[0]
        return (s[size:] - s[:-size]) * _POWERS.down[0][: len(s) - size]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scrambled hashes of the substrings [start, end)."""
        a, b = ((s[end] - s[start]) * down[start] for s, down in zip(self.sums, _POWERS.down))
        return mix(mix(a) + b * np.uint64(_BASES[1]) + (end - start).astype(np.uint64))


def anchors(hasher: Hasher, n: int, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The anchors of the strings of the documents [starts, ends) of ``n`` bytes.

    ``at``: where the gram lies; ``x, y``: how far before it the first and the last of its
    strings start; ``gram, context``: hashes; ``doc``: the document's number.
    """
    strings = LENGTH - GRAM + 1
    long = ends - starts >= LENGTH
    empty = {k: np.zeros(0, np.int64) for k in ("at", "x", "y", "gram", "context", "doc")}
    if n < LENGTH or not long.any():
        return empty
    grams = mix(hasher.grams(GRAM))
    low = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= strings:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if strings > width:
        low = np.minimum(low[: len(low) - (strings - width)], low[strings - width :])
    chosen = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Strings that lie in one document: runs of starts from each long document.
    first, count = starts[long], (ends - starts)[long] - LENGTH + 1
    q = np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)
    doc = np.repeat(np.flatnonzero(long), count)
    p = chosen[q]
    head = np.ones(len(q), bool)
    head[1:] = (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])
    h = np.flatnonzero(head)
    last = np.append(h[1:], len(q)) - 1
    p, doc, x, y = p[h], doc[h], p[h] - q[h], p[h] - q[last]
    left, right = np.maximum(p - (strings - 1), starts[doc]), np.minimum(p + LENGTH, ends[doc])
    context = mix(hasher.of(left, right) + (p - left).astype(np.uint64))
    return {"at": p, "x": x, "y": y, "gram": grams[p].view(np.int64), "context": context.view(np.int64), "doc": doc}


class _Shard:
    """A file of compressed blocks with their places behind; blocks hold whole documents."""

    def __init__(self, uri: str) -> None:
        fs, path = common.filesystem(uri)
        self.uri, self.out, self.rows, self.at, self.raw = uri, fs.open_output_stream(path, compression=None), [], 0, 0
        self.codec = pa.Codec("zstd", compression_level=1)

    def add(self, block: bytes) -> None:
        packed = self.codec.compress(block, asbytes=True)
        self.out.write(packed)
        self.rows.append((self.raw, len(block), self.at, len(packed)))
        self.raw, self.at = self.raw + len(block), self.at + len(packed)

    def close(self) -> None:
        self.out.write(np.array(self.rows, "<i8").reshape(-1, 4).tobytes() + struct.pack("<q", len(self.rows)))
        self.out.close()


class ShardReader:
    """Reads blocks of a shard by raw offset; keeps the last one."""

    def __init__(self, uri: str) -> None:
        fs, path = common.filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n = struct.unpack("<q", self.file.read_at(8, size - 8))[0]
        self.rows = np.frombuffer(self.file.read_at(32 * n, size - 8 - 32 * n), "<i8").reshape(-1, 4)
        self.codec, self.held = pa.Codec("zstd"), (-1, b"")

    def block(self, k: int) -> bytes:
        if self.held[0] != k:
            _, raw, at, size = self.rows[k].tolist()
            self.held = (k, self.codec.decompress(self.file.read_at(size, at), raw, asbytes=True))
        return self.held[1]

    def find(self, at) -> np.ndarray:
        """Numbers of the blocks that hold the raw offsets."""
        return np.searchsorted(self.rows[:, 0], at, side="right") - 1


def _rows(kind: int, n: int, part: int, **columns) -> pa.RecordBatch:
    types = dict(zip(FIELDS, (pa.int32(), *[pa.int64()] * 7, pa.string())))
    given = {"kind": np.full(n, kind, np.int32), "part": np.full(n, part, np.int64), "key": np.full(n, part, np.int64)} | columns
    return pa.record_batch([given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], types[c]) if c in given else pa.nulls(n, types[c]) for c in FIELDS], FIELDS)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as sorted intervals that don't touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    head = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[head], reach[np.append(np.flatnonzero(head)[1:], len(start)) - 1]


def _compare(found: list[dict[str, np.ndarray]], part: int):
    """Local repeats, rows to pass on, and strings to check among a block's anchors."""
    a = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
    order = np.lexsort((a["at"], a["doc_id"], a["has_id"], a["context"]))
    a = {k: v[order] for k, v in a.items()}
    first = np.concatenate([[True], a["context"][1:] != a["context"][:-1]])
    if not first.all():
        s, e = merged((a["at"] - a["x"])[~first], (a["at"] - a["y"] + LENGTH)[~first])
        yield _rows(REPEAT, len(s), part, at=s, x=e)
    a = {k: v[first] for k, v in a.items()}
    order = np.argsort(a["gram"], kind="stable")
    a = {k: v[order] for k, v in a.items()}
    same = a["gram"][1:] == a["gram"][:-1]
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    ids = lambda m: pa.array(a["doc_id"][m], pa.int64(), mask=~a["has_id"][m])
    one = ~many
    yield _rows(SINGLE, int(one.sum()), part, key=a["gram"][one], context=a["context"][one], doc_id=ids(one), at=a["at"][one], x=a["x"][one], y=a["y"][one])
    if many.any():
        grams = np.unique(a["gram"][many])
        yield _rows(MIXED, len(grams), part, key=grams)
        yield _rows(CHECK, int(many.sum()), part, context=a["gram"][many], doc_id=ids(many), at=a["at"][many], x=a["x"][many], y=a["y"][many])


def _scan(folder: str):
    def scan(batches):
        part, shard, found, count = TaskContext.get().partitionId(), None, [], 0
        held, size = [], 0

        def block():
            nonlocal held, size, count
            data = b"".join(t for _, t in held)
            base = shard.raw
            shard.add(data)
            sizes = np.array([len(t) for _, t in held], np.int64)
            ends = np.cumsum(sizes)
            ids = pa.array([i for i, _ in held], pa.int64())
            array = np.frombuffer(data, np.uint8)
            a = anchors(Hasher(array), len(array), ends - sizes, ends)
            doc = a.pop("doc")
            a["doc_id"] = ids.fill_null(0).to_numpy()[doc]
            a["has_id"] = ids.is_valid().to_numpy(zero_copy_only=False)[doc]
            a["at"] = a["at"] + base
            found.append(a)
            count += len(doc)
            out = _rows(DOC, len(held), part, doc_id=ids, at=base + ends - sizes, x=sizes)
            held, size = [], 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if shard is None:
                    shard = _Shard(f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.bin")
                held.append((doc_id, text.encode("utf-8", "surrogatepass")))
                size += len(held[-1][1])
                if size >= BLOCK_BYTES:
                    yield block()
                    if count >= BLOCK_ANCHORS:
                        yield from _compare(found, part)
                        found, count = [], 0
        if held:
            yield block()
        if count:
            yield from _compare(found, part)
        if shard is not None:
            shard.close()
            yield _rows(SHARD, 1, part, file=[shard.uri])

    return scan


def _judge(batches):
    """Verdicts on rows sorted by key, context (flags first), doc_id, part, at; other kinds pass."""
    names = [c.split()[0] for c in JUDGED.split(", ")]
    rest: pa.Table | None = None

    def judge(t: pa.Table):
        kind = t["kind"].to_numpy()
        own = (kind == SINGLE) | (kind == MIXED)
        if not own.all():
            r = t.filter(pa.array(~own))
            yield pa.record_batch([r[c].combine_chunks() for c in ("kind", "context", "doc_id", "part", "at", "x", "y", "file")], names)
            t, kind = t.filter(pa.array(own)), kind[own]
        if not len(kind):
            return
        gram, context = t["key"].to_numpy(), t["context"].fill_null(0).to_numpy()
        mixed = kind == MIXED
        group = np.concatenate([[0], np.cumsum(gram[1:] != gram[:-1])])
        first_of = np.concatenate([[True], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]) | mixed[:-1]])
        contexts = np.bincount(group, first_of & ~mixed)
        flagged = np.bincount(group, mixed) > 0
        check = first_of & ~mixed & (flagged | (contexts > 1))[group]
        if check.any():
            r = t.filter(pa.array(check))
            yield pa.record_batch([pa.array(np.full(r.num_rows, CHECK, np.int32)), *(r[c].combine_chunks() for c in ("key", "doc_id", "part", "at", "x", "y", "file"))], names)
        repeat = ~first_of & ~mixed
        if repeat.any():
            again = t.filter(pa.array(repeat))
            part, at, x, y = (again[c].to_numpy() for c in ("part", "at", "x", "y"))
            n = len(at)
            empty = pa.nulls(n, pa.int64())
            yield pa.record_batch([pa.array(np.full(n, REPEAT, np.int32)), empty, empty, pa.array(part), pa.array(at - x), pa.array(at - y + LENGTH), empty, pa.nulls(n, pa.string())], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        key = t["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1], side="left"))  # the last key may go on
        rest = t.slice(cut)
        if cut:
            yield from judge(t.slice(0, cut))
        if rest.num_rows > BLOCK_ANCHORS and key[-1] == rest["key"][0].as_py() and rest["kind"].to_numpy().max() not in (SINGLE, MIXED):
            yield from judge(rest)  # rows that only pass need not wait
            rest = None
    if rest is not None and rest.num_rows:
        yield from judge(rest)


def _first(h, d, ok, part, q):
    """(order, first of each hash in it) of strings by hash, then doc_id, part, place."""
    order = np.lexsort((q, part, d, ok, h))
    s = h[order]
    return order, np.concatenate([[True], s[1:] != s[:-1]])


def _contexts(batches):
    """What the strings to check of each anchor cover: ``gram, doc_id, part, at, n, data``."""
    for (part,), t in common.groups(batches, ["part"]):
        reader = ShardReader(t["file"][0].as_py())
        at, x, y = (t[c].to_numpy() for c in ("at", "x", "y"))
        blocks, data = reader.find(at), []
        for k, a, b in zip(blocks.tolist(), (at - x).tolist(), (at - y + LENGTH).tolist()):
            base = int(reader.rows[k, 0])
            data.append(reader.block(k)[a - base : b - base])
        yield pa.record_batch([t["gram"].combine_chunks(), t["doc_id"].combine_chunks(), t["part"].combine_chunks(), pa.array(at - x), pa.array(x - y + 1), pa.array(data, pa.binary())], ["gram", "doc_id", "part", "at", "n", "data"])


def _hashes(t):
    """(hash, doc_id, has one, part, place) of every string of rows of contexts."""
    data, n = t["data"].to_pylist(), t["n"].to_numpy()
    hasher = Hasher(np.frombuffer(b"".join(data), np.uint8))
    starts = np.cumsum([0, *map(len, data)])[:-1]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    q = np.repeat(starts, n) + step
    spread = lambda v: np.repeat(v, n)
    # The gram and its place go in, so that only strings of one gram can be equal.
    h = mix(hasher.of(q, q + LENGTH) ^ spread(t["gram"].to_numpy().view(np.uint64)))
    return h.view(np.int64), spread(t["doc_id"].fill_null(0).to_numpy()), spread(t["doc_id"].is_valid().to_numpy()), spread(t["part"].to_numpy()), spread(t["at"].to_numpy()) + step


def _intervals(part, q):
    """Merged intervals of repeated strings as rows ``part, at, x``."""
    order = np.lexsort((q, part))
    part, q = part[order], q[order]
    if not len(q):
        return pa.record_batch([pa.array(part), pa.array(q), pa.array(q)], ["part", "at", "x"])
    head = np.concatenate([[True], (part[1:] != part[:-1]) | (q[1:] > q[:-1] + LENGTH)])
    last = np.append(np.flatnonzero(head)[1:], len(q)) - 1
    return pa.record_batch([pa.array(part[head]), pa.array(q[head]), pa.array(q[last] + LENGTH)], ["part", "at", "x"])


def _within(batches):
    """Repeats among contexts that are sorted by gram: ``part, at, x``."""

    def compare(t):
        h, d, ok, part, q = _hashes(t)
        order, first = _first(h, d, ok, part, q)
        again = order[~first]
        return _intervals(part[again], q[again])

    rest, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        count += int(batch.column("n").to_numpy().sum())
        if count >= BLOCK_STRINGS:
            gram = rest["gram"].to_numpy()
            cut = int(np.searchsorted(gram, gram[-1], side="left"))  # the last gram may go on
            if cut:
                yield compare(rest.slice(0, cut))
                rest = rest.slice(cut)
                count = int(rest["n"].to_numpy().sum())
    if rest is not None:
        yield compare(rest)


def _spread(batches):
    """For hot grams: the first of equal strings in each batch (``hash`` set) and repeats (``x`` set)."""
    names = ["gram", "hash", "doc_id", "part", "at", "x"]
    for batch in batches:
        t = pa.Table.from_batches([batch])
        for at in range(0, t.num_rows, HOT):
            some = t.slice(at, HOT)
            h, d, ok, part, q = _hashes(some)
            gram = np.repeat(some["gram"].to_numpy(), some["n"].to_numpy())
            order, first = _first(h, d, ok, part, q)
            one, again = order[first], order[~first]
            yield pa.record_batch([pa.array(gram[one]), pa.array(h[one]), pa.array(d[one], mask=~ok[one]), pa.array(part[one]), pa.array(q[one]), pa.nulls(len(one), pa.int64())], names)
            r = _intervals(part[again], q[again])
            yield pa.record_batch([pa.nulls(r.num_rows, pa.int64()), pa.nulls(r.num_rows, pa.int64()), pa.nulls(r.num_rows, pa.int64()), r.column("part"), r.column("at"), r.column("x")], names)


def _cut(batches):
    for _, t in common.groups(batches, ["part"]):
        kind, at, x = (t[c].to_numpy() for c in ("kind", "at", "x"))
        reader = ShardReader(t["file"][0].as_py())
        start, end = merged(at[kind == REPEAT], x[kind == REPEAT])
        docs = np.flatnonzero(kind == DOC)
        docs = docs[np.argsort(at[docs], kind="stable")]
        ids = t["doc_id"].combine_chunks().take(pa.array(docs))
        at, n = at[docs], x[docs]
        block = np.minimum(reader.find(at), len(reader.rows) - 1)
        lo, hi = np.searchsorted(end, at, side="right"), np.searchsorted(start, at + n, side="left")
        removed, spans, digests = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64), []
        for i, (s, size, k, a, b) in enumerate(zip(at.tolist(), n.tolist(), block.tolist(), lo.tolist(), hi.tolist())):
            h, here = hashlib.sha256(), s
            if size:
                data, base = memoryview(reader.block(k)), int(reader.rows[k, 0])
                for u, v in zip(start[a:b].tolist(), end[a:b].tolist()):
                    u, v = max(u, s), min(v, s + size)
                    h.update(data[here - base : u - base])
                    here = v
                    removed[i] += v - u
                    spans[i] += 1
                h.update(data[here - base : s + size - base])
            digests.append(h.hexdigest())
        yield pa.record_batch([ids, pa.array(n), pa.array(removed), pa.array(spans), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _repeated(t: Numbers, docs: Store) -> Iterator[int]:
    """Ascending places of the strings in documents that start earlier too."""
    at, group, last, inside = Sorter(), 0, 0, False
    for pos, lcp in sort_suffixes(t):
        if lcp >= LENGTH:
            if not inside:
                group += 1
                at.push((last, group))
            at.push((pos, group))
        last, inside = pos, lcp >= LENGTH
    # Strings that lie in one document; of each group all but the first.
    whole, spans = Sorter(), ((start, start + len(text)) for _, text, start in docs.read())
    start, end = next(spans)
    for pos, group in at:
        while pos >= end:
            start, end = next(spans, (t.n, t.n + 1))
        if start <= pos and pos + LENGTH <= end:
            whole.push((group, pos))
    again, known = Sorter(), 0
    for group, pos in whole:
        if group == known:
            again.push((pos,))
        known = group
    for (pos,) in again:
        yield pos


def _shard_repeats(batches):
    """The result for all rows of one task, by external induced sorting."""
    docs, t = Store(), Numbers((), "<i2")
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            docs.append((doc_id, raw, t.n))
            t.add(np.frombuffer(raw, np.uint8).astype(np.int16) + 2)
            t.add([1])  # ends a document
    if not docs.n:
        return
    t.add([0])
    repeated, out = _repeated(t, docs), []
    pos = next(repeated, None)
    types = (*[pa.int64()] * 4, pa.string())
    for doc_id, raw, start in docs.read():
        kept, here, removed, spans = hashlib.sha256(), 0, 0, 0
        while pos is not None and pos < start + len(raw):
            first = pos - start
            stop = first + LENGTH
            pos = next(repeated, None)
            while pos is not None and pos <= start + stop:
                stop, pos = pos - start + LENGTH, next(repeated, None)
            kept.update(raw[here:first])
            here, removed, spans = stop, removed + stop - first, spans + 1
        kept.update(raw[here:])
        out.append((doc_id, len(raw), removed, spans, kept.hexdigest()))
        if len(out) == 1024:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), types)], [c.split()[0] for c in RESULT.split(", ")])
            out = []
    if out:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), types)], [c.split()[0] for c in RESULT.split(", ")])


def remove_repeats_in_shard(docs: DataFrame) -> DataFrame:
    """The result of :func:`remove_repeats` by external induced suffix sorting.

    One task sorts the whole input on its disk, in bounded memory; at the cost that the
    README gives it is beyond what a corpus allows.
    """
    ordered = common.documents(docs).coalesce(1).sortWithinPartitions("doc_id")
    return ordered.mapInArrow(_shard_repeats, RESULT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    spark = docs.sparkSession
    folder = common.fresh_dir(spark, "repeats")
    fs, path = common.filesystem(folder)
    fs.create_dir(path, recursive=True)
    found = common.documents(docs).mapInArrow(_scan(folder), FOUND).repartition("key")
    order = ["key", F.col("context").asc_nulls_first(), "doc_id", "part", "at"]
    found.sortWithinPartitions(*order).mapInArrow(_judge, JUDGED).write.partitionBy("kind").parquet(f"{folder}/judged")
    judged = spark.read.schema(JUDGED).parquet(f"{folder}/judged")
    of = lambda kind: judged.where(F.col("kind") == kind)
    shards = of(SHARD).select("part", "file")
    # A part is what one scan task wrote; its rows are narrow and make their task read the shard.
    parts = common.tasks(spark, shards.count(), 1)
    check = of(CHECK).select("gram", "doc_id", "part", "at", "x", "y").join(shards, "part").repartition(parts, "part").sortWithinPartitions("part", "at")
    contexts = check.mapInArrow(_contexts, "gram long, doc_id long, part long, at long, n long, data binary")
    hot = common.materialise(of(CHECK).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("gram"), "hot-grams")
    any_hot = not hot.isEmpty()
    some = contexts.join(hot, "gram", "left_anti") if any_hot else contexts
    repeats = of(REPEAT).select("part", "at", "x").union(some.repartition("gram").sortWithinPartitions("gram").mapInArrow(_within, "part long, at long, x long"))
    if any_hot:
        strings = common.materialise(contexts.join(hot, "gram", "left_semi").mapInArrow(_spread, "gram long, hash long, doc_id long, part long, at long, x long"), "hot-strings")
        firsts = strings.where("hash IS NOT NULL")
        place = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "part", "at")
        least = firsts.groupBy("gram", "hash").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1").select("gram", "hash", "least")
        later = firsts.join(least, ["gram", "hash"]).where(place != F.col("least"))
        repeats = repeats.union(strings.where("x IS NOT NULL").select("part", "at", "x")).union(later.select("part", "at", (F.col("at") + LENGTH).alias("x")))
    rows = of(DOC).select("kind", "doc_id", "part", "at", "x").unionByName(repeats.select(F.lit(REPEAT).alias("kind"), F.lit(None).cast("long").alias("doc_id"), "part", "at", "x"))
    return rows.join(shards, "part").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_cut, RESULT)
