"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and their runs of white space become one space.  An item of
``m`` characters may be off by ``k = m * BUDGET`` edits.  Split into ``k + 1``
pieces, any copy within ``k`` edits keeps one piece unchanged, so an automaton
over all pieces finds every copy.  Around each piece hit the window that could
hold the whole item is compared with it by Myers' bit-parallel distance, which
takes a few word operations for each character of the window.

The items lie in the shared folder in shards of some ``SHARD_CHARS`` characters, dealt
out by hash; the tasks of a scan read one shard and build its automaton, so no benchmark
is too large for the driver or a task.  One beyond a shard costs a further scan for each.

Defined results: null texts hold nothing; items that are null or blank match
nothing; items under 13 characters have no error budget; equal items are
reported each by its id, repeated rows each for themselves; empty tables give an
empty result; other columns are ignored by :func:`matches` and kept by
:func:`drop_contaminated`.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edits allowed for each character of an item.
BUDGET = 0.08
#: Characters of items in one scan.
SHARD_CHARS = 8_000_000
MATCHES = "doc_id long, item_id long, distance long, budget long"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: float = BUDGET) -> tuple[int, list[tuple[int, str]]]:
    """(error budget, its pieces with their offsets) of a normalised item."""
    k = int(len(item) * budget)
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    """For each character the bits of the places where the item has it."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance(item: str, window: str, peq: dict[str, int] | None = None) -> int:
    """Least edit distance of ``item`` to any substring of ``window`` (Myers 1999)."""
    m = len(item)
    if not m:
        return 0
    peq = masks(item) if peq is None else peq
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    get = peq.get
    for c in window:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best


class Matcher:
    """Finds items within their error budgets in texts."""

    def __init__(self, items: list[tuple[int, str]], budget: float = BUDGET) -> None:
        self.items: list[tuple[list[int], str, int, dict[str, int]]] = []
        by_text: dict[str, list[int]] = {}
        for item_id, text in items:
            if clean := normal(text or ""):
                by_text.setdefault(clean, []).append(item_id)
        found: dict[str, list[tuple[int, int]]] = {}
        for clean, ids in sorted(by_text.items()):
            k, parts = pieces(clean, budget)
            for offset, piece in parts:
                found.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((sorted(ids), clean, k, masks(clean)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str, any_one: bool = False) -> list[tuple[int, int, int]]:
        """(item id, distance, budget) of each item that the text holds."""
        if not self.items:
            return []
        clean = normal(text)
        windows: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(clean):
            for n, offset in places:
                _, item, k, _ = self.items[n]
                start = last + 1 - size - offset - k
                own = windows.setdefault(n, [])
                if own and start <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], start), max(own[-1][1], start + len(item) + 2 * k)
                else:
                    own.append([start, start + len(item) + 2 * k])
        out = []
        for n, spans in windows.items():
            ids, item, k, peq = self.items[n]
            best = k + 1
            for a, b in spans:
                window = clean[max(0, a) : b]
                best = min(best, 0 if item in window else distance(item, window, peq) if k else 1)
                if best == 0:
                    break
            if best <= k:
                out += [(i, best, k) for i in ids]
                if any_one:
                    break
        return sorted(out)


def shards(benchmark: DataFrame, chars: int = SHARD_CHARS) -> list[str]:
    """Folders with the items, each of some ``chars`` characters; blank items are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.trim("text") != "")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // chars))
    folder = common.fresh_dir(benchmark.sparkSession, "benchmark-shards")
    items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")).repartition(n, "shard").write.partitionBy("shard").parquet(folder)
    fs, path = common.filesystem(folder)
    return [f"{folder}/{x.base_name}" for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.startswith("shard=")]


def read_shard(uri: str) -> list[tuple[int, str]]:
    """The items of one shard."""
    fs, path = common.filesystem(uri)
    files = [x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".parquet")]
    tables = [pq.read_table(f, filesystem=fs, columns=["item_id", "text"], partitioning=None) for f in sorted(files)]
    return [item for t in tables for item in zip(t["item_id"].to_pylist(), t["text"].to_pylist())]


def _match(shard: str, budget: float):
    def match(batches):
        matcher = None
        for batch in batches:
            matcher = matcher or Matcher(read_shard(shard), budget)
            rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if t for m in matcher.find(t)]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "item_id", "distance", "budget"])

    return match


def matches(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``doc_id, item_id, distance, budget`` of each document that holds an item."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for n, shard in enumerate(shards(benchmark)):
        found = texts.mapInArrow(_match(shard, budget), MATCHES)
        out = out.unionByName(found) if n else found
    return out


def _clean(shard: str, text: str, budget: float):
    def clean(batches):
        common.fresh_worker()
        matcher = None
        for batch in batches:
            matcher = matcher or Matcher(read_shard(shard), budget)
            yield batch.filter(pa.array([not (t and matcher.find(t, any_one=True)) for t in batch.column(text).to_pylist()], pa.bool_()))

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; null texts stay, all columns too."""
    text = next(c for c in docs.columns if c.lower() == "text")
    for n, shard in enumerate(shards(benchmark)):
        # Scans in one stage would hold their automata at the same time.
        docs = common.materialise(docs, "partly-clean") if n else docs
        docs = docs.mapInArrow(_clean(shard, text, budget), docs.schema)
    return docs
