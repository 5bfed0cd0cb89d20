"""FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is lower-cased and split at white space; each word loses the characters at
its ends that are no letters.  Its features, each counted once a text however often it
occurs: words, word beginnings of four and five letters (inflected forms share
them), pairs of neighbours, and pairs that skip one or two words, all hashed to
2**BITS places.  Training is FTRL-proximal: every coordinate has a rate of its
own, and the L1 term keeps most weights at exactly zero, so that what goes to the
executors is a short list of (place, weight).

The model is fitted on a bounded sample of the labelled rows (``MAX_TOXIC`` and
``MAX_CLEAN``, the first in order of a hash of the id).  The scan hashes the texts of the
sample where it finds them and sends on the places, at most 2**BITS a row, compressed,
once for each epoch; one task learns from them in order and holds the model alone.  The
intercept is corrected to the share of toxic rows among all training labels.  Scoring
reads every text whole.

Defined results: a null text is the empty one; a text without features gets the
score of the intercept; labels that are null or belong to no document don't
count; a document with several labels is toxic if one of them says so; without
any training rows every score is 0; columns besides ``doc_id``, ``text`` and
``toxic`` are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 22
#: The bounds of the training sample.
MAX_TOXIC, MAX_CLEAN = 6_000, 10_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 6.0, 1.0, 2
THRESHOLD = 0.3
#: Words that one task remembers before it starts anew.
MEMO_WORDS = 250_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    x = (a * _M1) ^ (b * _M2 + np.uint64(kind))
    x ^= x >> np.uint64(29)
    x *= _M2
    return x >> np.uint64(64 - BITS)


class Features:
    """Hashed features of texts; words are hashed once and remembered."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((3, 1 << 16), np.uint64)

    def _learn(self, words: set[str]) -> None:
        if len(self.at) > MEMO_WORDS:
            self.at.clear()
            words = self.pending
        new = [w for w in words if w not in self.at]
        n = len(self.at)
        while n + len(new) > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        for i, w in enumerate(new, n):
            bare = w
            if not (w[0].isalpha() and w[-1].isalpha()):
                letters = [k for k, c in enumerate(w) if c.isalpha()]
                bare = w[letters[0] : letters[-1] + 1] if letters else w
            raw = bare.encode("utf-8", "surrogatepass")
            self.table[0, i] = zlib.crc32(raw) | zlib.crc32(raw, 0x5BD1E995) << 32
            for row, size in ((1, 4), (2, 5)):
                raw = bare[:size].encode("utf-8", "surrogatepass") if len(bare) > size else b""
                self.table[row, i] = (zlib.crc32(raw) | zlib.crc32(raw, 0x5BD1E995) << 32) if raw else 0
            self.at[w] = i

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, place) of each feature of the texts, repeats included."""
        words = [t.lower().split() for t in texts]
        self.pending = set().union(*words) if words else set()
        if not self.at.keys() >= self.pending:
            self._learn(self.pending)
        sizes = np.array([len(w) for w in words], np.int64)
        index = np.fromiter((i for w in words for i in map(self.at.__getitem__, w)), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        word, four, five = self.table[:, index]
        zero = np.uint64(0)
        docs, places = [doc], [_mix(word, zero, 1)]
        for stem, kind in ((four, 2), (five, 3)):
            has = stem != 0
            docs.append(doc[has])
            places.append(_mix(stem[has], zero, kind))
        for gap in (1, 2, 3):
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][same])
            places.append(_mix(word[:-gap][same], word[gap:][same], 3 + gap))
        return np.concatenate(docs), np.concatenate(places).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Places with a weight, their weights, and the intercept (None: never trained)."""

    places: np.ndarray
    weights: np.ndarray
    intercept: float | None

    def scores(self, texts: list[str], features: Features, table: np.ndarray) -> np.ndarray:
        if self.intercept is None:
            return np.zeros(len(texts))
        doc, place = features.of(texts)
        known = table[place] != 0
        key = np.unique(doc[known] << BITS | place[known])
        total = np.bincount(key >> BITS, table[key & ((1 << BITS) - 1)], len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.places] = self.weights
        return out


class Ftrl:
    """FTRL-proximal with per-coordinate rates; a features' list is a set of places."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias_z = self.bias_n = 0.0

    @staticmethod
    def _weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, places: np.ndarray, label: int) -> None:
        z, n = self.z[places], self.n[places]
        w = self._weight(z, n, L1)
        bias = float(self._weight(self.bias_z, self.bias_n, 0.0))
        g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -60, 60))) - label
        self.z[places] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[places] = n + g * g
        self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / ALPHA * bias
        self.bias_n += g * g

    def weights(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self._weight(self.z, self.n, L1)
        at = np.flatnonzero(w)
        return at, w[at], float(self._weight(self.bias_z, self.bias_n, 0.0))


def pack_places(places: np.ndarray) -> bytes:
    """Ascending places as compressed differences, behind their number."""
    deltas = np.diff(places, prepend=0).astype("<i4")
    return len(deltas).to_bytes(4, "little") + pa.compress(deltas.tobytes(), "zstd", asbytes=True)


def unpack_places(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    return np.cumsum(np.frombuffer(pa.decompress(raw[4:], 4 * n, "zstd", asbytes=True), "<i4"))


def _hashed(batches):
    """The places of each text, packed, in column ``places``."""
    common.fresh_worker()
    features = Features()
    for batch in batches:
        out = []
        for i in range(0, batch.num_rows, 64):
            part = batch.column("text").slice(i, 64).to_pylist()
            doc, place = features.of(part)
            key = np.unique(doc << BITS | place)
            cuts = np.searchsorted(key, np.arange(len(part) + 1) << BITS).tolist()
            out += [pack_places(key[a:b] & ((1 << BITS) - 1)) for a, b in zip(cuts, cuts[1:])]
        yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(out, pa.binary())], ["doc_id", "toxic", "places"])


def _train(batches):
    """The model of rows in the order they come; memory holds it and a batch."""
    model = None
    for batch in batches:
        for raw, label in zip(batch.column("places").to_pylist(), batch.column("toxic").to_pylist()):
            model = model or Ftrl()
            model.learn(unpack_places(raw), label)
    if model is not None:
        places, weights, bias = model.weights()
        yield pa.record_batch([pa.array([*places.tolist(), -1]), pa.array([*weights.tolist(), bias])], ["place", "weight"])


def in_held_out(doc_id: Column) -> Column:
    """Rows whose labels must never be learnt: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit the model on the labelled rows outside the held-out fold."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_held_out(F.col("doc_id")))
    given = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda toxic, most: given.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = common.materialise(first(1, MAX_TOXIC).union(first(0, MAX_CLEAN)), "toxicity-sample")
    rows = common.documents(docs).join(F.broadcast(sample), "doc_id")
    hashed = rows.select("doc_id", "text", "toxic").mapInArrow(_hashed, "doc_id long, toxic int, places binary")
    turns = hashed.withColumn("epoch", F.explode(F.array(*map(F.lit, range(EPOCHS)))))
    turns = turns.repartition(1).sortWithinPartitions("epoch", F.xxhash64("doc_id", F.lit(1)), "doc_id", "places")
    found = turns.select("places", "toxic").mapInArrow(_train, "place long, weight double").collect()
    if not found:
        return Model(np.zeros(0, np.int64), np.zeros(0), None)
    shares = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}
    taken = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    odds = lambda x: np.log((x.get(1, 0) + 0.5) / (x.get(0, 0) + 0.5))
    bias = next(r["weight"] for r in found if r["place"] < 0)
    rest = sorted((r["place"], r["weight"]) for r in found if r["place"] >= 0)
    return Model(np.array([p for p, _ in rest], np.int64), np.array([w for _, w in rest]), float(bias + odds(shares) - odds(taken)))


def _scorer(model: Model, names: list[str], text: str, output: str):
    def score(batches):
        common.fresh_worker()
        features, table = Features(), model.table()
        for batch in batches:
            texts, out, start, held = batch.column(text), [], 0, 0
            for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
                held += n
                if held > 1 << 20 or i == len(texts) - 1:
                    out.append(model.scores([t or "" for t in texts.slice(start, i + 1 - start).to_pylist()], features, table))
                    start, held = i + 1, 0
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(np.concatenate([np.zeros(0), *out]))], [*names, output])

    return score


def score(docs: DataFrame, model: Model, keep: list[str], output: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the score in column ``output``, which is none of them."""
    columns, text = [F.col(c) for c in keep], common.unused([*keep, output], "text")
    schema = docs.select(columns).schema.add(output, "double")
    return docs.select(*columns, F.col("text").cast("string").alias(text)).mapInArrow(_scorer(model, keep, text, output), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels), ["doc_id"])
    return scored.select("doc_id", in_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject, with their columns unchanged.

    Null and empty texts are scored by the intercept; without training rows all stay; other
    columns are kept, whatever their names; an empty table gives an empty one.
    """
    output = common.unused(docs.columns, "toxicity")
    return score(docs, train(docs, labels), docs.columns, output).where(F.col(output) < THRESHOLD).select(*docs.columns)
