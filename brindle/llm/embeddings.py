"""Near-duplicate embeddings by product quantisation over inverted lists.

For each length of vectors a bounded sample (``SAMPLE`` vectors, the first in order of a
hash) fits coarse centroids and, on the residuals, ``SUBSPACES`` codebooks, in a task that
writes them to the shared folder.  Every distinct vector is then indexed: it goes to the
list of its label and nearest centroid with its code and the length of its quantisation
error.  Lists are packed into blocks of bounded size, which are written once to files in
the shared folder; a task reads the two blocks of each of its pairs from there, so that
vectors aren't copied to every list that they search.  Two blocks whose lists' balls lie
further apart than a link allows aren't read at all.

Every pair of vectors of a label meets in one pair of blocks and is counted on both
sides.  A vector is held against each list that can hold a neighbour: one within the
chord ``d`` of the threshold lies in another cell only if the vector is within ``d``
of the plane between the two centroids, and only if the vector's distance from that
centroid is within ``d`` of those in the list.  In a list, table-lookup distances are
compared with the chord plus each vector's own quantisation error, which by the
triangle inequality drops no neighbour.  A vector with more than ``PROBES`` lists
that the planes leave takes the products with whole blocks instead, as lists spare
it little.  What remains either way is ranked by exact cosine in double precision,
and only pairs at or above the threshold count: no neighbour is left out.

A task returns one row a vector and pair of blocks (its number of links) and a
spanning forest of the links, never all pairs.

Equal vectors of one label are one class, searched once and counted with its size.

Defined results: labels may be of any type that has equality; vectors that are null,
empty, zero, or hold null or non-finite components, and rows with a null label, link with
nothing; vectors of different
lengths never link; rows with one ``vec_id`` count each for themselves, with one
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .graph import components, forest

COSINE = 0.93
#: Vectors compared with all centroids at once.
SLICE = 1024
#: Vectors that the index is fitted on, vectors a list should hold, lists from whose number on a vector is compared with whole blocks.
SAMPLE, LIST_SIZE, PROBES = 20_000, 512, 16
#: Lists at most (a fifth of the sample); pairs of blocks that a task searches.
MOST_LISTS, PAIRS_EACH = 4096, 64
SUBSPACES, CODES, ROUNDS = 8, 256, 8
#: Vectors in one block, up to the last list's rest; pairs of vectors looked at at once; links held before they are thinned.
BLOCK, AT_ONCE, HELD = 1024, 100_000, 1 << 20
LISTED = "part long, dim int, fit string, list int, wide boolean, rep long, weight long, vector array<double>"
STORED = "part long, fit string, block long, file string, at long, size long, lists array<int>, radii array<double>"
COUNTS = "rep long, links long, root long"


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced starts; an empty cell keeps its centroid."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        sizes = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


class Quantiser:
    """Coarse centroids and residual codebooks for unit vectors of one length."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]) -> None:
        self.centres, self.books = centres, books
        self.cuts = np.cumsum([0, *(b.shape[1] for b in books)])

    @classmethod
    def fitted(cls, sample: np.ndarray, lists: int) -> Quantiser:
        out = cls(_kmeans(sample, lists), [])
        rest = sample - out.centres[out.nearest(sample)]
        cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        return cls(out.centres, [_kmeans(rest[:, a:b], CODES) for a, b in zip(cuts, cuts[1:])])

    def write(self, uri: str) -> None:
        fs, path = common.filesystem(uri)
        with fs.open_output_stream(path, compression=None) as out:
            blob = io.BytesIO()
            np.savez(blob, centres=self.centres, **{f"book{m}": b for m, b in enumerate(self.books)})
            out.write(blob.getvalue())

    @classmethod
    def read(cls, uri: str) -> Quantiser:
        fs, path = common.filesystem(uri)
        with fs.open_input_file(path) as f:
            z = np.load(io.BytesIO(f.read()))
        return cls(z["centres"], [z[f"book{m}"] for m in range(len(z.files) - 1)])

    def _square(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(axis=1), 0)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmin(self._square(x[i : i + SLICE]), axis=1) for i in range(0, len(x), SLICE)])

    def wide(self, x: np.ndarray, chord: float, most: int) -> np.ndarray:
        """Whether each row has more than ``most`` lists, its own included, that the planes leave."""
        out = []
        for start in range(0, len(x), SLICE):
            square = self._square(x[start : start + SLICE])
            own = np.argmin(square, axis=1)
            between = np.sqrt(self._square(self.centres[own]))
            margin = (square - square[np.arange(len(own)), own][:, None]) / np.maximum(2 * between, 1e-12)
            may = (margin <= chord + 1e-6) & (np.arange(len(self.centres)) != own[:, None])
            out.append(may.sum(axis=1) >= most)
        return np.concatenate(out)

    def encode(self, x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, lengths of the quantisation errors) of vectors of one list."""
        rest = x - centre
        codes = np.stack([np.argmin((book**2).sum(axis=1) - 2 * rest[:, a:b] @ book.T, axis=1) for book, a, b in zip(self.books, self.cuts, self.cuts[1:])], axis=1)
        back = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((rest - back) ** 2).sum(axis=1))

    def tables(self, q: np.ndarray, centre: np.ndarray) -> list[np.ndarray]:
        """Squared distances of the queries' residuals to each code, by subspace."""
        rest = q - centre
        return [np.maximum((rest[:, a:b] ** 2).sum(axis=1)[:, None] - 2 * rest[:, a:b] @ book.T + (book**2).sum(axis=1), 0) for book, a, b in zip(self.books, self.cuts, self.cuts[1:])]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _reader():
    """A function that reads quantisers and keeps the last few."""
    held: dict[str, Quantiser] = {}

    def read(uri: str) -> Quantiser:
        if uri not in held:
            while len(held) >= 4:
                held.pop(next(iter(held)))
            held[uri] = Quantiser.read(uri)
        return held[uri]

    return read


def _fit(folder: str):
    """One quantiser for each length among rows that are sorted by it."""

    def fit(batches):
        for (dim, most), t in common.groups(batches, ["dim", "most"]):
            uri = f"{folder}/quantiser-{dim}-{uuid.uuid4().hex}.npz"
            sample = _unit(_vectors(t["vector"].combine_chunks().slice(0, SAMPLE), dim))
            Quantiser.fitted(sample, max(1, min(MOST_LISTS, -(-most // LIST_SIZE)))).write(uri)
            yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([uri])], ["dim", "fit"])

    return fit


def _list(chord: float, most: int):
    names = [c.split()[0] for c in LISTED.split(", ")]

    def assign(batches):
        read = _reader()
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                quantiser, x = read(part.column("fit")[0].as_py()), _unit(_vectors(part.column("vector"), dim))
                lists, wide = quantiser.nearest(x), quantiser.wide(x, chord, most)
                yield pa.record_batch([part.column("part"), part.column("dim"), part.column("fit"), pa.array(lists, pa.int32()), pa.array(wide), part.column("rep"), part.column("weight"), part.column("vector")], names)

    return assign


def _store(folder: str):
    """Writes each block, in order of its lists, to the task's file and tells where it lies and how far its lists reach."""
    names = [c.split()[0] for c in STORED.split(", ")]
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()))

    def store(batches):
        fs, path = common.filesystem(folder)
        name, at, told, out, read = uuid.uuid4().hex, 0, [], None, _reader()
        for (part, block), t in common.groups(batches, ["part", "block"]):
            out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
            dim, fit = t["dim"][0].as_py(), t["fit"][0].as_py()
            t, quantiser = t.sort_by([("list", "ascending"), ("rep", "ascending")]), read(fit)
            x, lists = _unit(_vectors(t["vector"].combine_chunks(), dim)), t["list"].to_numpy()
            codes, error = np.zeros((len(x), len(quantiser.books)), np.uint8), np.zeros(len(x))
            present = np.unique(lists)
            for c in present.tolist():
                codes[lists == c], error[lists == c] = quantiser.encode(x[lists == c], quantiser.centres[c])
            away = np.sqrt(((x - quantiser.centres[lists]) ** 2).sum(axis=1))
            blob = io.BytesIO()
            np.savez(blob, x=x, rep=t["rep"].to_numpy(), weight=t["weight"].to_numpy(), lists=lists, wide=t["wide"].to_numpy(), codes=codes, error=error, away=away)
            size = out.write(blob.getvalue())
            told.append((part, fit, block, name, at, size, present.tolist(), [float(away[lists == c].max()) for c in present]))
            at += size
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*told), types)], names)

    return store


def _between(quantiser: Quantiser, a: dict, b: dict, same: bool, cosine: float, chord: float):
    """(row of a, row of b) of the links of two blocks, or, each once, of one with itself; in parts."""
    x, y = a["x"], b["x"]

    def ranked(p, q):
        ok = ((x[p] * y[q]).sum(axis=1) >= cosine) & (a["rep"][p] != b["rep"][q])
        return p[ok], q[ok]

    wide, narrow = np.flatnonzero(a["wide"]), np.flatnonzero(~a["wide"])
    step = max(1, AT_ONCE // len(y))
    for start in range(0, len(wide), step):
        ask = wide[start : start + step]
        near = x[ask] @ y.T >= cosine - 1e-9
        if same:
            near &= ask[:, None] < np.arange(len(y))
        p, q = np.nonzero(near)
        yield ranked(ask[p], q)
    lists, first = np.unique(b["lists"], return_index=True)
    for c, low, high in zip(lists.tolist(), first.tolist(), [*first[1:].tolist(), len(y)]):
        centre, own, away = quantiser.centres[c], a["lists"][narrow], b["away"][low:high]
        square = ((x[narrow] - centre) ** 2).sum(axis=1)
        between = np.sqrt(((quantiser.centres[own] - centre) ** 2).sum(axis=1))
        may = (own == c) | ((square - a["away"][narrow] ** 2) / np.maximum(2 * between, 1e-12) <= chord + 1e-6)
        may &= (np.sqrt(square) <= away.max() + chord + 1e-6) & (np.sqrt(square) >= away.min() - chord - 1e-6)
        asking = narrow[may & (narrow < high - 1)] if same else narrow[may]
        step = max(1, AT_ONCE // (high - low))
        for start in range(0, len(asking), step):
            ask = asking[start : start + step]
            square = np.zeros((len(ask), high - low))
            for m, table in enumerate(quantiser.tables(x[ask], centre)):
                square += table[:, b["codes"][low:high, m]]
            near = np.sqrt(square) <= chord + b["error"][low:high] + 1e-9
            if same:
                near &= ask[:, None] < np.arange(low, high)
            p, q = np.nonzero(near)
            yield ranked(ask[p], q + low)


def _apart(quantiser: Quantiser, r: dict, chord: float) -> bool:
    """Whether no vector of one block can be near one of the other, by the balls of their lists."""
    between = np.sqrt(((quantiser.centres[r["la"]][:, None] - quantiser.centres[r["lb"]]) ** 2).sum(axis=2))
    return bool((between > np.array(r["ra"])[:, None] + np.array(r["rb"]) + chord + 1e-6).all())


def _search(folder: str, cosine: float, chord: float):
    def search(batches):
        fs, path = common.filesystem(folder)

        def block(file, at, size):
            with fs.open_input_file(f"{path}/{file}") as f:
                f.seek(at)
                return dict(np.load(io.BytesIO(f.read(size))))

        held, a, read = None, {}, _reader()
        for batch in batches:
            for r in batch.to_pylist():
                quantiser = read(r["fit"])
                if _apart(quantiser, r, chord):
                    continue
                one, two = (r["fa"], r["aa"], r["sa"]), (r["fb"], r["ab"], r["sb"])
                held, a = (held, a) if held == one else (one, block(*one))
                b = a if one == two else block(*two)
                links_a, links_b, none = np.zeros(len(a["rep"]), np.int64), np.zeros(len(b["rep"]), np.int64), np.zeros(0, np.int64)
                left, right, n = [none], [none], 0
                for p, q in _between(quantiser, a, b, one == two, cosine, chord):
                    np.add.at(links_a, p, b["weight"][q])
                    np.add.at(links_b, q, a["weight"][p])
                    left.append(a["rep"][p])
                    right.append(b["rep"][q])
                    n += len(p)
                    if n > HELD:
                        node, root = forest(np.concatenate(left), np.concatenate(right))
                        left, right, n = [node], [root], 0
                node, root = forest(np.concatenate(left), np.concatenate(right))
                rep, links = np.concatenate([a["rep"], b["rep"]]), np.concatenate([links_a, links_b])
                some = links > 0
                yield pa.record_batch([pa.array(np.concatenate([rep[some], node])), pa.array(np.concatenate([links[some], np.zeros(len(node), np.int64)])), pa.array(np.concatenate([np.full(some.sum(), -1), root]), mask=np.arange(some.sum() + len(node)) < some.sum())], ["rep", "links", "root"])

    return search


def _fits(reps: DataFrame) -> DataFrame:
    """``dim, fit``: where the quantiser of each length lies."""
    spark = reps.sparkSession
    folder = common.fresh_dir(spark, "quantisers")
    fs, path = common.filesystem(folder)
    fs.create_dir(path, recursive=True)
    sizes = reps.groupBy("dim", "part").count().groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most"))
    sizes = common.materialise(sizes, "vector-sizes")  # written, so that the planner knows its size
    # By a threshold on the hash about SAMPLE rows of a length (a fifth more, cut by the task) are dealt out.
    near = F.pmod(F.xxhash64("vector", F.lit(5)), F.lit(1 << 30)).alias("place")
    sample = reps.select("dim", "rep", "vector", near).join(sizes, "dim").where(F.col("place") < F.lit(1.2 * SAMPLE * (1 << 30)) / F.col("n"))
    sample = sample.select("dim", "most", "place", "rep", "vector").repartition("dim").sortWithinPartitions("dim", "place", "rep")
    return common.materialise(sample.mapInArrow(_fit(folder), "dim int, fit string"), "vector-fits")


def _met(listed: DataFrame, cosine: float, chord: float) -> DataFrame:
    """The links of all pairs of blocks, as ``COUNTS``."""
    spark = listed.sparkSession
    folder = common.fresh_dir(spark, "vector-blocks")
    fs, path = common.filesystem(folder)
    fs.create_dir(path, recursive=True)
    # A part has at most as many lists as there are centroids, which bounds the window.
    before = Window.partitionBy("part").orderBy("list").rowsBetween(Window.unboundedPreceding, -1)
    sizes = listed.groupBy("part", "list").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("first", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / BLOCK)).withColumn("pieces", F.ceil(F.col("n") / BLOCK))
    rows = listed.join(sizes, ["part", "list"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("pieces"))).cast("long")).drop("n", "first", "pieces")
    stored = common.materialise(rows.repartition("part", "block").sortWithinPartitions("part", "block").mapInArrow(_store(folder), STORED), "vector-stored")
    side = lambda x: stored.select("part", *(["fit"] if x == "a" else []), F.col("block").alias(f"block_{x}"), F.col("file").alias(f"f{x}"), F.col("at").alias(f"a{x}"), F.col("size").alias(f"s{x}"), F.col("lists").alias(f"l{x}"), F.col("radii").alias(f"r{x}"))
    pairs = side("a").join(side("b"), "part").where("block_a <= block_b").drop("part", "block_a", "block_b")
    n = stored.groupBy("part").count().agg(F.sum(F.col("count") * (F.col("count") + 1) / 2)).first()[0] or 0
    # The rows are few bytes and much work each, so the number of tasks is given.
    dealt = pairs.repartition(common.tasks(spark, n, PAIRS_EACH), "fa", "aa", "fb", "ab").sortWithinPartitions("fa", "aa")
    found = common.materialise(dealt.mapInArrow(_search(folder, cosine, chord), COUNTS), "vector-links")
    common.remove_dir(spark, folder)
    return found


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, probes: int = PROBES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)) & F.exists("vector", lambda v: v != 0)
    rows = common.materialise(rows.withColumn("ok", F.coalesce(sound, F.lit(False))).withColumn("class", F.when(F.col("ok"), F.xxhash64("label", "vector"))), "vectors")
    # Classes of equal vectors; the vectors themselves are compared, not only their hashes.
    good = rows.where("ok").groupBy("label", "class", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    good = good.withColumn("dim", F.size("vector"))
    # Vectors of one label and length may link; such a part goes by a number from here on.
    parts = common.materialise(good.select("label", "dim").distinct().withColumn("part", F.monotonically_increasing_id()), "vector-parts")
    reps = common.materialise(good.join(parts, ["label", "dim"]), "vector-classes")
    chord = math.sqrt(2 - 2 * cosine)
    fitted = reps.select("part", "dim", "rep", "weight", "vector").join(_fits(reps), "dim")
    listed = common.materialise(fitted.mapInArrow(_list(chord, probes), LISTED), "vector-lists")
    found = _met(listed, cosine, chord)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("root IS NOT NULL").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    told = reps.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    told = told.select("label", "class", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    out = rows.join(told, ["label", "class", "vector"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
