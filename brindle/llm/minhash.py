"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

1. One scan of the whole texts makes each document's set of five-word shingles
   (64-bit hashes), its SuperMinHash signature of ``PLACES`` values and the hashes
   of its ``BANDS`` bands.  The sets go to flat files in the shared folder, the rest
   to a table that says where each set lies.
2. Documents with equal sets are one class; only its least ``doc_id`` goes on.
3. Classes that share a band meet in a bucket.  Every member is compared with the
   bucket's least member: a star, not all pairs.  What survives a loose estimate
   from the signatures is verified on the full sets, which tasks read from the
   files; sets are never shuffled.
4. The verified links give components.  A bucket that still holds several is dealt into
   blocks of some ``BLOCK`` rows, each row once: its largest component into blocks of its
   own, all others into mixed ones, both by classes of set size.  Pairs across components
   are compared by signature and verified within a block by the task that receives it,
   and between blocks by tasks that read the two from files; two blocks of the largest
   component don't meet, nor two whose sizes rule a link out.  Only a spanning forest of
   the links found leaves a task.  After this no pair that shares a band is left untested
   unless it is connected already.

With 32 bands of 4 places a pair at similarity 0.75 shares no band with probability
5e-6, at 0.8 with 5e-8.  The estimate from 128 places drops what is below ``LOOSE``; by
the binomial bound that loses a pair at 0.75 with probability 4e-10, so 5e-6 holds for both.

Defined results: a null text is the empty one; an empty text has no shingle and no
link; in :func:`near_duplicates` a class of equal sets goes by its least ``doc_id``,
and classes with one least ``doc_id`` share their links, while :func:`keep_first`
decides about each row for itself; a null ``doc_id`` is linked with nothing; an empty
table gives an empty result; other columns are ignored by :func:`near_duplicates` and
kept by :func:`keep_first`.
"""

from __future__ import annotations

import uuid
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components
from .shingles import Shingler, fingerprint, jaccard_counts, mix, super_minhash

PLACES, BANDS = 128, 32
#: A link: 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Estimates below this are not verified.
LOOSE = 0.5
#: Rows of a bucket in one block of the comparison across components.
BLOCK = 1024
#: Pairs that a task verifies, blocks that it compares within, pairs of blocks that it compares.
PAIRS_EACH, BLOCKS_EACH, MEETINGS_EACH = 20_000, 64, 16
#: Hashes of sets that a verifying task keeps.
HELD_HASHES = 4_000_000
INSIDE = "a long, b long, key long, block long, file string, at long, size long"
SKETCH = "doc_id long, n_shingles long, fp binary, file string, at long, brief binary, bands array<bigint>"


def _sketch(folder: str, places: int, bands: int):
    names = [c.split()[0] for c in SKETCH.split(", ")]
    rows = places // bands

    def sketch(batches):
        common.fresh_worker()
        shingler, out, uri, at = Shingler(), None, "", 0
        for batch in batches:
            if out is None and batch.num_rows:
                uri = f"{folder}/sets-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.u64"
                fs, path = common.filesystem(uri)
                out = fs.open_output_stream(path, compression=None)
            texts = batch.column("text").to_pylist()
            start, held = 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held < 400_000 and i < len(texts) - 1:
                    continue
                sets = shingler.sets(texts[start : i + 1])
                sig = super_minhash(sets, places)
                band = np.zeros((len(sets), bands), np.uint64)
                for k in range(rows):
                    band = mix(band * np.uint64(31) + sig[:, k::rows][:, :bands])
                band = mix(band + np.arange(bands, dtype=np.uint64)).view(np.int64)
                sizes = np.array([len(s) for s in sets], np.int64)
                places_at = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                out.write(b"".join(s.tobytes() for s in sets))
                brief = (mix(sig) & np.uint64(255)).astype(np.uint8)
                n = len(sets)
                bands_column = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(band.reshape(-1)))
                yield pa.record_batch([batch.column("doc_id").slice(start, n), pa.array(sizes), pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([uri] * n), pa.array(places_at), pa.array([b.tobytes() for b in brief], pa.binary()), bands_column], names)
                start, held = i + 1, 0
        if out is not None:
            out.close()

    return sketch


class _Sets:
    """Reads sets from the files; keeps the last ones."""

    def __init__(self) -> None:
        self.files: dict[str, object] = {}
        self.held: dict[tuple[str, int], np.ndarray] = {}
        self.size = 0

    def get(self, uri: str, at: int, n: int) -> np.ndarray:
        key = (uri, at)
        if key not in self.held:
            if uri not in self.files:
                if len(self.files) >= 64:
                    self.files.pop(next(iter(self.files))).close()
                fs, path = common.filesystem(uri)
                self.files[uri] = fs.open_input_file(path)
            while self.held and self.size + n > HELD_HASHES:
                self.size -= len(self.held.pop(next(iter(self.held))))
            self.size += n
            self.held[key] = np.frombuffer(self.files[uri].read_at(8 * n, 8 * at), np.uint64)
        return self.held[key]


def _verify(similar: int):
    def verify(batches):
        sets = _Sets()
        for batch in batches:
            rows = batch.to_pydict()
            keep = []
            for fa, aa, na, fb, ab, nb in zip(*(rows[c] for c in ("fa", "aa", "na", "fb", "ab", "nb"))):
                ok = 100 * min(na, nb) >= similar * max(na, nb)
                if ok:
                    both, union = jaccard_counts(sets.get(fa, aa, na), sets.get(fb, ab, nb))
                    ok = 100 * both >= similar * union
                keep.append(ok)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.record_batch([kept.column("a"), kept.column("b")], ["a", "b"])

    return verify


def _likely(loose: float):
    def likely(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.uint8) for c in ("sa", "sb"))
            yield batch.filter(pa.array((x == y).mean(axis=1) >= loose)).select([c for c in batch.schema.names if c not in ("sa", "sb")])

    return likely


def _rows_of(t: pa.Table) -> SimpleNamespace:
    """A block's rows as arrays."""
    n = t.num_rows
    brief = np.frombuffer(b"".join(t["brief"].to_pylist()), np.uint8).reshape(n, -1)
    bands = t["bands"].combine_chunks().values.to_numpy().reshape(n, -1)
    return SimpleNamespace(rep=t["rep"].to_numpy(), comp=t["comp"].to_numpy(), n=t["n_shingles"].to_numpy(), at=t["at"].to_numpy(), file=t["file"].to_pylist(), brief=brief, bands=bands)


def _forest(key: int, a: SimpleNamespace, b: SimpleNamespace, sets: _Sets, loose: float, similar: int) -> list[tuple[int, int]]:
    """Verified links that connect the components of two blocks (or of one with itself).

    A pair is compared in the first band that it shares, and not at all once the links
    found here connect it.
    """
    same, out = a is b, []
    comp = np.unique(a.comp if same else np.concatenate([a.comp, b.comp]), return_inverse=True)[1]
    left, right = (comp, comp) if same else (comp[: len(a.rep)], comp[len(a.rep) :])  # views: both change with comp
    if len(comp) == 0 or (comp == comp[0]).all():
        return out
    band = int(np.flatnonzero(a.bands[0] == key)[0])
    for x in range(len(a.rep)):
        y = np.flatnonzero((right != left[x]) & (b.rep > a.rep[x])) if same else np.flatnonzero(right != left[x])
        y = y[100 * np.minimum(b.n[y], a.n[x]) >= similar * np.maximum(b.n[y], a.n[x])]
        if not len(y):
            continue
        y = y[(b.brief[y] == a.brief[x]).mean(axis=1) >= loose]
        if band and len(y):
            y = y[~(b.bands[y, :band] == a.bands[x, :band]).any(axis=1)]
        for z in y.tolist():
            if right[z] != left[x]:
                both, union = jaccard_counts(sets.get(a.file[x], int(a.at[x]), int(a.n[x])), sets.get(b.file[z], int(b.at[z]), int(b.n[z])))
                if 100 * both >= similar * union:
                    comp[comp == right[z]] = left[x]
                    out.append((int(a.rep[x]), int(b.rep[z])))
    return out


def _inside(folder: str, loose: float, similar: int):
    """Links within each block; blocks of a bucket that has several are written for :func:`_between`."""
    types = (*[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in INSIDE.split(", ")]

    def inside(batches):
        sets, out, uri, at, rows = _Sets(), None, "", 0, []
        for (key, block), t in common.groups(batches, ["key", "block"]):
            own = _rows_of(t)
            rows += [(a, b, None, None, None, None, None) for a, b in _forest(key, own, own, sets, loose, similar)]
            if t["several"][0].as_py():
                if out is None:
                    uri = f"{folder}/blocks-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrow"
                    fs, path = common.filesystem(uri)
                    out = fs.open_output_stream(path, compression=None)
                raw = pa.BufferOutputStream()
                with pa.ipc.new_stream(raw, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(t)
                size = out.write(raw.getvalue())
                rows.append((None, None, key, block, uri, at, size))
                at += size
            if len(rows) > 4096:
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), types)], names)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), types)], names)
        if out is not None:
            out.close()

    return inside


def _between(loose: float, similar: int):
    """Links between the two blocks of each row."""

    def between(batches):
        def block(uri, at, size):
            fs, path = common.filesystem(uri)
            with fs.open_input_file(path) as f:
                return _rows_of(pa.ipc.open_stream(f.read_at(size, at)).read_all())

        sets, held, a = _Sets(), None, None
        for batch in batches:
            links = []
            for r in batch.to_pylist():
                one = (r["fa"], r["aa"], r["sa"])
                held, a = (held, a) if held == one else (one, block(*one))
                links += _forest(r["key"], a, block(r["fb"], r["ab"], r["sb"]), sets, loose, similar)
            yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return between


def _across(known: DataFrame, reps: DataFrame) -> DataFrame:
    """Verified links between components that share a bucket; ``known`` has ``key, rep, comp``."""
    spark = known.sparkSession
    # Set sizes two classes apart differ by more than a link allows.
    size = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(100 / SIMILAR))).cast("long").alias("size")
    sized = known.join(reps.select("rep", size), "rep")
    counts = common.materialise(sized.groupBy("key", "comp", "size").agg(F.count(F.lit(1)).alias("m")), "bucket-counts")
    by_comp = counts.groupBy("key", "comp").agg(F.sum("m").alias("m"))
    open_keys = by_comp.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("m").alias("n"), F.max(F.struct("m", "comp"))["comp"].alias("largest")).where("comps > 1").drop("comps")
    open_keys = common.materialise(open_keys, "open-buckets")
    # (size, whether of the largest component): bits of the block's number above those of its piece.
    deal = F.when(F.col("n") > BLOCK, F.col("size") * 2 + (F.col("comp") == F.col("largest")).cast("long")).otherwise(0)
    pieces = counts.join(open_keys, "key").groupBy("key", deal.alias("deal")).agg(F.ceil(F.sum("m") / BLOCK).alias("pieces"))
    rows = sized.join(open_keys, "key").withColumn("deal", deal).join(pieces, ["key", "deal"])
    block = F.shiftleft("deal", 40) + F.pmod(F.xxhash64("rep", "key"), F.col("pieces"))
    rows = rows.select("key", block.alias("block"), (F.col("n") > BLOCK).alias("several"), "rep", "comp").join(reps.drop("fp"), "rep")
    rows = rows.select("key", "block", "several", "rep", "comp", "n_shingles", "file", "at", "brief", "bands")
    n = open_keys.agg(F.sum("n")).first()[0] or 0
    if not n:
        return spark.createDataFrame([], "a long, b long")
    folder = common.fresh_dir(spark, "bucket-blocks")
    fs, path = common.filesystem(folder)
    fs.create_dir(path, recursive=True)
    rows = rows.repartition(common.tasks(spark, n, BLOCKS_EACH * BLOCK), "key", "block").sortWithinPartitions("key", "block")
    found = common.materialise(rows.mapInArrow(_inside(folder, LOOSE, SIMILAR), INSIDE), "links-inside")
    side = lambda x: found.where("key IS NOT NULL").select("key", F.shiftright("block", 41).alias(f"size_{x}"), (F.shiftright("block", 40) % 2).alias(f"pure_{x}"), F.col("block").alias(f"block_{x}"), F.col("file").alias(f"f{x}"), F.col("at").alias(f"a{x}"), F.col("size").alias(f"s{x}"))
    meet = side("a").join(side("b"), "key").where("block_a < block_b AND pure_a + pure_b < 2 AND abs(size_a - size_b) <= 1")
    meet = common.materialise(meet.select("key", "fa", "aa", "sa", "fb", "ab", "sb"), "block-pairs")
    dealt = meet.repartitionByRange(common.tasks(spark, meet.count(), MEETINGS_EACH), "fa", "aa", "fb", "ab").sortWithinPartitions("fa", "aa")
    more = common.materialise(dealt.mapInArrow(_between(LOOSE, SIMILAR), "a long, b long"), "links-between")
    common.remove_dir(spark, folder)
    return found.where("a IS NOT NULL").select("a", "b").union(more)


def _links(pairs: DataFrame, reps: DataFrame, similar: int) -> DataFrame:
    """The pairs ``a, b`` that are links, verified on the full sets."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("file").alias(f"f{x}"), F.col("at").alias(f"a{x}"), F.col("n_shingles").alias(f"n{x}"), F.col("brief").alias(f"s{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    rows = rows.mapInArrow(_likely(LOOSE), rows.drop("sa", "sb").schema)
    # Dealt out by pair: a class with very many partners is spread over all tasks.
    rows = rows.repartition(common.tasks(pairs.sparkSession, pairs.count(), PAIRS_EACH), F.xxhash64("a", "b")).sortWithinPartitions("fa", "aa")
    return common.materialise(rows.mapInArrow(_verify(similar), "a long, b long"), "links")


def sketches(docs: DataFrame) -> tuple[DataFrame, str]:
    """The table of sketches and the folder of the sets' files."""
    folder = common.fresh_dir(docs.sparkSession, "shingle-sets")
    fs, path = common.filesystem(folder)
    fs.create_dir(path, recursive=True)
    return common.materialise(common.documents(docs).mapInArrow(_sketch(folder, PLACES, BANDS), SKETCH), "sketches"), folder


def classes(sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``fp, rep`` of each class, ``node, root`` of the classes linked to a smaller one)."""
    first = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").alias("rep"), "n_shingles", "file", "at", "brief", "bands")).alias("r"))
    reps = common.materialise(first.select("fp", "r.*"), "classes")
    buckets = reps.select("rep", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = common.materialise(buckets.join(shared, "key"), "buckets")
    star = members.where("rep > leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = _links(common.materialise(star, "stars"), reps, SIMILAR)
    roots = components(links)
    known = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("comp"))
    more = _across(common.materialise(known, "bucket-components"), reps)
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    return reps.select("fp", "rep"), roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    return _labelled(docs).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _labelled(docs: DataFrame) -> DataFrame:
    sketch, folder = sketches(docs)
    reps, roots = classes(sketch)
    # All links are verified and written: nothing reads the sets any more.
    common.remove_dir(docs.sparkSession, folder)
    rooted = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component"))
    rows = sketch.select("doc_id", "n_shingles", "fp").join(rooted, "fp", "left")
    return rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row, that of the least ``doc_id``, of each component.

    Where a ``doc_id`` is repeated, rows are numbered in order of ``doc_id`` and text and
    go by their numbers: of rows with one ``doc_id`` only the duplicates are dropped.  Rows
    with a null ``doc_id``, a null or an empty text stay; all columns are kept, whatever
    their names; an empty table gives an empty one.
    """
    names, key = docs.columns, F.col("doc_id").cast("long")
    number, order_id, digest, drop = (common.unused(names, n) for n in ("row", "order_id", "digest", "drop"))
    repeated = docs.select(key.alias("doc_id")).where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        rows = docs.withColumn(number, key)
    else:
        order = [F.col(order_id), F.col(digest)]
        rows = docs.withColumn(order_id, key).withColumn(digest, F.sha2(F.col("text").cast("string"), 256))
        # The ranges ascend, so the numbers do; the table is written, so they stay.
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(number, F.when(F.col(order_id).isNotNull(), F.monotonically_increasing_id()))
        rows = common.materialise(rows.select(*names, number), "numbered-documents")
    dropped = _labelled(rows.select(F.col(number).alias("doc_id"), "text")).where("doc_id <> component_id").select(F.col("doc_id").alias(drop)).distinct()
    return rows.join(dropped, F.col(number) == F.col(drop), "left_anti").select(*names)
