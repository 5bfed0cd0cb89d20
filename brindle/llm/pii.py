"""Personal data: base patterns and bootstrapped contextual extraction.

One scan of the whole texts finds the base identifiers (e-mail, IP address, card
number, phone number) and, beside them, every other token with a digit in it, the
candidates.  Base identifiers are the seeds.  The words left and right of a seed
or candidate are its lexical patterns; patterns and identifiers (by hash, so that
no personal data is copied) form a weighted graph.  Spark then scores the graph
in rounds: a pattern is worth the mean score of the distinct identifiers that it
surrounds, an identifier the mean of its patterns on its better side, and seeds stay at 1.  Candidates of patterns that end
up trustworthy and well supported join the result as spans of kind ``id``.

Tokens without a digit are far too many to be candidates everywhere.  Those beside a
word that is a trusted pattern are counted in a second scan, by a sketch for each pattern,
as most patterns are common words with far too many; those of the patterns that are left
are counted exactly.  Patterns that seeds still outweigh (``SHARE``) make them candidates,
whose other places a further scan finds.  They are scored with all of them; what the first
graph chose stays chosen.  What these scans
look for travels to them as a bit set of fixed size (``BITS``), and joins with the exact
table drop its false hits: nothing that grows with the corpus reaches the driver.

The graph is aggregated to distinct (pattern, identifier) edges before anything
is joined, so a pattern or an identifier in a third of all rows is one row for
each partition, and joins on a hot pattern may be split.

The word beside an identifier is the next one between white space, however far and long;
where it is glued to the identifier it ends at the next base identifier.  Patterns with
words over ``LONG`` characters go by a hash of the word.

Defined results: a null text is the empty one and has no spans; offsets count
code points, ends are exclusive; repeated rows are scanned each for itself; an
empty table gives an empty result; columns besides ``doc_id`` and ``text`` are
ignored by :func:`find` and kept by :func:`redact`.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "id")
#: Rounds of scoring; a pattern counts from so many distinct identifiers; scores from which a pattern and a candidate are trusted.
ROUNDS, SUPPORT, PATTERN_SCORE, ID_SCORE = 3, 5, 0.9, 0.9
#: Seeds among all distinct identifiers of a pattern, words included, from which the rounds can bring it to trust.
SHARE = 1 - (1 - PATTERN_SCORE) ** (1 / ROUNDS)
#: Characters from which a word goes by its hash.
LONG = 64
#: Words beside a cue, as a sketch counts them (within 5 %, one standard deviation), over those that it may have, beyond which it is let go.
SLACK = 1.6
#: Bits of a set that travels to a scan; tokens that one task remembers before it starts anew.
BITS, MEMO_TOKENS = 1 << 22, 300_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_TOKEN = re.compile(r"\S+")
_TOKENS = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ident", pa.int64()), ("known", pa.bool_()), ("context", pa.list_(pa.string()))])

SPAN = "struct<start:long,kind:int,end:long>"
TOKEN = "struct<start:long,end:long,ident:long,known:boolean,context:array<string>>"
FLAT = "digest string, start long, end long, ident long, pattern string"
FOUND = f"part long, row long, doc_id long, digest string, base array<{SPAN}>, tokens array<{TOKEN}>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base identifiers, in that order."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_small, m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _ident(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _word(text: str) -> str:
    word = re.sub(r"\d", "0", _EDGE.sub("", text.lower()))
    return word if len(word) <= LONG else hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class Places:
    """The tokens between white space of a text."""

    def __init__(self, text: str) -> None:
        self.text = text
        spans = [m.span() for m in _TOKEN.finditer(text)]
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def context(self, start: int, end: int, low: int = 0, high: int | None = None) -> list[str]:
        """The patterns of the place [start, end); glued words end at ``low`` and ``high``."""
        i, j, left, right = bisect.bisect_left(self.starts, start) - 1, bisect.bisect_right(self.ends, end), "", ""
        if i >= 0:
            glued = self.ends[i] > start
            left = self.text[max(self.starts[i], low) if glued else self.starts[i] : min(self.ends[i], start)]
        if j < len(self.ends):
            glued = self.starts[j] < end
            right = self.text[max(self.starts[j], end) : min(self.ends[j], high) if glued and high is not None else self.ends[j]]
        return ["L:" + _word(left), "R:" + _word(right)]


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and candidates of a text with their patterns."""
    first = _DIGIT.search(text)
    if not base and first is None:
        return []
    places, out, low = Places(text), [], 0
    for n, (start, _, end) in enumerate(base):
        if n and base[n - 1][2] <= start:
            low = base[n - 1][2]
        k = n + 1
        while k < len(base) and base[k][0] < end:
            k += 1
        out.append({"start": start, "end": end, "ident": _ident(text[start:end]), "known": True, "context": places.context(start, end, low, base[k][0] if k < len(base) else None)})
    covered, k, reach = sorted((s, e) for s, _, e in base), 0, 0
    while first is not None:
        i = bisect.bisect_right(places.starts, first.start()) - 1
        start, end = places.starts[i], places.ends[i]
        while k < len(covered) and covered[k][0] < end:
            reach, k = max(reach, covered[k][1]), k + 1
        if reach <= start:
            bare = _EDGE.sub("", text[start:end])
            begin = text.index(bare, start)
            out.append({"start": begin, "end": begin + len(bare), "ident": _ident(bare), "known": False, "context": places.context(begin, begin + len(bare))})
        first = _DIGIT.search(text, end)
    return out


def members(keys: DataFrame) -> bytes:
    """A Bloom filter of ``BITS`` bits over the one long column of ``keys``."""
    key = F.col(keys.columns[0])
    at = keys.select(F.explode(F.array(F.pmod(key, F.lit(BITS)), F.pmod(F.shiftright(key, 29), F.lit(BITS)))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
    out = np.zeros(BITS // 64, np.int64)
    for r in words.collect():  # BITS / 64 rows at most
        out[r["w"]] = r["bits"]
    return out.astype("<i8").tobytes()


def may_hold(bits: bytes, key: int) -> bool:
    """Whether a key may be a member; of those that aren't a few get a yes."""
    a, b = key % BITS, (key >> 29) % BITS
    return bool(bits[a >> 3] >> (a & 7) & 1 and bits[b >> 3] >> (b & 7) & 1)


#: What makes a word's hash the key of a left and of a right pattern (any two numbers do).
SIDES = {"L": 0x2545F4914F6CDD1D, "R": 0x5851F42D4C957F2D}


def pattern_key(pattern: Column) -> Column:
    """The key of a pattern in a filter."""
    side = F.when(F.startswith(pattern, F.lit("L")), F.lit(SIDES["L"])).otherwise(F.lit(SIDES["R"]))
    return F.xxhash64(F.substring(pattern, 3, 1 << 30)).bitwiseXOR(side)


def _hash_of(word: str) -> int:
    """The hash of a word, the same as Spark's ``xxhash64``, unsigned."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)


def _key_of(pattern: str) -> int:
    x = _hash_of(pattern[2:]) ^ SIDES[pattern[0]]
    return x - (x >> 63 << 64)


@functools.lru_cache(1 << 17)
def _bare_ident(token: str) -> int | None:
    bare = _EDGE.sub("", token)
    return _ident(bare) if bare and not _DIGIT.search(token) else None


def _words_at(text: str, hits: list[int]) -> list[dict]:
    """The tokens ``hits`` of a text, those in base identifiers left out."""
    out, places, covered, k, reach = [], Places(text), sorted((s, e) for s, _, e in base_spans(text)), 0, 0
    for i in hits:
        start, end = places.starts[i], places.ends[i]
        while k < len(covered) and covered[k][0] < end:
            reach, k = max(reach, covered[k][1]), k + 1
        if reach <= start:
            bare = _EDGE.sub("", text[start:end])
            begin = text.index(bare, start)
            out.append({"start": begin, "end": begin + len(bare), "ident": _ident(bare), "context": places.context(begin, begin + len(bare))})
    return out


class Neighbours:
    """Finds the tokens without a digit beside the patterns of a filter, vectorised over texts.

    Each different token is looked at once, as long as it is remembered: its identifier, on
    which sides that stands free, and whether its word may be a left or a right pattern.
    """

    def __init__(self, bits: bytes) -> None:
        self.bits = np.frombuffer(bits, np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.tokens: list[str] = []
        # By token: hash of its word, identifier; flags 1, 2: may be a left, a right pattern, 4, 8: takes them, 16: has its identifier.
        self.hashes, self.idents, self.flags = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def _may_hold(self, keys: np.ndarray) -> np.ndarray:
        """:func:`may_hold` of many keys."""
        a, b = keys % BITS, (keys >> 29) % BITS
        return (self.bits[a >> 3] >> (a & 7) & self.bits[b >> 3] >> (b & 7) & 1) > 0

    def _learn(self, new: list[str]) -> None:
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.tokens += new
        words = [low if (low := t.lower()).isalpha() and len(low) <= LONG else _word(t) for t in new]
        hashes = np.array([_hash_of(w) for w in words], np.uint64).view(np.int64)
        flags = self._may_hold(hashes ^ SIDES["L"]) | self._may_hold(hashes ^ SIDES["R"]).astype(np.uint8) << 1
        flags *= np.array([w != "" for w in words], np.uint8)
        free = np.full(len(new), 12, np.uint8)
        for i, token in enumerate(new):
            if not token.isalpha():
                bare = _EDGE.sub("", token)
                named = bare and not _DIGIT.search(token) and not ("@" in token and base_spans(token))
                free[i] = 4 * token.startswith(bare) + 8 * token.endswith(bare) if named else 0
        self.hashes, self.flags = np.concatenate([self.hashes, hashes]), np.concatenate([self.flags, flags | free])
        self.idents = np.concatenate([self.idents, np.zeros(len(new), np.int64)])

    def _named(self, index: np.ndarray) -> np.ndarray:
        """The identifiers of tokens, made when first asked for."""
        for i in np.unique(index[self.flags[index] & 16 == 0]).tolist():
            token = self.tokens[i]
            self.idents[i] = _ident(token if token.isalpha() else _EDGE.sub("", token))
            self.flags[i] |= 16
        return self.idents[index]

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (key of a pattern, identifier) of the texts."""
        if len(self.at) > MEMO_TOKENS:
            self._clear()
        words = [t.split() for t in texts]
        self._learn([token for token in set().union(*words) if token not in self.at])
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        index = np.fromiter((i for w in words for i in map(self.at.__getitem__, w)), np.int64, int(sizes.sum()))
        doc, flags = np.repeat(np.arange(len(words)), sizes), self.flags[index]
        a, b, same = index[:-1], index[1:], doc[1:] == doc[:-1]
        left = same & (flags[:-1] & 1 > 0) & (flags[1:] & 4 > 0)
        right = same & (flags[1:] & 2 > 0) & (flags[:-1] & 8 > 0)
        pattern = np.concatenate([self.hashes[a[left]] ^ SIDES["L"], self.hashes[b[right]] ^ SIDES["R"]])
        ident = self._named(np.concatenate([b[left], a[right]]))
        order = np.lexsort((ident, pattern))
        pattern, ident = pattern[order], ident[order]
        first = np.ones(len(order), bool)
        first[1:] = (pattern[1:] != pattern[:-1]) | (ident[1:] != ident[:-1])
        return pattern[first], ident[first]


def _beside(bits: bytes):
    """Distinct (key of a pattern in the filter, token without a digit in it) of some texts at a time."""

    def beside(batches):
        neighbours = Neighbours(bits)
        for batch in batches:
            texts, start, held = batch.column("text"), 0, 0
            for i, n in enumerate(pc.binary_length(texts).to_pylist()):
                held += n
                if held > 4 << 20 or i == len(texts) - 1:
                    pattern, ident = neighbours.of(texts.slice(start, i + 1 - start).to_pylist())
                    yield pa.record_batch([pa.array(pattern), pa.array(ident)], ["key", "ident"])
                    start, held = i + 1, 0

    return beside


def _among(bits: bytes):
    """The places of tokens without a digit that are in the filter, one row for each of their patterns."""

    def among(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                hits = [i for i, p in enumerate(text.split()) if (ident := _bare_ident(p)) is not None and may_hold(bits, ident)]
                if hits:
                    digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                    rows += [(digest, t["start"], t["end"], t["ident"], c) for t in _words_at(text, hits) for c in t["context"]]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["digest", "start", "end", "ident", "pattern"])

    return among


def _scan(batches):
    common.fresh_worker()
    part, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        base, found, digests = [], [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            found.append(tokens(text, spans))
            digests.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
        n = batch.num_rows
        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
        yield pa.record_batch([pa.array([part] * n, pa.int64()), pa.array(range(row, row + n), pa.int64()), batch.column("doc_id"), pa.array(digests, pa.string()), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(_TOKENS))], ["part", "row", "doc_id", "digest", "base", "tokens"])
        row += n


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of the graph ``pattern, ident, known, n``: (pattern, score, support), (ident, score)."""
    idents = edges.groupBy("ident").agg(F.max(F.col("known").cast("double")).alias("score"))
    seeds = idents.where("score = 1")
    for _ in range(rounds):
        weighed = edges.join(idents, "ident")
        patterns = weighed.groupBy("pattern").agg(F.avg("score").alias("score"), F.sum((F.col("score") >= ID_SCORE).cast("long")).alias("support"))
        # A pattern that too few identifiers support says nothing in favour.
        told = patterns.select("pattern", F.when(F.col("support") >= SUPPORT, F.col("score")).otherwise(0.0).alias("worth"))
        sides = edges.where("NOT known").join(told, "pattern").groupBy("ident", F.substring("pattern", 1, 1).alias("side")).agg((F.sum(F.col("n") * F.col("worth")) / F.sum("n")).alias("score"))
        spread = sides.groupBy("ident").agg(F.max("score").alias("score"))
        idents = common.materialise(seeds.unionByName(spread.join(seeds, "ident", "left_anti")), "pii-scores")
    return patterns, idents


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and tokens of each row, written to the shared folder."""
    return common.materialise(common.documents(docs).mapInArrow(_scan, FOUND), "pii-found")


def _flat(found: DataFrame) -> DataFrame:
    return found.select("part", "row", F.explode("tokens").alias("t")).select("part", "row", "t.*")


def _trusted(patterns: DataFrame) -> DataFrame:
    return patterns.where((F.col("support") >= SUPPORT) & (F.col("score") >= PATTERN_SCORE)).select("pattern")


def _chosen(edges: DataFrame, trusted: DataFrame, idents: DataFrame) -> DataFrame:
    return edges.where("NOT known").join(trusted, "pattern", "left_semi").join(idents.where(F.col("score") >= ID_SCORE).select("ident"), "ident", "left_semi").select("ident").distinct()


def _graph(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges, the trusted patterns and the scores of identifiers."""
    flat = _flat(found)
    seen = flat.select("ident", "known", F.explode("context").alias("pattern"))
    edges = common.materialise(seen.groupBy("pattern", "ident", "known").agg(F.count(F.lit(1)).alias("n")), "pii-edges")
    patterns, idents = score_patterns(edges)
    return edges, common.materialise(_trusted(patterns), "pii-trusted"), idents


def chosen_ids(found: DataFrame) -> DataFrame:
    """``ident``: the discovered identifiers with a digit."""
    return _chosen(*_graph(found))


def chosen_words(docs: DataFrame, edges: DataFrame, trusted: DataFrame) -> DataFrame | None:
    """``digest, words``: the spans of discovered identifiers without a digit in each text; None if no pattern can have any."""
    cues = trusted.where(F.length("pattern") > 2).select("pattern", pattern_key(F.col("pattern")).alias("key"))
    texts = common.documents(docs).select("text")
    known = edges.groupBy("pattern").agg(F.sum(F.col("known").cast("long")).alias("seeds"), F.count(F.lit(1)).alias("m"))
    # A cue may have so many different words beside it and no more.
    cues = cues.join(known.select("pattern", (F.col("seeds") / SHARE - F.col("m")).alias("most")), "pattern").where("most >= 1")
    cues = common.materialise(cues, "pii-cues")
    if cues.isEmpty():
        return None
    beside = lambda some: texts.mapInArrow(_beside(members(some.select("key"))), "key long, ident long")
    # Common words have far more: a sketch of fixed size a cue tells, and its error is out of reach of this margin.
    about = beside(cues).groupBy("key").agg(F.approx_count_distinct("ident", 0.05).alias("about"))
    left = common.materialise(cues.join(about, "key").where(F.col("about") <= SLACK * F.col("most") + 50), "pii-cues-left")
    if left.isEmpty():
        return None
    pairs = common.materialise(beside(left).distinct().join(left, "key").select("pattern", "most", "ident"), "pii-beside")
    kept = pairs.groupBy("pattern", "most").agg(F.count(F.lit(1)).alias("words")).where("words <= most").select("pattern")
    kept = common.materialise(kept, "pii-cues-kept")
    beside = pairs.select("pattern", "ident")
    idents = common.materialise(beside.join(kept, "pattern", "left_semi").select("ident").distinct(), "pii-word-idents")
    if idents.isEmpty():
        return None
    places = common.materialise(texts.mapInArrow(_among(members(idents)), FLAT).join(idents, "ident", "left_semi"), "pii-words")
    # Other patterns' words weren't counted in full: they say nothing in favour.
    seen = places.join(kept.withColumn("counts", F.lit(True)), "pattern", "left").withColumn("pattern", F.when(F.col("counts"), F.col("pattern")).otherwise(F.concat(F.substring("pattern", 1, 2), F.lit("\n"))))
    more = seen.groupBy("pattern", "ident").agg(F.count(F.lit(1)).alias("n")).select("pattern", "ident", F.lit(False).alias("known"), "n")
    more = common.materialise(more, "pii-word-edges")
    patterns, scores = score_patterns(edges.unionByName(more))
    words = _chosen(more, _trusted(patterns).join(kept, "pattern", "left_semi"), scores)
    spans = places.join(words, "ident", "left_semi").select("digest", F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "end").alias("span")).distinct()
    return spans.groupBy("digest").agg(F.collect_list("span").alias("words"))


def discover(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """``part, row, extra``: the discovered spans of each row that has any."""
    new = _flat(found).where("NOT known").join(chosen, "ident", "left_semi")
    return new.groupBy("part", "row").agg(F.collect_list(F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "end")).alias("extra"))


def _text_of(spans):
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, digest of the base spans, all spans, and ``n_id``."""
    found = scan(docs)
    edges, trusted, idents = _graph(found)
    both = found.select("part", "row", "doc_id", "digest", "base").join(discover(found, _chosen(edges, trusted, idents)), ["part", "row"], "left")
    extra = F.coalesce("extra", F.array().cast(f"array<{SPAN}>"))
    words = chosen_words(docs, edges, trusted)
    if words is not None:
        both = both.join(words, "digest", "left")
        extra = F.concat(extra, F.coalesce("words", F.array().cast(f"array<{SPAN}>")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return both.select("doc_id", *map(count, range(4)), F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.array_sort(F.concat("base", extra))).alias("spans"), F.size(extra).cast("long").alias("n_id"))


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, kind, end in sorted(spans, key=lambda s: (s[0], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _mask(names: list[str], text: str, extra: str, size: str | None):
    """Masks base spans and those of column ``extra``; ``size`` gets the new length."""

    def mask(batches):
        common.fresh_worker()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for i, more in enumerate(batch.column(extra).to_pylist()):
                if texts[i]:
                    spans = base_spans(texts[i]) + [(x["start"], x["kind"], x["end"]) for x in more or ()]
                    if spans:
                        texts[i] = _masked(texts[i], spans)
            sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.record_batch([pa.array(texts, pa.string()) if n == text else sizes if n == size else batch.column(n) for n in names], names)

    return mask


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; a column ``n_chars`` follows.

    All other columns are kept, whatever their names; null texts stay null and empty ones
    empty; an empty table gives an empty one.  The discovered spans of each different text
    are joined to the rows by the text's digest.
    """
    names, by_name = docs.columns, {c.lower(): c for c in docs.columns}
    text, size = by_name["text"], by_name.get("n_chars")
    docs = docs.withColumn(text, F.col(text).cast("string"))
    if size:
        docs = docs.withColumn(size, F.col(size).cast("long"))
    found = scan(docs)
    edges, trusted, idents = _graph(found)
    flat = found.select("digest", F.explode("tokens").alias("t")).where("NOT t.known").select("digest", "t.ident", "t.start", "t.end")
    span = F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "end").alias("span")
    spans = flat.join(_chosen(edges, trusted, idents), "ident", "left_semi").select("digest", span).distinct()
    words = chosen_words(docs, edges, trusted)
    if words is not None:
        spans = spans.union(words.select("digest", F.explode("words").alias("span")))
    key, extra = common.unused(names, "digest"), common.unused(names, "extra")
    extras = common.materialise(spans.groupBy(F.col("digest").alias(key)).agg(F.collect_list("span").alias(extra)), "pii-spans")
    rows = docs.withColumn(key, F.sha2(F.col(text), 256)).join(extras, key, "left").select(*names, extra)
    return rows.mapInArrow(_mask(names, text, extra, size), docs.schema)
