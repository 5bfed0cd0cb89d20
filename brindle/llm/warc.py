"""WARC archives with a two-level capture index.

Writing: each task appends gzip members, one a record, to WARC files of its own
and reports where each record lies.  Of pages with equal payloads (by SHA-1 and
length) of at least ``REVISIT_BYTES`` bytes the one with the largest ``page_id``
is written whole and the others are revisit records that refer to it.

Index: the captures are sorted by reversed-host key.  Each range of keys becomes
one file of compressed blocks of ``LINES`` lines; a sparse directory keeps the first and
last key, place and size of each block.  A look-up binary-searches the directory,
reads the block's byte range, binary-searches its lines and reads the record's range.

Files bear fresh names, and only files that a finished task reported are ever read.

Defined results: a null payload is empty; a null or blank URL is written as
``urn:x-page:<page_id>``, blanks and control characters in URLs are percent-encoded;
a page without ``page_id`` is written, never referred to, and read back without one;
repeated rows are records of their own, all of them responses where they bear the
largest ``page_id``; an empty table has no files; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 1000
#: Lines of an index block; bytes at which a task begins another WARC file.
LINES, FILE_BYTES = 3000, 1 << 30
#: Index blocks and bytes of records that one reading task takes.
BLOCKS_EACH, BYTES_EACH = 64, 32 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "key string, page_id long, url string, digest string, kind string, file string, at long, size long"
DIRECTORY = "first_key string, last_key string, file string, at long, size long, lines long, record_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None) -> str:
    """A version-8 UUID that holds the page id; the last digits tell that there is none."""
    h = f"{(page_id or 0) & (1 << 64) - 1:016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[12:15]}-8{h[15]}00-{'f' * 12 if page_id is None else '0' * 12}>"


def page_of(record: str) -> int | None:
    a, b, c, d, e = record.strip("<>").removeprefix("urn:uuid:").split("-")
    n = int(a + b + c[1:] + d[1], 16)
    return None if e == "f" * 12 else n - (1 << 64) * (n >> 63)


def safe_url(url: str | None, page_id: int | None) -> str:
    url = _UNSAFE.sub(lambda m: f"%{ord(m.group()):02X}", (url or "").strip())
    return url or f"urn:x-page:{'' if page_id is None else page_id}"


def surt(url: str) -> str:
    """The key of a URL: host parts reversed, then path and query; scheme, port of it and fragment left out."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").strip("."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.split("#")[0].lower()
    name = ",".join(reversed(host.split("."))) if ":" not in host else host
    keep = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    return f"{name}{keep}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def pack_record(page_id: int | None, url: str, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def read_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one gzip member; names in lower case."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda lines: {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    warc = fields(head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode("latin-1").split("\r\n")[1:]), payload


def _write(folder: str):
    names = [c.split()[0] for c in CAPTURES.split(", ")]

    def write(batches):
        out, uri, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, digest, size, original in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "size", "original"))):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    uri, at = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    fs, path = common.filesystem(uri)
                    out = fs.open_output_stream(path, compression=None)
                revisit, url = original is not None and original != page_id, safe_url(url, page_id)
                member = pack_record(page_id, url, html.encode("utf-8", "surrogatepass"), size, digest, original, revisit)
                out.write(member)
                rows.append((surt(url), page_id, url, digest, "revisit" if revisit else "response", uri, at, len(member)))
                at += len(member)
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()))], names)
        if out is not None:
            out.close()

    return write


def _index(folder: str):
    def index(batches):
        out, uri, at, held = None, f"{folder}/captures-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx.gz", 0, []

        def block(lines):
            nonlocal out, at
            if out is None:
                fs, path = common.filesystem(uri)
                out = fs.open_output_stream(path, compression=None)
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = z.compress("".join(f"{k} {DATE} {json.dumps(v)}\n" for k, v in lines).encode("utf-8", "surrogatepass")) + z.flush()
            out.write(raw)
            row = [lines[0][0], lines[-1][0], uri, at, len(raw), len(lines), sum(v["size"] for _, v in lines)]
            at += len(raw)
            return pa.record_batch([pa.array([x]) for x in row], ["first_key", "last_key", "file", "at", "size", "lines", "record_bytes"])

        for batch in batches:
            for row in batch.to_pylist():
                held.append((row.pop("key"), row))
            while len(held) >= LINES:
                yield block(held[:LINES])
                held = held[LINES:]
        if held:
            yield block(held)
        if out is not None:
            out.close()

    return index


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives and index below ``folder``; the directory of index blocks."""
    spark = pages.sparkSession
    fs, path = common.filesystem(folder)
    fs.create_dir(path, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    brief = common.materialise(rows.where(F.col("size") >= REVISIT_BYTES).select("page_id", "digest", "size"), "page-digests")
    shared = brief.groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # The narrow rows meet by digest; the pages themselves are dealt out by their id, which no group shares.
    referring = brief.join(shared, ["digest", "size"]).where("NOT page_id <=> original").distinct()
    full = rows.join(referring.withColumnsRenamed({"page_id": "p", "digest": "d", "size": "s"}), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left").select("page_id", "url", "html", "digest", "size", "original")
    full.mapInArrow(_write(folder), CAPTURES).write.parquet(f"{folder}/captures")
    captures = spark.read.schema(CAPTURES).parquet(f"{folder}/captures")
    ordered = captures.repartitionByRange("key", "page_id", "at").sortWithinPartitions("key", "page_id", "at")
    ordered.mapInArrow(_index(folder), DIRECTORY).write.parquet(f"{folder}/directory")
    return spark.read.schema(DIRECTORY).parquet(f"{folder}/directory")


def _lines(uri: str, at: int, size: int) -> list[str]:
    fs, path = common.filesystem(uri)
    with fs.open_input_file(path) as f:
        return zlib.decompress(f.read_at(size, at), 31).decode("utf-8", "surrogatepass").split("\n")[:-1]


def _blocks(batches):
    for batch in batches:
        for uri, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size"))):
            found = [json.loads(x.split(" ", 2)[2]) for x in _lines(uri, at, size)]
            yield pa.record_batch([pa.array([x["file"] for x in found], pa.string()), *(pa.array([x[c] for x in found], pa.int64()) for c in ("at", "size"))], ["file", "at", "size"])


def _records(batches):
    held, f = "", None
    for batch in batches:
        out = []
        for uri, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size"))):
            if uri != held:
                if f is not None:
                    f.close()
                fs, path = common.filesystem(uri)
                held, f = uri, fs.open_input_file(path)
            warc, http, payload = read_record(f.read_at(size, at))
            kind = warc["warc-type"]
            if kind == "response":
                out.append((page_of(warc["warc-record-id"]), len(payload), hashlib.sha1(payload).hexdigest(), kind, None))
            else:
                digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                out.append((page_of(warc["warc-record-id"]), int(http["content-length"]), digest, kind, page_of(warc["warc-refers-to"])))
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    if f is not None:
        f.close()


def places_of(directory: DataFrame) -> DataFrame:
    """``file, at, size`` of every record that the index lists, those that lie together in one task.

    The rows are narrow and make their tasks read much more, so the numbers of tasks
    follow the blocks and the bytes to read; a large file has several tasks.
    """
    spark = directory.sparkSession
    n, size = directory.agg(F.count(F.lit(1)), F.sum("record_bytes")).first()
    blocks = directory.select("file", "at", "size").repartition(common.tasks(spark, n, BLOCKS_EACH), "file", "at")
    places = blocks.mapInArrow(_blocks, "file string, at long, size long")
    return places.repartitionByRange(common.tasks(spark, size or 0, BYTES_EACH), "file", "at").sortWithinPartitions("file", "at")


def read_archives(directory: DataFrame) -> DataFrame:
    """Every record that the index lists: its page, full payload's size and digest, type and reference."""
    return places_of(directory).mapInArrow(_records, RECORDS)


def lookup(directory: DataFrame, url: str) -> Iterator[dict]:
    """The captures of a URL one by one, each with the bytes of its record under ``member``.

    The directory is narrowed by the blocks' key ranges, and its rows come one partition at
    a time, so that a URL with very many captures doesn't fill the driver.
    """
    key = surt(safe_url(url, None))
    for r in directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("first_key", "last_key", "file", "at").toLocalIterator():
        lines = _lines(r["file"], r["at"], r["size"])
        at = bisect.bisect_left(lines, key + " ")
        while at < len(lines) and lines[at].startswith(key + " "):
            capture = json.loads(lines[at].split(" ", 2)[2])
            fs, path = common.filesystem(capture["file"])
            with fs.open_input_file(path) as f:
                yield capture | {"key": key, "member": f.read_at(capture["size"], capture["at"])}
            at += 1
