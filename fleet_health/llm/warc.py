"""WARC archives with a two-level capture index.

Writing: the captures are sorted by (reversed-host URL key, id) over range
partitions.  Each task writes its range as archive files of gzip members, one
record each, and beside each archive a block file: its index entries (key, id,
type, offset, length) in blocks of ``BLOCK`` entries, each a gzip member.  The
directory has one row per block: the block file, where the block stands, and
its first and last key.  It is stored as Parquet below the archive folder.

Looking up: the first and last key of each archive (one entry per archive file,
as many as the folder has) route a key to its archives; there the archive's part
of the directory is binary-searched for the block, the block is read by range
and binary-searched for the key, and the record is read by range.  Keys are
grouped by archive and worked off in order, so a block is read once.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with
the smallest id is a response and the others are revisits, which hold no payload
but its digest and the response's record id.

Files are written by pyarrow's file systems under names that no other attempt
uses, and only those named by the committed directory count, so a task that is
run twice or dies half way leaves nothing behind that is read.

Defined results: a null html is an empty payload; a null url has the empty key
and the record's own id as target.  A null id sorts last.  Rows that repeat the
smallest id of equal payloads are all responses.  An empty table gives an empty
archive.  Ids and urls keep their text, control characters and spaces percent-
encoded in the headers.  Columns other than id, url and html are not read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, work_dir

MIN_REVISIT = 100
BLOCK = 256
ARCHIVE_BYTES = 1 << 30
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"
URN = "urn:x-capture:"
DIRECTORY = ("archive string, blocks string, first_key string, last_key string, offset bigint, length bigint, entries bigint")
RECORD = ("key string, id string, type string, target string, payload_bytes bigint, payload_digest string, refers_to string, "
          "archive string, offset bigint, length bigint")


def url_key(url: Column) -> Column:
    """Reversed host labels, then path and query as they are."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(u.contains("://"), F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), rest)).otherwise(u)


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


def _header_text(s: str) -> str:
    return quote(s, safe="".join(chr(c) for c in range(33, 127) if chr(c) not in "<>"))


def record_bytes(id: str | None, url: str | None, kind: str, payload: bytes | None, digest: str, refers: str | None) -> bytes:
    urn = lambda x: f"<{URN}{'null' if x is None else 'id:' + quote(x, safe='')}>"
    head = [("WARC-Type", kind), ("WARC-Record-ID", urn(id)), ("WARC-Date", DATE),
            ("WARC-Target-URI", urn(id)[1:-1] if url is None else _header_text(url)),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if kind == "revisit":
        head += [("WARC-Refers-To", urn(refers)),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        body = (http + "\r\n").encode()
    else:
        body = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + f"Content-Length: {len(body)}\r\n\r\n"
    return gzip.compress(text.encode() + body + b"\r\n\r\n", LEVEL, mtime=0)


def parse_record(data: bytes) -> tuple[dict, bytes]:
    """Headers and payload of one record; raises where the record is damaged."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[:int(h["Content-Length"])]
    if rest[len(body):] != b"\r\n\r\n":
        raise ValueError("wrong record length")
    return h, body.partition(b"\r\n\r\n")[2]


def _urn_id(urn: str) -> str | None:
    x = urn.strip("<>")[len(URN):]
    return None if x == "null" else unquote(x[len("id:"):])


class _Archive:
    """An archive file and its block file while they are written."""

    def __init__(self, folder: str):
        name = f"{folder}/{uuid.uuid4().hex}"
        self.archive, self.blocks = f"{name}.warc.gz", f"{name}.index.gz"
        fs, path = _open(self.archive)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.index = fs.open_output_stream(path, compression=None), fs.open_output_stream(_open(self.blocks)[1], compression=None)
        self.at, self.index_at, self.held, self.directory = 0, 0, [], []

    def add(self, key, id, kind, data: bytes):
        self.out.write(data)
        self.held.append((key, id, kind, self.at, len(data)))
        self.at += len(data)
        if len(self.held) == BLOCK:
            self.flush()

    def flush(self):
        if self.held:
            data = gzip.compress("\n".join(map(json.dumps, self.held)).encode(), LEVEL, mtime=0)
            self.index.write(data)
            self.directory.append((self.archive, self.blocks, self.held[0][0], self.held[-1][0], self.index_at, len(data), len(self.held)))
            self.index_at += len(data)
            self.held = []

    def close(self):
        self.flush()
        self.out.close()
        self.index.close()
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*self.directory)],
            names=["archive", "blocks", "first_key", "last_key", "offset", "length", "entries"])


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(url_key(F.col(url_col)).alias("key"), F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        html.alias("html"), F.sha2(html, 256).alias("digest"))


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             min_revisit: int = MIN_REVISIT) -> DataFrame:
    """The records that are revisits: ``key``, ``id``, ``digest``, ``refers_to``.
    Payloads are read for their digests but not moved."""
    p = _pages(pages, id_col, url_col, html_col).filter(F.octet_length("html") >= min_revisit).select("key", "id", "digest")
    # a payload that a third of all pages share meets in the partial aggregate
    first = p.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return p.join(first, "digest").filter(~F.col("id").eqNullSafe(F.col("refers_to"))).select("key", "id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", archives: int | None = None, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write ``pages`` below ``folder`` (default: a new one in the shared
    folder) and return it; its directory is ``<folder>/directory``.

    Payloads are shuffled once, into ranges of (key, id, digest).  What is known
    of the revisits goes the same way: a marker row sorts just before the rows
    it is about, and the writer turns those into revisits."""
    spark = pages.sparkSession
    folder = folder or work_dir(spark, "warc")
    archives = archives or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = stored(revisits(pages, id_col, url_col, html_col), "revisits")
    text = "string"
    rows = _pages(pages, id_col, url_col, html_col).select(
        "key", "id", "digest", F.lit(True).alias("is_page"), F.col("id").cast(text).alias("sid"), "url",
        F.col("html").cast("binary").alias("payload"), F.lit(None).cast(text).alias("refers"))
    marks = marks.select("key", "id", "digest", F.lit(False).alias("is_page"), F.col("id").cast(text).alias("sid"),
                         F.lit(None).cast(text).alias("url"), F.lit(None).cast("binary").alias("payload"), F.col("refers_to").cast(text).alias("refers"))
    order = ["key", F.col("id").isNull(), "id", "digest"]
    c = rows.unionByName(marks).repartitionByRange(archives, *order).sortWithinPartitions(*order, "is_page")
    c = c.select("key", "sid", "digest", "is_page", "url", "payload", "refers")

    def run(batches):
        w, mark = None, None
        for b in batches:
            for r in range(b.num_rows):
                key, id, digest, is_page, url, payload, refers = (b.column(i)[r].as_py() for i in range(7))
                if not is_page:
                    mark = ((key, id, digest), refers)
                    continue
                again = mark is not None and mark[0] == (key, id, digest)
                kind = "revisit" if again else "response"
                w = w or _Archive(folder)
                w.add(key, id, kind, record_bytes(id, url, kind, payload, digest, mark[1] if again else None))
                if w.at >= archive_bytes:
                    yield w.close()
                    w = None
        if w:
            yield w.close()

    stored(c.mapInArrow(run, DIRECTORY), "directory", f"{folder}/directory")
    return folder


def directory(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DIRECTORY).parquet(f"{folder}/directory")


class _Reader:
    """Range reads of one archive through its part of the directory."""

    def __init__(self, rows: list[dict]):
        self.rows = sorted(rows, key=lambda r: r["offset"])
        self.last = [r["last_key"] for r in self.rows]
        self.archive = self.rows[0]["archive"]
        fs, path = _open(self.archive)
        self.file, self.index, self.block = fs.open_input_file(path), fs.open_input_file(_open(self.rows[0]["blocks"])[1]), (None, None)

    def entries(self, n: int) -> list:
        if self.block[0] != n:
            r = self.rows[n]
            self.index.seek(r["offset"])
            lines = gzip.decompress(self.index.read(r["length"])).decode().split("\n")
            self.block = (n, [json.loads(x) for x in lines])
        return self.block[1]

    def find(self, key: str):
        n = bisect.bisect_left(self.last, key)
        while n < len(self.rows) and self.rows[n]["first_key"] <= key:
            got = self.entries(n)
            i = bisect.bisect_left(got, key, key=lambda e: e[0])
            while i < len(got) and got[i][0] == key:
                yield got[i]
                i += 1
            n += 1

    def read(self, entry) -> dict:
        key, id, kind, offset, length = entry
        self.file.seek(offset)
        h, payload = parse_record(self.file.read(length))
        response = kind == "response"
        digest = hashlib.sha256(payload).hexdigest() if response else h["WARC-Payload-Digest"].partition(":")[2]
        if h["WARC-Type"] != kind or h["WARC-Payload-Digest"] != f"sha256:{digest}":
            raise ValueError(f"damaged record at {offset} of {self.archive}")
        return {"key": key, "id": _urn_id(h["WARC-Record-ID"]), "type": kind, "target": h["WARC-Target-URI"],
                "payload_bytes": len(payload) if response else None, "payload_digest": digest,
                "refers_to": None if response else _urn_id(h["WARC-Refers-To"]),
                "archive": self.archive, "offset": offset, "length": length, "payload": payload if response else None}


def lookup(folder: str, wanted: DataFrame, payload: bool = False) -> DataFrame:
    """All records whose key is in ``wanted`` (``key``), once each: ``key``,
    ``id``, ``type``, ``target``, ``payload_bytes`` and ``payload_digest`` (of the
    bytes read; for revisits null and as recorded), ``refers_to``, place, and
    with ``payload`` the bytes."""
    spark = wanted.sparkSession
    blocks = directory(spark, folder)
    # one entry per archive file: sorted, it is the index's top level
    top = sorted(tuple(r) for r in blocks.groupBy("archive").agg(F.min("first_key").alias("a"), F.max("last_key").alias("b"))
                 .select("a", "b", "archive").collect())
    lows, highs, names = [t[0] for t in top], [t[1] for t in top], [t[2] for t in top]

    def route(batches):
        for b in batches:
            keys, where = [], []
            for k in b.column(0).to_pylist():
                # archives are ranges of one order: those that can hold a key are neighbours
                for i in range(bisect.bisect_left(highs, k), bisect.bisect_right(lows, k)):
                    keys.append(k)
                    where.append(names[i])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(where, pa.string())], names=["key", "archive"])

    routed = wanted.select("key").filter("key is not null").distinct().mapInArrow(route, "key string, archive string")
    schema = RECORD + (", payload binary" if payload else "")
    names_out = [x.strip().split(" ")[0] for x in schema.split(",")]
    types = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in ("payload_bytes", "offset", "length") else pa.string())
                       for n in names_out])

    def read(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], types.field(n).type) for n in names_out})
        r = _Reader(right.to_pylist())
        out = {n: [] for n in names_out}
        for k in sorted(left.column("key").to_pylist()):
            for e in r.find(k):
                got = r.read(e)
                for n in names_out:
                    out[n].append(got[n])
        return pa.table(out, schema=types)

    return routed.groupBy("archive").cogroup(blocks.groupBy("archive")).applyInArrow(read, schema)


def round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", **params) -> DataFrame:
    """Write the archives, then find every page's capture in them again:
    ``page_id``, ``payload_bytes`` and ``payload_digest`` of the full payload,
    ``record_type``, ``refers_to``, ``archive``, ``offset``, ``length``."""
    folder = write_archives(pages, folder, id_col, url_col, html_col, **params)
    kind = pages.schema[id_col].dataType
    found = stored(lookup(folder, pages.select(url_key(F.col(url_col)).alias("key"))), "captures")
    found = found.withColumn("page_id", F.col("id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
    # the full payload of a revisit is that of the response it refers to
    full = (found.filter("type = 'response'").groupBy(F.col("id").alias("_id"), F.col("payload_digest").alias("_digest"))
            .agg(F.max("payload_bytes").alias("_bytes")))
    got = found.join(full, (F.col("refers_to").cast("string") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return got.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest",
                      F.col("type").alias("record_type"), "refers_to", "archive", "offset", "length")
