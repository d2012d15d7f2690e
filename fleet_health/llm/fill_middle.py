"""Fill-in-the-middle transformation by secondary-sort assembly.

1. Every text is cut into its units (lines); prefix, middle and suffix are runs
   of whole units, and each is emitted as pieces of at most ``PIECE_BYTES``
   bytes, keyed by (row, output position).
2. One shuffle by row and a sort within the partitions by (row, position) bring
   the pieces into output order.  They are streamed into an incremental
   SHA-256, one open text at a time, so no text is put together in memory.
3. The same stream is read as the output it is: the markers are looked for in
   the bytes, whatever the borders of the pieces, and what lies between them is
   re-keyed by its place in the original.  A second sort within the same
   partitions (no shuffle, the key is the same) and a second stream of digests
   rebuild the original text from output and form.

Sorting spills in the JVM, the streams hold one piece.  Partitions are keyed by
row, so equal texts, ids or sources make no hot key; one very long text is as
many pieces as it needs.  Row numbers are those of the scan, which reads files
in a fixed order; an input whose rows may change places when a task is rerun
has to be written first.

Defined results: a null text counts as empty, an empty text is plain with n = 0.
A null id is hashed as the word null, any other id as its text.  Rows that
repeat an id or a text are rows of their own with equal results.  An empty
table gives an empty result.  Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

# fixed values: the markers, in the order prefix, suffix, middle, and the seed
MARKS = {"p": b"<P>", "s": b"<S>", "m": b"<M>"}
SEED = "7:"
PLAN = {"psm": "psm", "spm": "spm"}  # sections in output order
ORIGINAL = "pms"                     # sections in the order of the text
PIECE_BYTES = 1 << 16
BATCH_BYTES = 4 << 20

_HEAD = "doc_id {id}, n bigint, form string, prefix_chars bigint, middle_chars bigint"
_PIECE = f"row bigint, pos bigint, piece binary, {_HEAD}"
_TURNED = f"row bigint, section int, seq bigint, piece binary, output_sha256 string, {_HEAD}"
_RESULT = f"{_HEAD}, output_sha256 string, restored_sha256 string"


class _Out:
    """Rows gathered into batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, *row, size: int = 100) -> None:
        self.rows.append(row)
        self.bytes += size

    def full(self) -> bool:
        return self.bytes >= BATCH_BYTES

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, self.schema)], schema=self.schema)


def _schema(spark_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(spark_schema)


def _draws(doc_id) -> list[int]:
    h = hashlib.sha256(f"{SEED}{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * i:8 * i + 8], 16) for i in range(4)]


def _chars(a: np.ndarray) -> int:
    return int(np.count_nonzero((a & 0xC0) != 0x80))


def _cut(data: bytes, doc_id, rate: int, spm: int):
    """(n, form, prefix_chars, middle_chars, [(marker, begin, end)] in output order)."""
    a = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(a == 10) + 1
    if len(a) and (not len(ends) or ends[-1] < len(a)):
        ends = np.append(ends, len(a))
    n = len(ends)
    h1, h2, h3, h4 = _draws(doc_id)
    if not data or any(m in data for m in MARKS.values()) or h3 % 100 >= rate:
        return n, "plain", None, None, [(b"", 0, len(data))]
    at = lambda k: int(ends[k - 1]) if k else 0
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    span = {"p": (0, at(lo)), "m": (at(lo), at(hi)), "s": (at(hi), len(data))}
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, _chars(a[:at(lo)]), _chars(a[at(lo):at(hi)]), [(MARKS[s], *span[s]) for s in PLAN[form]]


def _emit(schema: pa.Schema, rate: int, spm: int, size: int):
    """(row, doc_id, text) to pieces in output order; position -1 holds the row's head."""
    def fn(batches):
        out = _Out(schema)
        for b in batches:
            for row, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                data = bytes(text)
                n, form, prefix, middle, sections = _cut(data, doc_id, rate, spm)
                out.add(row, -1, None, doc_id, n, form, prefix, middle)
                pos = 0
                for mark, lo, hi in sections:
                    for at in range(lo, max(hi, lo + 1), size):
                        piece = (mark if at == lo else b"") + data[at:min(at + size, hi)]
                        out.add(row, pos, piece, None, None, None, None, None, size=100 + len(piece))
                        pos += 1
                        if out.full():
                            yield out.take()
            if out.rows:
                yield out.take()
    return fn


class _Reader:
    """Takes an output apart as its bytes come: yields (section, bytes)."""

    def __init__(self, form: str):
        self.plan = PLAN.get(form, "")
        self.at, self.held = -1, b""

    def feed(self, data: bytes):
        data = self.held + data
        self.held = b""
        while self.at + 1 < len(self.plan):
            mark = MARKS[self.plan[self.at + 1]]
            k = data.find(mark)
            if k < 0:
                # the marker may go on in the next piece
                keep = max(len(data) - len(mark) + 1, 0)
                self.held, data = data[keep:], data[:keep]
                break
            if k and self.at >= 0:
                yield self.section(), data[:k]
            data, self.at = data[k + len(mark):], self.at + 1
        if data:
            yield self.section(), data

    def section(self) -> int:
        return ORIGINAL.index(self.plan[self.at]) if self.plan else 0

    def end(self):
        if self.held:
            yield self.section(), self.held


def _rows(batches, names):
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names))


def _turn(schema: pa.Schema):
    """Pieces in output order to pieces keyed by their place in the original; a
    row's head follows with the digest of its output."""
    def fn(batches):
        out, row, head, digest, reader, seq = _Out(schema), None, None, None, None, 0

        def close():
            nonlocal seq
            for section, data in reader.end():
                out.add(row, section, seq, data, None, *[None] * 5, size=100 + len(data))
                seq += 1
            out.add(row, -1, -1, None, digest.hexdigest(), *head)

        for r, pos, piece, *h in _rows(batches, ["row", "pos", "piece", "doc_id", "n", "form", "prefix_chars", "middle_chars"]):
            if pos < 0:
                if head is not None:
                    close()
                row, head, digest, reader, seq = r, h, hashlib.sha256(), _Reader(h[2]), 0
                continue
            digest.update(piece)
            for section, data in reader.feed(piece):
                out.add(row, section, seq, data, None, *[None] * 5, size=100 + len(data))
                seq += 1
            if out.full():
                yield out.take()
        if head is not None:
            close()
        if out.rows:
            yield out.take()
    return fn


def _restore(schema: pa.Schema):
    def fn(batches):
        out, head, digest = _Out(schema), None, None
        for section, piece, done, *h in _rows(batches, ["section", "piece", "output_sha256", "doc_id", "n", "form",
                                                        "prefix_chars", "middle_chars"]):
            if section >= 0:
                digest.update(piece)
                continue
            if head is not None:
                out.add(*head, digest.hexdigest())
                if out.full():
                    yield out.take()
            head, digest = [*h, done], hashlib.sha256()
        if head is not None:
            out.add(*head, digest.hexdigest())
        if out.rows:
            yield out.take()
    return fn


def _map(df: DataFrame, make, ddl: str, id_type: str, *args) -> DataFrame:
    ddl = ddl.format(id=id_type)
    empty = df.sparkSession.createDataFrame([], ddl)
    return df.mapInArrow(make(_schema(empty.schema), *args), ddl)


def output_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 100, spm: int = 50,
                  piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The transformed texts as pieces (``row``, ``pos``, ``piece`` bytes) in
    output order within each partition, all of a row in one; ``pos`` -1 is the
    row's head (``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``).
    ``rate`` per cent of the rows are transformed, ``spm`` per cent of them
    with the suffix first."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                       F.encode(text_of(text_col), "utf-8").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return (_map(rows, _emit, _PIECE, id_type, rate, spm, piece_bytes)
            .repartition("row").sortWithinPartitions("row", "pos"))


def restored_pieces(pieces: DataFrame) -> DataFrame:
    """The original texts, rebuilt from output and form: pieces in the order of
    (``row``, ``section``, ``seq``); section -1 is the row's head with the
    digest of the output."""
    id_type = pieces.schema["doc_id"].dataType.simpleString()
    return _map(pieces, _turn, _TURNED, id_type).sortWithinPartitions("row", "section", "seq")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 100, spm: int = 50,
                   piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n`` units, ``form``,
    ``prefix_chars``, ``middle_chars`` and the digests of the output and of the
    text restored from it."""
    pieces = output_pieces(docs, id_col, text_col, rate, spm, piece_bytes)
    id_type = pieces.schema["doc_id"].dataType.simpleString()
    return _map(restored_pieces(pieces), _restore, _RESULT, id_type)
