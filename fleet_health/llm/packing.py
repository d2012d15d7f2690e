"""Packing tokenised documents into windows by minimum bin slack.

1. Texts are tokenised in Arrow batches; a document's ids end with a separator.
   It is cut into full windows and one remaining piece, so all that matters
   from there on is a piece's length.  Pieces carry no ids, only their length
   and checksum.
2. The histogram of lengths has at most ``window`` rows whatever the input.  On
   it the driver plans the bins: it takes the longest length left, a bitset
   subset-sum programme over the lengths left (with counts, by binary
   splitting) finds the sum that comes closest to the capacity, backtracking
   gives how many pieces of each length make it, and that pattern is repeated
   as often as the counts allow.
3. Pieces of a length are numbered 0 .. n-1, in hash buckets of bounded size, as
   one length (full windows, copies) may hold a third of all pieces.  The
   number and the plan's running counts give sequence and offset; the plan is
   joined as one row per length (at most ``window`` rows, so it is broadcast).

Defined results: a null or empty text is the separator alone.  Rows that repeat
an id are documents of their own.  An empty table gives an empty result.
Columns other than id and text are not read.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Hasher, chunked, code_points
from .common import numbered, stored, text_of

WINDOW = 1024
SEPARATOR = 0
# pre-tokens whose ids a worker keeps
CACHE = 1_500_000
CHUNK_CHARS = 1_000_000
LINE = 2_000
PIECES = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"

# --- fixed values: character classes of the byte-level pre-tokeniser ----
# letters, numbers, white space (Unicode White_Space), others
_LETTER, _NUMBER, _SPACE, _OTHER, _UNSURE = 0, 1, 2, 3, 4
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Unassigned code points are unsure: another Unicode version may differ."""
    first = {"L": _LETTER, "N": _NUMBER}
    t = np.array([_UNSURE if (c := unicodedata.category(chr(i))) == "Cn" else first.get(c[0], _OTHER)
                  for i in range(0x110000)], np.uint8)
    t[_WHITE] = _SPACE
    return t


def pre_tokens(cp: np.ndarray, bounds: np.ndarray):
    """Starts of the pre-tokens of texts without unsure characters: runs of one
    class, a single space before a run belongs to it, of other white space the
    last character stands apart, English suffixes after an apostrophe too."""
    n = len(cp)
    cls = _classes()[cp]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = np.ones(n, bool)
    start[1:] = cls[1:] != cls[:-1]
    space = cls == _SPACE
    # the last white space before a run
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
    start |= before
    joins = np.flatnonzero(before & (cp == 32)) + 1
    start[joins] = False
    start[bounds[:-1][bounds[:-1] < n]] = True
    for i in np.flatnonzero((cp == 39) & start):
        stop = bounds[np.searchsorted(bounds, i, side="right")]
        for s in _SUFFIXES:
            j = i + 1 + len(s)
            if j <= stop and all(cp[i + 1 + k] == ord(x) for k, x in enumerate(s)):
                start[i + 1:j] = False
                if j < n:
                    start[j] = True  # what follows the suffix begins anew
                break
    return np.flatnonzero(start)


class Encoder:
    """Token ids of whole texts, equal to ``Tokenizer.encode`` without special
    tokens.  Byte-level BPE works on one pre-token at a time, so each distinct
    pre-token is encoded once per worker and texts are put together from those.
    Texts with characters whose class is unsure go to the tokenizer whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tok.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # the byte-level alphabet has a character a byte
        self.clear()

    def clear(self):
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.offset = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: list) -> list:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, texts: list) -> None:
        """Pre-tokens of a space and a run stay the same when they stand one
        after the other, so they are encoded as lines of many; where each ends
        follows from its bytes."""
        spaced = np.array([len(t) > 1 and t[0] == " " and not t[1].isspace() for t in texts])
        line = [t for t, s in zip(texts, spaced) if s]
        keys = np.concatenate([keys[spaced], keys[~spaced]])
        got = [np.array(x, np.uint32) for x in self._encode(["".join(line[i:i + LINE]) for i in range(0, len(line), LINE)])]
        got = np.concatenate(got) if got else np.zeros(0, np.uint32)
        bytes_at = np.cumsum(self.n_bytes[got])
        ends = np.searchsorted(bytes_at, np.cumsum(np.fromiter((len(t.encode()) for t in line), np.int64, len(line)))) + 1
        rest = self._encode([t for t, s in zip(texts, spaced) if not s])
        sizes = np.concatenate([np.diff(ends, prepend=0), np.fromiter(map(len, rest), np.int64, len(rest))])
        order = np.argsort(keys)
        n = len(self.row)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.row = np.insert(self.row, at, n + order)
        self.offset = np.concatenate([self.offset, np.cumsum(sizes) + self.offset[-1]])
        self.ids = np.concatenate([self.ids, got, np.fromiter(chain.from_iterable(rest), np.uint32)])

    def _rows(self, keys: np.ndarray, text_of) -> np.ndarray:
        """The rows of sorted ``keys``; ``text_of(i)`` is the i-th key's text."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        fresh = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(fresh):
            self._learn(keys[fresh], [text_of(i) for i in fresh.tolist()])
            at = np.searchsorted(self.keys, keys)
        return self.row[at]

    def batch(self, texts: list) -> list[np.ndarray]:
        cp, bounds = code_points(texts)
        if len(cp) == 0:
            return [np.zeros(0, np.uint32)] * len(texts)
        unsure = np.add.reduceat(_classes()[cp] == _UNSURE, bounds[:-1][np.diff(bounds) > 0])
        if unsure.any():
            full = np.flatnonzero(np.diff(bounds) > 0)
            odd = set(full[unsure > 0].tolist())
            plain = iter(self.batch([t for i, t in enumerate(texts) if i not in odd]))
            return [np.array(self._encode([t])[0], np.uint32) if i in odd else next(plain) for i, t in enumerate(texts)]
        start = pre_tokens(cp, bounds)
        end = np.append(start[1:], len(cp))
        keys, first, inverse = np.unique(Hasher(cp).of(start, end), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.clear()
        joined = "".join(texts)
        row = self._rows(keys, lambda i: joined[start[first[i]]:end[first[i]]])[inverse]
        lo = self.offset[row]
        size = self.offset[row + 1] - lo
        to = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(lo - to[:-1], size) + np.arange(to[-1])]
        cut = to[np.searchsorted(start, bounds)]
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The documents' pieces: ``doc_id``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``.  ``tokenizer`` names a file that all executors have."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            ids = b.column(0)
            for lo, _, texts in chunked(b.column(1), CHUNK_CHARS):
                at, start, length, crc, total = [], [], [], [], []
                for i, got in enumerate(enc.batch(texts)):
                    got = np.append(got, np.uint32(SEPARATOR)).astype("<u4")
                    for s in range(0, len(got), window):
                        piece = got[s:s + window]
                        at.append(lo + i)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(got))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return d.mapInArrow(run, PIECES.format(id=d.schema["doc_id"].dataType.simpleString()))


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length come closest to ``room`` without going
    beyond it: bit s of the set says that sum s can be made."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= take * length
            used[length] = used.get(length, 0) + take
    return used


def plan_bins(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces of each length) and how often each is used."""
    left = {k: v for k, v in counts.items() if v}
    plan = []
    while left:
        top = max(left)
        rest = {k: v - (k == top) for k, v in left.items() if v - (k == top)}
        used = closest_fill(rest, window - top)
        used[top] = used.get(top, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        plan.append((used, times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (stored; ``doc_id``, ``start``, ``length`` and more) with
    ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    histogram = pieces.groupBy("length").count().collect()  # at most ``window`` rows
    rows: dict[int, list] = {r["length"]: [] for r in histogram}
    taken, sequence = dict.fromkeys(rows, 0), 0
    for used, times in plan_bins({r["length"]: r["count"] for r in histogram}, window):
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows[length].append((taken[length], n, sequence, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    plan = spark.createDataFrame([(k, v) for k, v in rows.items()],
                                 "length bigint, steps array<struct<lo:bigint,n:bigint,sequence:bigint,offset:bigint>>")
    p = numbered(pieces, ["length"], ["doc_id", "start", "ids_crc32"], {r["length"]: r["count"] for r in histogram})
    p = p.join(F.broadcast(plan), "length")
    p = p.withColumn("_s", F.element_at("steps", F.size(F.filter("steps", lambda s: s["lo"] <= F.col("_rank")))))
    into = F.col("_rank") - F.col("_s.lo")
    return (p.withColumn("sequence_id", F.col("_s.sequence") + F.floor(into / F.col("_s.n")).cast("long"))
            .withColumn("offset", F.col("_s.offset") + F.pmod(into, F.col("_s.n")) * F.col("length"))
            .select(*pieces.columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``."""
    return pack(stored(token_pieces(docs, tokenizer, window, id_col, text_col), "pieces"), window)
