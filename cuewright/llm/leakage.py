"""Passages of held-out items inside documents (problem 8): Wu-Manber search for many patterns at once.

Patterns are all windows of `words` consecutive words of every item, over the canonical form, lower case, each run of
marks and blanks one blank. A shift table over hashed blocks tells how far a position can be skipped; where the shift is 0, the hash
of the prefix selects the candidate patterns and a direct comparison confirms them. All documents of an Arrow batch advance in step,
long ones as several lanes that overlap by the longest pattern.

A word of look-alike letters only is read in the script of its text, so a Latin passage in a Cyrillic or Greek document may look foreign; such documents are searched
once more with all look-alikes in Latin, and items are searched for in both readings.

Tables are written part by part to files Spark serves to the executors, which map them into memory: the driver holds one part at a time, the Python workers of a machine share the pages,
and all parts are searched in one reading of the documents.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import unicodedata
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cuewright.llm.canonical import _N, _slices, alike_elsewhere, canonical_points, points

BLOCK = 6
#: Bits of the hash of a block, at least and at most.
BITS, MOST_BITS = 18, 26
LANE = 4096
#: Code points of item text in one part of the tables; there are as many parts as the items need.
PART_CHARS = 4_000_000
_SPACE = 0x20


@lru_cache(1)
def _fold() -> tuple[np.ndarray, np.ndarray]:
    low, word = np.arange(_N, dtype=np.uint32), np.zeros(_N, bool)
    for cp in range(0x30000):
        ch = chr(cp)
        c = unicodedata.category(ch)
        word[cp] = c[0] in "LMN"
        if c[0] == "L" and len(x := ch.lower()) == 1:
            low[cp] = ord(x)
    return low, word


def plain_words(texts: pa.Array, latin: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, begin of each row and the end of all, rows that read otherwise with look-alikes in Latin): lower-case words with one blank around each."""
    n = len(texts)
    cp, row = canonical_points(*points(texts), n, latin)
    foreign = np.unique(row[alike_elsewhere(cp)])
    low, word = _fold()
    w = word[cp]
    new = np.ones(len(cp), bool)
    new[1:] = row[1:] != row[:-1]
    prev_w = np.concatenate(([False], w[:-1])) & ~new
    keep = w | prev_w  # a letter, or the first other sign after one
    out = np.where(w, low[cp], _SPACE).astype(np.uint32)[keep]
    r = row[keep]
    # A blank before each row's first word, and one after a row that ends in a letter.
    last = np.zeros(len(r), bool)
    if len(r):
        last[-1] = True
        last[:-1] = r[1:] != r[:-1]
    tail = last & (out != _SPACE)
    first = np.zeros(len(r), bool)
    if len(r):
        first[0] = True
        first[1:] = r[1:] != r[:-1]
    at = np.concatenate((np.flatnonzero(tail) + 1, np.flatnonzero(first)))  # where both go to one place, the end of a row comes first
    rows = np.concatenate((r[tail], r[first]))
    out, r = np.insert(out, at, _SPACE), np.insert(r, at, rows)
    return out, np.searchsorted(r, np.arange(n + 1)), foreign


_RNG = np.random.default_rng(7)
_MIX = (_RNG.integers(1, 1 << 62, BLOCK, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)


class WuManber:
    """The search for the patterns text[start : start + size], each at least BLOCK code points long."""

    ARRAYS = ("text", "start", "size", "owner", "mark", "shift", "keys", "ids")

    def __init__(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray | None = None, mark: np.ndarray | None = None, ids: np.ndarray | None = None):
        self.m = m = int(size.min())
        self.longest = int(size.max())
        self.bits = int(np.clip(np.ceil(np.log2(4.0 * len(text))), BITS, MOST_BITS))
        shift = np.full(1 << self.bits, min(m - BLOCK + 1, 65535), np.uint16)
        keys = np.empty(len(start), np.uint64)
        for lo in range(0, len(start), 1 << 16):
            at = start[lo : lo + (1 << 16)]
            for j in range(BLOCK, m + 1):  # the block that ends at j
                np.minimum.at(shift, self._hash([text[at + j - BLOCK + k] for k in range(BLOCK)]), np.uint16(min(m - j, 65535)))
            keys[lo : lo + (1 << 16)] = self._prefix(text, at)
        order = np.argsort(keys, kind="stable")
        none = np.zeros(len(start), np.int64)
        self.text, self.shift, self.keys = text, shift, keys[order]
        self.start, self.size, self.owner, self.mark = start[order], size[order], (none if owner is None else owner)[order], (none if mark is None else mark)[order]
        self.order, self.ids = order, np.zeros(0, np.uint8) if ids is None else ids

    def save(self, path: str) -> dict:
        """Writes the arrays one after another; what load needs to find them."""
        at, where = 0, {}
        with open(path, "wb") as f:
            for name in self.ARRAYS:
                x = np.ascontiguousarray(getattr(self, name))
                where[name] = (x.dtype.str, at, len(x))
                f.write(x.tobytes() + b"\0" * (-x.nbytes % 64))
                at += x.nbytes + (-x.nbytes % 64)
        return {"name": os.path.basename(path), "m": self.m, "longest": self.longest, "bits": self.bits, "arrays": where}

    @classmethod
    def load(cls, part: dict) -> WuManber:
        w = cls.__new__(cls)
        w.m, w.longest, w.bits = part["m"], part["longest"], part["bits"]
        path = SparkFiles.get(part["name"])
        for name, (kind, at, n) in part["arrays"].items():
            setattr(w, name, np.memmap(path, np.dtype(kind), "r", at, (n,)) if n else np.zeros(0, np.dtype(kind)))
        return w

    def _hash(self, cols: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(cols[0]), np.uint64)
        for c, k in zip(cols, _MIX):
            h += c.astype(np.uint64) * k
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _prefix(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(self.m):
            h = (h + text[at + k].astype(np.uint64)) * _MUL
        return h

    def search(self, cp: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, pattern in the order of keys) of all occurrences in the rows cp[begin[i]:begin[i + 1]]; a lane may report one twice."""
        size = np.diff(begin)
        lanes = np.maximum(1, -(-size // LANE))
        row = np.repeat(np.arange(len(size)), lanes)
        k = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = begin[row] + k * LANE
        stop = np.minimum(begin[row + 1], start + LANE + self.longest)
        pos = start + self.m - 1
        rows, found = [], []
        live = np.flatnonzero(pos < stop)
        while len(live):
            p = pos[live]
            s = self.shift[self._hash([cp[p - BLOCK + 1 + i] for i in range(BLOCK)])]
            hit = np.flatnonzero(s == 0)
            if len(hit):
                q = p[hit] - self.m + 1
                key = self._prefix(cp, q)
                lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
                for i in np.flatnonzero(hi > lo):
                    lane, at = live[hit[i]], q[i]
                    for j in range(lo[i], hi[i]):
                        a, n = self.start[j], self.size[j]
                        if at + n <= begin[row[lane] + 1] and np.array_equal(cp[at : at + n], self.text[a : a + n]):
                            rows.append(row[lane])
                            found.append(j)
            pos[live] = p + np.maximum(s, 1)
            live = live[pos[live] < stop[live]]
        return np.array(rows, np.int64), np.array(found, np.int64)


def build(ids: pa.Array, texts: pa.Array, words: int) -> WuManber | None:
    """The search for all windows of `words` words of the items, in both readings of look-alikes; None if no item has so many. A window an item holds twice counts once."""
    parts, of, both, at = [], [], [], 0
    for latin in (False, True):
        where = np.arange(len(texts)) if not latin else both
        if not len(where):
            break
        cp, begin, foreign = plain_words(texts.take(pa.array(where)), latin)
        both = foreign
        for i, k in enumerate(where):
            blank = np.flatnonzero(cp[begin[i] : begin[i + 1]] == _SPACE) + begin[i] + at
            if len(blank) > words:
                of.append(np.stack([blank[:-words], blank[words:] - blank[:-words] + 1, np.full(len(blank) - words, k)]))
        parts.append(cp)
        at += len(cp)
    if not of:
        return None
    text, (start, size, owner) = np.concatenate(parts), np.concatenate(of, 1)
    # Fingerprints of windows out of running sums: the code points by powers of an odd number, less what stands before, over the power there.
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(text) + 1, _MUL))
        back = np.cumprod(np.full(len(text) + 1, np.uint64(pow(int(_MUL), -1, 1 << 64))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:-1])))
        mark = ((sums[start + size] - sums[start]) * back[start] + size.astype(np.uint64)).astype(np.int64)
    _, first = np.unique(np.stack([owner, mark]), axis=1, return_index=True)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as w:
        w.write_batch(pa.RecordBatch.from_arrays([ids], names=["id"]))
    return WuManber(text, start[first], size[first], owner[first], mark[first], np.frombuffer(sink.getvalue(), np.uint8))


def _files(spark: SparkSession, items: DataFrame, words: int) -> list[dict]:
    """The tables of all items (i, t) as files of the session, and how to load them. Items come to the driver a partition at a time and leave it a part at a time."""
    folder = tempfile.mkdtemp(prefix="cuewright-items")  # Spark's file server reads it; executors get their own copies
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    kind, out, ids, texts, chars = to_arrow_type(items.schema["i"].dataType), [], [], [], 0

    def flush() -> None:
        nonlocal chars
        wm = build(pa.array(ids, kind), pa.array(texts, pa.string()), words) if ids else None
        if wm is not None:
            path = os.path.join(folder, f"items-{uuid.uuid4().hex}.bin")
            out.append(wm.save(path))
            spark.sparkContext.addFile(path)
        ids.clear()
        texts.clear()
        chars = 0

    for r in items.toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        chars += len(r.t)
        if chars >= PART_CHARS:
            flush()
    flush()
    return out


_TABLES: dict[tuple[str, ...], list[tuple[WuManber, pa.Array]]] = {}


def _loaded(parts: list[dict]) -> list[tuple[WuManber, pa.Array]]:
    """The tables of one search, mapped once a worker."""
    names = tuple(p["name"] for p in parts)
    if names not in _TABLES:
        _TABLES.clear()
        found = [WuManber.load(p) for p in parts]
        _TABLES[names] = [(w, pa.ipc.open_stream(pa.py_buffer(w.ids.tobytes())).read_all().column("id").combine_chunks()) for w in found]
    return _TABLES[names]


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 12) -> DataFrame:
    """Rows (doc_id, item_id, windows): documents holding at least `words` consecutive words of an item, and how many different windows.

    The items are the stated query set, of any size: all their tables are searched in one reading of the documents. Documents are never shuffled; only their hits are. Ids keep their types.
    Null texts and ids give no rows, as do items of fewer words; repeated rows count once; further columns are ignored.
    """
    spark = docs.sparkSession
    q = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i is not null and t is not null").distinct()
    parts = _files(spark, q, words)
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).where("doc_id is not null and t is not null")
    schema = T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), T.StructField("item_id", q.schema["i"].dataType), T.StructField("w", T.LongType())])
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields[:2], T.StructField("windows", T.LongType())]))

    def run(batches):
        tables = _loaded(parts)
        for batch in batches:
            for part in _slices(batch, "t", 4 << 20):
                rows_of, texts = None, part.column("t")
                for latin in (False, True):
                    cp, begin, foreign = plain_words(texts, latin)
                    for w, ids in tables:
                        rows, found = w.search(cp, begin)
                        if len(rows):
                            rows = rows if rows_of is None else rows_of[rows]
                            hit = np.unique(np.stack([rows, w.owner[found], w.mark[found]]), axis=1)
                            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(hit[0])), ids.take(pa.array(hit[1])), pa.array(hit[2])], names=["doc_id", "item_id", "w"])
                    if latin or not len(foreign):
                        break
                    rows_of, texts = foreign, texts.take(pa.array(foreign))

    return d.mapInArrow(run, schema).distinct().groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("windows"))
