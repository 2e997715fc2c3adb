"""Texts that look the same, brought to one form (problem 10).

A whole Arrow batch is one array of code points. Table gathers expand every code point (full-width forms, joined letters,
dots, accents taken apart, kinds of blank and hyphen, invisible characters to nothing), look-alike letters are settled
by the script of their word, and marks are composed again by searches over all adjacent pairs at once. No step
calls a string function per row.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.session import cut

# Letters of Latin, Cyrillic and Greek that look alike, one class a line, a blank where a script has none.
LOOK_ALIKE = """
aаα AАΑ BВΒ cс  CС  eе  EЕΕ hһ  HНΗ iіι IІΙ jј  JЈ  k κ KКΚ MМΜ N Ν oоο OОΟ pрρ PРΡ qԛ
sѕ  SЅ  TТΤ u υ v ν wԝω xхχ XХΧ yуγ YҮΥ Z Ζ dԁ  GԌ  lӏ
"""
# Letters of other scripts and extensions (second) that look like a Latin one (first).
ALSO_ALIKE = "aɑ gɡ oօ hհ uս AᎪ BᏴ CᏟ DᎠ EᎬ GᏀ HᎻ JᎫ KᏦ LᏞ MᎷ PᏢ RᎡ SᏚ TᎢ VᏙ WᎳ ZᏃ SՏ UՍ"
HYPHENS = (0x2010, 0x2011, 0x2012, 0x2212, 0xFE63, 0xFF0D, 0x2043, 0x02D7)
#: Decompositions of these kinds change no look; superscripts, circles and fractions do.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>")
_LATIN, _CYRILLIC, _GREEK = 0, 1, 2
_N = sys.maxunicode + 1


def _classes() -> list[tuple[str, str, str]]:
    out, line = [], LOOK_ALIKE.replace("\n", " ")
    for item in line.split():
        out.append(item)
    # An entry of two letters is Latin and Cyrillic; "N Ν" (Latin and Greek) reads as two entries of one letter each.
    rows, k = [], 0
    while k < len(out):
        e = out[k]
        if len(e) == 1 and k + 1 < len(out) and len(out[k + 1]) == 1:
            rows.append((e, "", out[k + 1]))
            k += 2
        else:
            rows.append((e[0], e[1] if len(e) > 1 else "", e[2] if len(e) > 2 else ""))
            k += 1
    return rows


def _expand(cp: int, deep: int = 0) -> list[int]:
    ch = chr(cp)
    if cp in HYPHENS:
        return [0x2D]
    cat = unicodedata.category(ch)
    if cat == "Zs":
        return [0x20]
    if cp in (0x85, 0x2028, 0x2029):
        return [0x0A]
    if cat == "Cf" or cp == 0x0D or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5):
        return []
    d = unicodedata.decomposition(ch)
    if not d or deep > 8 or 0xAC00 <= cp <= 0xD7A3:
        return [cp]
    parts = d.split()
    if parts[0].startswith("<"):
        if parts[0] not in _SAME_LOOK or parts[1] == "0020":
            return [cp]
        parts = parts[1:]
    return [x for p in parts for x in _expand(int(p, 16), deep + 1)]


def read_confusables(path: str) -> tuple[tuple[int, int], ...]:
    """Pairs (letter, the letter it looks like) from a file in the format of Unicode's confusables.txt (`0430 ; 0061 ; MA # ...`); entries of several code points are left out."""
    out = []
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = [x.split() for x in line.split("#")[0].split(";")]
            if len(parts) > 1 and len(parts[0]) == len(parts[1]) == 1:
                a, b = int(parts[0][0], 16), int(parts[1][0], 16)
                if chr(a).isalpha() and chr(b).isalpha():
                    out.append((a, b))
    return tuple(out)


@lru_cache(2)
def _tables(more_alike: tuple[tuple[int, int], ...] = ()) -> dict[str, np.ndarray]:
    first, length, more = np.arange(_N, dtype=np.uint32), np.ones(_N, np.uint8), {}
    ccc, letter = np.zeros(_N, np.uint8), np.zeros(_N, bool)
    pairs: dict[int, int] = {}
    for cp in range(_N):
        if 0x30000 <= cp < 0xE0000 or 0xE01F0 <= cp or 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Cn":
            continue
        letter[cp] = cat[0] in "LMN"
        ccc[cp] = unicodedata.combining(ch)
        d = unicodedata.decomposition(ch)
        if d or cat in ("Zs", "Cf", "Pd", "Cc", "Zl", "Zp", "Mn", "Lo", "Sm", "Po", "Sk"):
            x = _expand(cp)
            if x != [cp]:
                length[cp] = len(x)
                first[cp] = x[0] if x else 0
                if len(x) > 1:
                    more[cp] = x
        if d and not d.startswith("<") and len(d.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
            a, z = (int(p, 16) for p in d.split())
            pairs[(a << 21) | z] = cp
    start, data = np.zeros(_N, np.uint32), []
    for cp, x in more.items():
        start[cp] = len(data)
        data += x
    to = np.zeros((3, _N), np.uint32)
    to[:] = np.arange(_N)
    alike, script = np.zeros(_N, bool), np.full(_N, -1, np.int8)
    for row in _classes():
        for c in row:
            if c:
                alike[ord(c)] = True
                for s, other in enumerate(row):
                    if other:
                        to[s, ord(c)] = ord(other)
                    elif s and row[0]:
                        to[s, ord(c)] = ord(row[0]) if not c.isascii() else ord(c)
    for a, b in [(ord(x[1]), ord(x[0])) for x in ALSO_ALIKE.split()] + list(more_alike):
        if not alike[a]:
            alike[a] = True
            to[:, a] = to[:, b]
    for cp in range(0x250):
        if letter[cp] and chr(cp).isalpha():
            script[cp] = _LATIN
    script[0x400:0x530], script[0x370:0x400] = _CYRILLIC, _GREEK
    keys = np.array(sorted(pairs), np.int64)
    return {
        "first": first, "length": length, "start": start, "data": np.array(data, np.uint32), "ccc": ccc, "letter": letter, "to": to, "alike": alike,
        "script": script, "keys": keys, "made": np.array([pairs[k] for k in keys.tolist()], np.uint32),
    }


def _per_group(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group[values], minlength=n)


def _scripts(cp: np.ndarray, row: np.ndarray, t: dict, n: int, latin: bool = False) -> np.ndarray:
    """Look-alike letters in the script of their word: that of its letters of one script only, else the text's, else Latin; latin: all of them in Latin."""
    alike = t["alike"][cp]
    if not alike.any():
        return cp
    if latin:
        return np.where(alike, t["to"][_LATIN, cp], cp)
    inside = t["letter"][cp]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (row[1:] != row[:-1])
    word = np.cumsum(begins) - 1
    words = int(word[-1]) + 1 if len(word) else 0
    own = np.where(inside & ~alike, t["script"][cp], -1)
    by_word = np.stack([_per_group(own == s, word, words) for s in range(3)])
    by_row = np.stack([_per_group(own == s, row, n) for s in range(3)])
    of_row = by_row.argmax(0)
    best = by_word.argmax(0)
    ends = np.zeros(words, np.int64)
    ends[word[inside]] = row[inside]
    best = np.where(by_word.max(0) > 0, best, of_row[ends])
    out = cp.copy()
    k = np.flatnonzero(alike)
    out[k] = t["to"][best[word[k]], cp[k]]
    return out


def _order(cp: np.ndarray, ccc: np.ndarray) -> np.ndarray:
    """Canonical order: marks of one run by class, stable."""
    marks = ccc > 0
    if not (marks[1:] & marks[:-1] & (ccc[1:] < ccc[:-1])).any():
        return cp
    run = np.cumsum(~marks)
    return cp[np.lexsort((np.arange(len(cp)), ccc, run))]


def _compose(cp: np.ndarray, row: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    cp = _order(cp, t["ccc"][cp])
    while len(cp) > 1:
        key = (cp[:-1].astype(np.int64) << 21) | cp[1:]
        at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        hit = (t["keys"][at] == key) & (row[1:] == row[:-1])
        made = t["made"][at]
        lv = (cp[:-1] >= 0x1100) & (cp[:-1] < 0x1113) & (cp[1:] >= 0x1161) & (cp[1:] < 0x1176)
        if lv.any():
            a, v = cp[:-1].astype(np.int64) - 0x1100, cp[1:].astype(np.int64) - 0x1161
            made, hit = np.where(lv, 0xAC00 + (a * 21 + v) * 28, made), hit | lv
        s = cp[:-1].astype(np.int64) - 0xAC00
        lvt = (s >= 0) & (s < 11172) & (s % 28 == 0) & (cp[1:] > 0x11A7) & (cp[1:] < 0x11C3)
        if lvt.any():
            made, hit = np.where(lvt, cp[:-1] + (cp[1:].astype(np.int64) - 0x11A7), made), hit | lvt
        if not hit.any():
            break
        k = np.flatnonzero(hit)
        if len(k) > 1:  # of overlapping pairs the first of each run of neighbours composes now
            alone = np.concatenate(([True], np.diff(k) > 1))
            k = k[alone]
        cp[k] = made[k]
        keep = np.ones(len(cp), bool)
        keep[k + 1] = False
        cp, row = cp[keep], row[keep]
    return cp, row


def points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, row of each); nulls are empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(texts) else np.zeros(0, np.uint8)
    head = (raw & 0xC0) != 0x80
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(texts)), np.diff(off))[head]
    return cp, row


def strings(cp: np.ndarray, row: np.ndarray, n: int, valid: np.ndarray | None = None) -> pa.Array:
    raw = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
    off = np.concatenate(([0], np.cumsum(np.bincount(row, size, n).astype(np.int64)))).astype(np.int64)
    mask = None if valid is None else pa.array(valid).buffers()[1]
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(off.tobytes()), pa.py_buffer(raw), mask).cast(pa.string())


def alike_elsewhere(cp: np.ndarray) -> np.ndarray:
    """Which code points are look-alike letters that stand in a script other than Latin."""
    t = _tables()
    return t["alike"][cp] & (t["to"][_LATIN, cp] != cp)


def canonical_points(cp: np.ndarray, row: np.ndarray, n: int, latin: bool = False, more_alike: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    t = _tables(more_alike)
    if not len(cp):
        return cp, row
    length = t["length"][cp]
    if (length == 1).all():
        cp = t["first"][cp]
    else:
        ends = np.cumsum(length, dtype=np.int64)
        out = np.empty(int(ends[-1]), np.uint32)
        one = length == 1
        out[ends[one] - 1] = t["first"][cp[one]]
        many = np.flatnonzero(length > 1)
        if len(many):
            size = length[many].astype(np.int64)
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(ends[many] - size, size) + step] = t["data"][np.repeat(t["start"][cp[many]].astype(np.int64), size) + step]
        cp, row = out, np.repeat(row, length)
    cp = _scripts(cp, row, t, n, latin)
    return _compose(cp.copy(), row, t)


def canonical_array(texts: pa.Array, more_alike: tuple = ()) -> pa.Array:
    """The one form of each text; null stays null. more_alike: further pairs, as of read_confusables."""
    n, valid = len(texts), texts.is_valid().to_numpy(zero_copy_only=False)
    cp, row = points(texts)
    cp, row = canonical_points(cp, row, n, more_alike=more_alike)
    return strings(cp, row, n, valid)


def _slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Pieces of a batch with about `limit` bytes of text at most: code points take four times as much, several times over."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def with_canonical(df: DataFrame, text: str, out: str = "canonical", confusables: str | None = None) -> DataFrame:
    """Adds `out`, the one form of `text`: texts that look the same have equal forms, others stay different.

    Null stays null and empty stays empty; a column named `out` is replaced; every other column and row is kept as it is. confusables: a file of further look-alike
    letters in Unicode's format, read on the driver (some 6,000 entries, bounded by the code points there are).
    """
    if out != text and out in df.columns:
        df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    if out == text:
        schema = df.schema
    more_alike = read_confusables(confusables) if confusables else ()

    def run(batches):
        for b in batches:
            for part in _slices(b, text):
                done = canonical_array(part.column(text), more_alike)
                if out == text:
                    yield part.set_column(part.schema.get_field_index(text), text, done)
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, done], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def look_classes(docs: DataFrame, key: str, text: str, confusables: str | None = None) -> DataFrame:
    """Rows (key, look, string): the class of texts that look the same and the text itself, as 128-bit fingerprints, of each document.

    Texts are read once and never shuffled. Rows with a null key or text are left out; repeated rows count once; an empty table gives no rows.
    """
    d = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__t")).where(F.col(f"`{key}`").isNotNull() & F.col("__t").isNotNull())
    d = with_canonical(d, "__t", "__c", confusables)
    return d.select(key, F.md5(F.encode("__c", "utf-8")).alias("look"), F.md5(F.encode("__t", "utf-8")).alias("string")).distinct()


def look_alikes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (doc_a, doc_b), doc_a < doc_b, whose texts have one canonical form and are not the same string: look_classes expanded to the pairs some results ask for.

    Different texts of a class are paired first, which classes of one text, however often copied, never enter; the pairs of texts are then
    expanded to the documents, so nothing is joined that is not a row of the result.
    """
    d = cut(look_classes(docs, key, text).select(F.col(f"`{key}`").alias("id"), F.col("string").alias("t"), F.col("look").alias("c")))  # fingerprints are read three times, texts once
    texts = d.select("c", "t").distinct()
    pairs = texts.select("c", F.col("t").alias("ta")).join(texts.select("c", F.col("t").alias("tb")), "c").where("ta < tb").select("ta", "tb")
    ids = d.select("id", "t")
    out = pairs.join(ids.select(F.col("t").alias("ta"), F.col("id").alias("a")), "ta").join(ids.select(F.col("t").alias("tb"), F.col("id").alias("b")), "tb")
    return out.where("a <> b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()


def canonical_column(text: Column) -> Column:
    """As a column: a vectorised UDF over Arrow strings."""

    @F.arrow_udf(T.StringType())
    def f(x: pa.Array) -> pa.Array:
        return canonical_array(x)

    return f(text)
