"""Repetition inside one document (problem 2).

Line-first cleaning: every line (a cue) is judged by rules on its marks, on navigation and on boilerplate, failing lines are removed, and documents that
lose too much of their text are rejected. The rule on boilerplate is a count of the line's words that say again what the document said before: a word is
repeated if it lies in a run of RUN words that began earlier too, whether or not the run crosses lines, as captions cut a talk anywhere.

Lines travel once, to the partition of their document, and arrive in order; a batch of whole documents is one array of code points, in which words, runs and
lines are hashed and compared by numpy. Documents of more than MOST_LINES lines are never held by one task: they are cut into buckets of their order, runs are hashed where
their words are, and only hashes and positions are shuffled. Both ways give the same rows.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions.text import let
from cuewright.llm.canonical import _N, points
from cuewright.operators.scan import _join, last_value, running_sum

RUN = 6
#: Cues of one bucket of a long recording.
BUCKET = 64
#: Lines of a document that one task may hold.
MOST_LINES = 100_000
#: Lines of whole documents compared at once.
CHUNK = 20_000

# Words of navigation and share prompts that make a line fail.
NAVIGATION = (
    "subscribe", "share this", "follow us", "click here", "cookie", "sign up", "log in", "read more", "back to top", "all rights reserved", "terms of service", "privacy policy", "leave a comment", "next page",
    "abonnez-vous", "partagez", "cliquez ici", "abonniert", "jetzt abonnieren", "hier klicken", "teilen", "suscríbete", "compartir", "haz clic", "सब्सक्राइब", "登録", "共有", "订阅", "分享", "กดติดตาม",
)
# First and last letters of scripts that put no blanks between words (Thai to Lao, Burmese, Khmer, kana, Han).
SPACELESS = ((0x0E01, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))
_BLANKS = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def words(text: Column, letters: bool = False) -> Column:
    """The words of a text: cut at white space, lower case, without the marks at their ends; words of marks only are none. letters: each letter of a script without blanks is a word."""
    t = F.coalesce(text, F.lit(""))
    if letters:
        t = F.regexp_replace(t, "([" + "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in SPACELESS) + "])", " $1 ")
    edges = r"(?U)(?<=^|\s)[^\p{L}\p{N}\p{M}\s]+|[^\p{L}\p{N}\p{M}\s]+(?=\s|$)"
    return F.filter(F.split(F.lower(F.regexp_replace(t, edges, "")), r"(?U)\s+"), lambda w: w != "")


def _lines(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """One row a line: a repeated row counts once, of rows that share the order but not the text the least text stays."""
    return _raw(lines, key, order, text).groupBy("k", "o").agg(F.min("t").alias("t"))


def _raw(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    return lines.select(F.col(f"`{key}`").alias("k"), F.col(f"`{order}`").cast("long").alias("o"), F.col(f"`{text}`").alias("t")).where("k is not null and o is not null")


@lru_cache(1)
def _signs() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: whether it is a blank, belongs to words, is a word by itself in a script without blanks; its lower case, mixed."""
    blank, inside, alone, low = np.zeros(_N, bool), np.zeros(_N, bool), np.zeros(_N, bool), np.arange(_N, dtype=np.uint64)
    blank[list(_BLANKS)] = True
    for a, z in SPACELESS:
        alone[a : z + 1] = True
    for cp in range(_N):
        if 0x323B0 <= cp < 0xE0100:
            continue
        ch = chr(cp)
        c = unicodedata.category(ch)[0]
        inside[cp] = c in "LNM"
        if c == "L" and len(x := ch.lower()) == 1:
            low[cp] = ord(x)
    return blank, inside, alone, _mix(low)


def _mix(h: np.ndarray) -> np.ndarray:
    """Bits stirred so that sums of such numbers tell what was summed."""
    h = (h + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_ODD = 0xD1342543DE82EF95
_BACK = pow(_ODD, -1, 1 << 64)


def _spans(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of the values in each span, wherever it lies: running sums of the values by powers of an odd number."""
    power = np.cumprod(np.full(len(values) + 1, _ODD, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[:-1])))
    back = np.cumprod(np.full(len(values) + 1, _BACK, np.uint64))
    return _mix((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))


def measured(texts: pa.Array, doc: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, repeated words, lines of the document with the same words) of each line; doc: the document of each, whole documents in order."""
    n = len(texts)
    cp, row = points(texts)
    blank, inside, alone, low = _signs()
    ns = ~blank[cp]
    begins = ns.copy()
    begins[1:] &= ~ns[:-1] | (row[1:] != row[:-1])
    if letters and len(cp):
        single = alone[cp]
        begins |= ns & single
        begins[1:] |= ns[1:] & single[:-1]
    token = np.cumsum(begins)
    at = np.flatnonzero(ns & inside[cp])
    if not len(at):
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    turn = np.flatnonzero(np.diff(token[at]))
    first, last = at[np.concatenate(([0], turn + 1))], at[np.concatenate((turn, [len(at) - 1]))]
    line = row[first]
    count = np.bincount(line, minlength=n)
    of = doc[line].astype(np.uint64)
    h = _spans(low[cp], first, last + 1)
    hit = np.zeros(len(h) + 1, np.int64)
    i = np.arange(len(h) - RUN + 1)
    i = i[of[i] == of[i + RUN - 1]] if len(i) else i
    if len(i):
        runs = _mix(_spans(h, i, i + RUN) ^ _mix(of[i]))
        order = np.argsort(runs, kind="stable")
        again = i[order[1:][runs[order[1:]] == runs[order[:-1]]]]
        hit[again] += 1
        hit[again + RUN] -= 1
    repeated = np.bincount(line, np.cumsum(hit)[:-1] > 0, minlength=n).astype(np.int64)
    stop = np.cumsum(count)
    same = _mix(_spans(h, stop - count, stop) ^ _mix(doc.astype(np.uint64)))
    _, where, times = np.unique(same, return_inverse=True, return_counts=True)
    return count, repeated, np.where(count > 0, times[where], 0)


_NAVIGATION = r"https?://|\b\S+@\S+\.\S+|" + "|".join(re.escape(x) for x in NAVIGATION)


def _by_line(t: Column) -> list[Column]:
    """What can be seen of a line by itself."""
    return [F.lower(F.coalesce(t, F.lit(""))).rlike(_NAVIGATION).alias("navigation"), (~F.coalesce(t, F.lit("")).rlike(r"(?U)[.!?…。！？।]+[\p{Pe}\p{Pf}\"'”’»]*\s*\z")).alias("no_end")]


def _streamed(raw: DataFrame, letters: bool) -> DataFrame:
    """Rows (k, o, words, repeated, times, navigation, no_end) of the lines of documents of MOST_LINES at most: one shuffle, then batches of whole documents."""
    schema = T.StructType([raw.schema["k"], T.StructField("o", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("words", "repeated", "times")], T.StructField("navigation", T.BooleanType()), T.StructField("no_end", T.BooleanType())])

    def done(rows: pa.RecordBatch) -> pa.RecordBatch:
        doc = _doc(rows)
        o = rows.column("o").to_numpy()
        new = np.ones(len(o), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (o[1:] != o[:-1])
        rows, doc = rows.take(pa.array(np.flatnonzero(new))), doc[new]
        out = [pa.array(x, pa.int64()) for x in measured(rows.column("t"), doc, letters)]
        return pa.RecordBatch.from_arrays([rows.column("k"), rows.column("o"), *out, rows.column("navigation"), rows.column("no_end")], names=schema.names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < CHUNK:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            turn = np.flatnonzero(np.diff(_doc(rows)))
            if len(turn):
                yield done(rows.slice(0, int(turn[-1]) + 1))
                rows = rows.slice(int(turn[-1]) + 1)
            held = [rows]
        if sum(map(len, held)):
            yield done(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    d = raw.select("k", "o", "t", *_by_line(F.col("t")))
    return d.repartition("k").sortWithinPartitions("k", "o", "t").mapInArrow(run, schema)


def _doc(rows: pa.RecordBatch) -> np.ndarray:
    """A number of the document of each of sorted rows."""
    return rows.column("k").dictionary_encode().indices.to_numpy().astype(np.int64)


def _buckets(lines: DataFrame, letters: bool) -> DataFrame:
    """(k, b, base, n, w): the words of each bucket of lines, RUN - 1 words of the buckets after it added, how many are its own, and how many words the document has before it."""
    b = lines.withColumn("w", words(F.col("t"), letters)).where(F.size("w") > 0).select("k", "o", "w", F.floor(F.col("o") / BUCKET).alias("b"))
    b = b.groupBy("k", "b").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("o", "w"))), lambda x: x["w"])).alias("w"))
    tops = b.select("k", "b", F.size("w").alias("n"), F.slice("w", 1, RUN - 1).alias("head"))  # one small row a bucket
    order = Window.partitionBy("k").orderBy("b")
    ahead = F.slice(F.flatten(F.collect_list("head").over(order.rowsBetween(1, RUN - 1))), 1, RUN - 1)
    tops = tops.select("k", "b", "n", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), ahead.alias("ahead"))
    return b.join(tops, ["k", "b"]).select("k", "b", "base", "n", F.concat("w", "ahead").alias("w"))


def _repeated_runs(lines: DataFrame, letters: bool) -> DataFrame:
    """Rows (k, pos): where the runs of RUN words begin that began earlier in the document too.

    Runs are hashed to 96 bits. Within a bucket all but the first of equal runs are hits as they stand: they are salted with their position, so of a run that fills a document one row a bucket
    meets in the only shuffle by run.
    """
    last = F.least(F.col("n"), F.size("w") - (RUN - 1))

    def marked(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), last), lambda i: let(F.array_join(F.slice(w, i, RUN), " "), lambda g: F.struct(F.xxhash64(g).alias("h"), F.hash(g).alias("h2"), (F.col("base") + i).alias("pos"))))
        same = lambda s, x, i: (i > 0) & (F.get(s, i - 1)["h"] == x["h"]) & (F.get(s, i - 1)["h2"] == x["h2"])
        return let(F.sort_array(runs), lambda s: F.transform(s, lambda x, i: F.struct(x["h"].alias("h"), x["h2"].alias("h2"), x["pos"].alias("pos"), F.when(same(s, x, i), x["pos"]).otherwise(-1).alias("salt"))))

    r = _buckets(lines, letters).where(last > 0).select("k", F.explode(let(F.col("w"), marked)).alias("r")).select("k", "r.h", "r.h2", "r.pos", "r.salt")
    r = r.withColumn("first", F.min("pos").over(Window.partitionBy("k", "h", "h2", "salt")))
    return r.where("salt >= 0 or pos > first").select("k", "pos")


def _bucketed(lines: DataFrame, letters: bool) -> DataFrame:
    """What _streamed gives, of documents of any length: no task holds one."""
    d = lines.withColumn("w", words(F.col("t"), letters)).withColumn("words", F.size("w").cast("long")).withColumn("h", F.xxhash64(F.array_join("w", " ")))
    times = d.where("words > 0").groupBy("k", "h").agg(F.count(F.lit(1)).alias("times"))
    # Each run covers RUN positions; the line of a position is the last that begins at it or before.
    at = _repeated_runs(lines, letters).select("k", F.explode(F.sequence(F.col("pos"), F.col("pos") + RUN - 1)).alias("pos")).distinct()
    begins = running_sum(d.where("words > 0").select("k", "o", "words", F.floor(F.col("o") / BUCKET).alias("b")), ["k"], "b", ["o"], F.col("words"), "base", before=True)
    begins = begins.select("k", (F.col("base") + 1).alias("pos"), F.col("o"), F.lit(0).alias("kind"))
    both = begins.unionByName(at.select("k", "pos", F.lit(None).cast("long").alias("o"), F.lit(1).alias("kind"))).withColumn("b", F.floor(F.col("pos") / (BUCKET * 64)))
    hit = last_value(both, ["k"], "b", ["pos", "kind"], F.col("o"), "line").where("kind = 1").groupBy("k", F.col("line").alias("o")).agg(F.count(F.lit(1)).alias("repeated"))
    out = _join(_join(d, times, ["k", "h"]), hit, ["k", "o"])
    return out.select("k", "o", "words", F.coalesce("repeated", F.lit(0).cast("long")).alias("repeated"), F.when(F.col("words") > 0, F.col("times")).otherwise(F.lit(0).cast("long")).alias("times"), *_by_line(F.col("t")))


def line_rules(lines: DataFrame, key: str, order: str, text: str, letters: bool = False) -> DataFrame:
    """Rows (key, order, words, repeated, no_words, navigation, boilerplate, no_end, removed): the rules of each line, and whether it is removed.

    no_words: marks only; navigation: an address or a prompt; repeated: its words that lie in a run that began earlier in the document; boilerplate: its words are those of three lines
    of the document or more, or at least half of them are repeated; no_end: no mark ends it (no reason to remove a cue). Rows with a null key or order are left out, a null text has no words,
    repeated rows count once (of rows that share the order the least text stays), an empty table gives no rows, and all other columns are ignored.
    """
    raw = _raw(lines, key, order, text)
    long_ = raw.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_LINES).select("k")
    if long_.isEmpty():
        d = _streamed(raw, letters)
    else:
        d = _streamed(raw.join(long_, "k", "left_anti"), letters).unionByName(_bucketed(raw.join(long_, "k", "left_semi").groupBy("k", "o").agg(F.min("t").alias("t")), letters))
    boilerplate = (F.col("times") > 2) | ((F.col("repeated") > 0) & (F.col("repeated") * 2 >= F.col("words")))
    d = d.select(F.col("k").alias(key), F.col("o").alias(order), "words", "repeated", (F.col("words") == 0).alias("no_words"), "navigation", boilerplate.alias("boilerplate"), "no_end")
    return d.withColumn("removed", F.col("no_words") | F.col("navigation") | F.col("boilerplate"))


def judged(lines: DataFrame, key: str, order: str, text: str, most: float = 0.3, letters: bool = False) -> DataFrame:
    """Rows (key, lines, removed, words, lost, repeated, share, rejected, too_little_left): what the rules of lines leave of each document.

    lost: the words of lines removed; repeated: the words that are repeated, in whatever line; share: repeated of all words, 0 without words. A document is rejected
    if `most` of its words are repeated, and too_little_left says that `most` of them go with the lines removed: lines are removed whole, so the two differ where a run covers parts of lines, and
    where navigation goes.
    """
    r = line_rules(lines, key, order, text, letters)
    d = r.groupBy(key).agg(
        F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("removed"), 1)).alias("removed"), F.sum("words").alias("words"), F.sum(F.when(F.col("removed"), F.col("words")).otherwise(0)).alias("lost"), F.sum("repeated").alias("repeated")
    )
    of = lambda c: F.when(F.col("words") > 0, F.col(c) / F.col("words")).otherwise(F.lit(0.0))
    return d.withColumn("share", of("repeated")).withColumn("rejected", F.col("share") >= most).withColumn("too_little_left", of("lost") >= most)


def repeated_share(lines: DataFrame, key: str, order: str, text: str, letters: bool = False) -> DataFrame:
    """Rows (key, words, repeated, share): the words of each document in the order of its lines, and those that lie in a run that began earlier too."""
    return judged(lines, key, order, text, letters=letters).select(key, "words", "repeated", "share")


def clean_lines(lines: DataFrame, key: str, order: str, text: str, letters: bool = False) -> DataFrame:
    """Rows (key, order, text) of the lines that pass the rules."""
    kept = line_rules(lines, key, order, text, letters).where("not removed").select(F.col(key).alias("k"), F.col(order).alias("o"))
    return _lines(lines, key, order, text).join(kept, ["k", "o"]).select(F.col("k").alias(key), F.col("o").alias(order), F.col("t").alias(text))
