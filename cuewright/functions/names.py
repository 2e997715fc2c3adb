"""Column functions over people's names. Fuzzy comparison and the parser of names are Arrow UDFs, all else stays in the JVM."""

from __future__ import annotations

import difflib
import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions.text import fold, let

# Words no person's name holds, titles, suffixes and particles of names.
NOT_A_NAME = (
    "the this that these those his her their our and but for with from into about after before in on at by of to a an is was he she it they we you i if so as who what when why how new old first "
    "last next one two subscribe watch follow listen support episode part chapter intro outro links sponsor patreon twitter instagram youtube podcast video channel show series university college "
    "institute center centre company corporation foundation society association department"
).split()
TITLES = set("dr mr mrs ms miss mx prof professor sir dame rev fr hon lord lady judge president senator".split())
SUFFIXES = set("phd md jr sr ii iii iv esq dphil msc ba ma mba dds rn cpa".split())
PARTICLES = set("van von de der den del della di da dos du la le ter ten bin ibn al el st".split())
CREDIT = r"(?i)(?:\bft\.?|\bfeat\.?|\bwith\b|\bw/|[—–|]|\s-\s)\s*(.+)$"
NAME_RUN = r"(?U)\b[A-Z][\w'’-]*(?:[ \t]+[A-Z][\w'’-]*){1,3}\b"
SLIP_SAFE = 5
SLIP_RATIO = 85


def tidy_name(c: Column) -> Column:
    """A name without what a sentence leaves on it: possessives, marks and brackets around it, runs of blanks."""
    s = F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)[’']s\b", "")
    s = F.regexp_replace(s, r"""^[ ,.;:!?"'()\[\]]+|[ ,.;:!?"'()\[\]]+$""", "")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def is_full_name(c: Column) -> Column:
    return F.size(F.filter(F.split(fold(tidy_name(c)), " "), lambda w: w != "")) >= 2


def title_credits(c: Column) -> Column:
    """What of a title credits people: all after the first credit marker."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), CREDIT, 1), r"^[ )]+|[ )]+$", "")


def names_in(c: Column) -> Column:
    """Runs of two to four capitalised words, in order, each fold once; runs holding a word no name has, or of fewer than 5 folded characters, are left out. array<struct<key,name>>"""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({NAME_RUN})"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in NOT_A_NAME])
    kept = F.filter(runs, lambda r: ~F.arrays_overlap(F.transform(F.split(r, r"[ \t]+"), lambda w: fold(w)), stop) & (F.length(fold(r)) >= 5))
    pairs = F.transform(kept, lambda r: F.struct(fold(r).alias("key"), F.regexp_replace(r, r"^[.,;:]+|[.,;:]+$", "").alias("name")))
    return let(pairs, lambda x: F.filter(x, lambda p, i: F.array_position(x["key"], p["key"]) == i + 1))


def _ratio(a: str, b: str) -> float:
    """200 * longest common subsequence / lengths."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def close_names(a: str | None, b: str | None) -> bool:
    """As many words, each equal, or both of five letters or more and one slip apart."""
    x, y = (a or "").split(), (b or "").split()
    if not x or len(x) != len(y):
        return False
    return all(p == q or (min(len(p), len(q)) >= SLIP_SAFE and _ratio(p, q) >= SLIP_RATIO) for p, q in zip(x, y))


def name_parts(name: str | None) -> tuple[str, str]:
    """(given, family) of a name, folded: titles before and credentials after it left out, particles kept with the family, 'Family, Given' put straight; '' for what is missing."""
    import unicodedata

    def plain(s: str) -> str:
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]", "", s.lower())).strip()

    pieces = [p.strip() for p in (name or "").split(",") if p.strip()]
    pieces = [p for i, p in enumerate(pieces) if i == 0 or not all(plain(w).replace(" ", "") in SUFFIXES for w in p.split())]
    words = (pieces[1].split() + pieces[0].split()) if len(pieces) > 1 else (pieces[0].split() if pieces else [])
    words = [w for w in map(plain, words) if w]
    while len(words) > 1 and words[0] in TITLES:
        words = words[1:]
    while len(words) > 1 and words[-1] in SUFFIXES:
        words = words[:-1]
    if len(words) < 2:
        return (words[0], "") if words else ("", "")
    k = len(words) - 1
    while k > 1 and words[k - 1] in PARTICLES:
        k -= 1
    return words[0], " ".join(words[k:])


@F.pandas_udf(T.BooleanType())
def close(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([close_names(x, y) for x, y in zip(a, b)], dtype="bool")


@F.pandas_udf(T.StructType([T.StructField("first", T.StringType()), T.StructField("last", T.StringType())]))
def parts(a: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([name_parts(x) for x in a], columns=["first", "last"])


@F.pandas_udf(T.StringType())
def unescape(a: pd.Series) -> pd.Series:
    """Entities of HTML resolved, white space at the ends gone."""
    return a.map(lambda t: None if t is None else html.unescape(t.strip()))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two titles."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def surname(key: Column) -> Column:
    """The family name of a folded key: its last word."""
    return F.coalesce(F.element_at(F.filter(F.split(key, " "), lambda w: w != ""), -1), F.lit(""))
