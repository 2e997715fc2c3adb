"""Oversized items cut at natural boundaries (problem 4): a hierarchy of separators, packed greedily, with an overlap."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm import sentences as S

_SPACE = re.compile(r"\s+")
#: What a piece may end at, the best first.
LEVELS = ("section", "line", "sentence")


def _ends(text: str, w: np.ndarray) -> list[np.ndarray]:
    """Sentence ends by what follows them: a blank line (end of a section), a line break, anything."""
    every = np.array(S.ends(text, w), np.int64)
    breaks = np.array([(gap := _SPACE.match(text, e)) and gap.group().count("\n") or 0 for e in every], np.int64)
    return [every[breaks > 1], every[breaks > 0], every]


def pieces(text: str, limit: int, overlap: int, w: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, boundary at the end) of the pieces of a text: each within the limit, each but the first beginning `overlap` before the last one's end.

    A piece ends where the last section ends that fits; where none does, the last line, else the last sentence, else at the last white space, else at the limit. So whole sections are packed
    as far as they fit, and only one that is too large is cut by what is below it.
    """
    if len(text) <= limit:
        return [(0, len(text), "end")]
    levels = _ends(text, w)
    spaces = np.array([m.start() for m in _SPACE.finditer(text)], np.int64)
    out, start, done = [], 0, 0
    while len(text) - start > limit:
        most = start + limit
        cut, kind = most, "none"
        for name, at in zip(LEVELS, levels):
            k = np.searchsorted(at, most, side="right") - 1
            if k >= 0 and at[k] > done:
                cut, kind = int(at[k]), name
                break
        else:
            j = np.searchsorted(spaces, most - 1, side="right") - 1
            if j >= 0 and spaces[j] >= done:
                # White space before the first word is no place to cut, but the piece has some.
                cut, kind = int(spaces[j]) if text[done : spaces[j]].strip() else most, "space"
        out.append((start, cut, kind))
        done, start = cut, max(cut - overlap, 0)
    out.append((start, len(text), "end"))
    return out


def split(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int, w: np.ndarray) -> DataFrame:
    """Rows (*keys, piece, start_pos, end_pos, boundary, size, part) of the items larger than the limit, in characters; w: the weights of sentences.model.

    boundary is what the piece is cut at: 'section', 'line', 'sentence', 'space', 'none', or 'end' for the last. Null texts and items within the limit
    give no rows; repeated rows count once; of rows that share the keys but not the text the least text stays; further columns are ignored.
    """
    if overlap >= limit:
        raise ValueError("the overlap must be smaller than the limit")
    d = df.select(*keys, F.col(f"`{text}`").alias("__t")).where(F.length("__t") > limit).groupBy(*keys).agg(F.min("__t").alias("__t"))
    more = [("piece", T.IntegerType()), ("start_pos", T.IntegerType()), ("end_pos", T.IntegerType()), ("boundary", T.StringType()), ("size", T.IntegerType()), ("part", T.StringType())]
    schema = T.StructType([*d.select(*keys).schema.fields, *[T.StructField(n, t) for n, t in more]])
    b = df.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                p = pdf.iloc[lo : lo + 256]
                found = [pieces(t, limit, overlap, b.value) for t in p["__t"]]
                at = np.repeat(np.arange(len(p)), [len(f) for f in found])
                out = p[keys].iloc[at].reset_index(drop=True)
                flat = [(i, a, z, kind, len(t), t[a:z]) for t, f in zip(p["__t"], found) for i, (a, z, kind) in enumerate(f, 1)]
                more_ = pd.DataFrame(flat, columns=["piece", "start_pos", "end_pos", "boundary", "size", "part"])
                yield pd.concat([out, more_], axis=1).astype({"piece": "int32", "start_pos": "int32", "end_pos": "int32", "size": "int32"})

    return d.mapInPandas(run, schema)
