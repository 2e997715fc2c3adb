"""Lines that one source repeats in many documents (problem 6).

A graph of consecutive lines: a node is a line's letters within one source, weighted by the documents that have it; an edge joins lines
that follow one another, weighted alike. Nodes and edges of high support stay, connected components of them are the boilerplate
blocks, and every occurrence of a block's lines is deleted.

A line of enough letters is a node by its own support, and one that no edge joins is a block by itself. A shorter line says too little to be judged alone: only edges make it
part of a block, and only where it stands beside a line it is joined to is it deleted; elsewhere the same words stay. Edges between two short lines are none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.operators.scan import _join
from cuewright.session import cut

MIN_LETTERS = 20
#: A source's size is given to so many rows, that no task gets all lines of a hot one.
SALT = 16


def letters(line: Column) -> Column:
    """What of a line counts: its letters, without case, digits, marks and white space."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), "ß", "ss"), r"[^\p{L}]+", "")


def _cut_lines(text: Column) -> Column:
    """The non-empty lines of a text."""
    return F.filter(F.split(text, r"\r\n|[\n\r\x{85}\x{2028}\x{2029}]"), lambda x: x.rlike(r"[^\s\x{A0}\x{3000}\x{FEFF}\x{200B}]"))


def lines_of(paragraphs: DataFrame) -> DataFrame:
    """(video_id, n, line_no, line): the non-empty lines, counted from 1. A repeated row counts once; of rows that share a key but not a text the least text stays."""
    p = paragraphs.select("video_id", "n", "text").where("video_id is not null and text is not null").groupBy("video_id", "n").agg(F.min("text").alias("text"))
    return p.select("video_id", "n", F.posexplode(_cut_lines(F.col("text"))).alias("k", "line")).select("video_id", "n", (F.col("k") + 1).alias("line_no"), "line")


def _sources(recordings: DataFrame) -> DataFrame:
    return recordings.where("channel is not null and video_id is not null").groupBy("video_id").agg(F.min("channel").alias("channel"))


def _supported(pairs: DataFrame, keys: list[str], sizes: DataFrame, share: float, least: int) -> DataFrame:
    """(channel, *keys) in enough documents. Counted in two steps, (channel, keys, document) first, so a hot source is spread over its lines."""
    n = pairs.select("channel", *keys, "video_id").distinct().groupBy("channel", *keys).agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least)
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    n = n.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALT)).cast("int")).join(salted, ["channel", "salt"])
    return n.where(F.col("docs") >= F.col("total") * share).select("channel", *keys, "docs")


def _keyed(paragraphs: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((video_id, n, line_no, channel, key, id, counts), recordings of each channel): the lines with a letter, id a fingerprint of the key that is shuffled in its place, counts: it has letters enough."""
    src = _sources(recordings)
    lines = lines_of(paragraphs).withColumn("key", letters("line")).where("key <> ''").join(src, "video_id")
    lines = lines.select("video_id", "n", "line_no", "channel", F.md5("key").alias("id"), (F.length("key") >= MIN_LETTERS).alias("counts"), "key")
    return cut(lines), src.groupBy("channel").agg(F.count(F.lit(1)).alias("total"))


def repeated_lines(paragraphs: DataFrame, recordings: DataFrame, share: float = 0.1, least: int = 3) -> DataFrame:
    """Rows (video_id, n, line_no, channel, key, block, joined): each place of a line of a boilerplate block, whose lines are found in at least `share` of their channel's recordings and in at least `least`.

    joined: a short line, here only because it stands beside one of its block. The share is of all video_ids the channel has in recordings. Null channels are left out;
    recordings delivered twice count once; empty tables give no rows.
    """
    lines, sizes = _keyed(paragraphs, recordings)
    nodes, edges = _blocks(lines, sizes, share, least)
    own = lines.where("counts").join(nodes.select("channel", "id", "block"), ["channel", "id"]).select("video_id", "n", "line_no", "channel", "key", "block", F.lit(False).alias("joined"))
    beside = _followed(lines).join(edges, ["channel", "id", "next"])
    beside = beside.select("video_id", "n", "channel", "block", F.explode(F.array("line_no", F.col("line_no") + 1)).alias("line_no")).distinct()
    short = lines.where(~F.col("counts")).join(beside, ["video_id", "n", "channel", "line_no"]).select("video_id", "n", "line_no", "channel", "key", "block", F.lit(True).alias("joined"))
    return own.unionByName(short)


def blocks(paragraphs: DataFrame, recordings: DataFrame, share: float = 0.1, least: int = 3) -> DataFrame:
    """Rows (channel, key, docs, block): the repeated lines that count by themselves and the block, a connected component of the graph, each belongs to; block is the least fingerprint in it.

    A channel has at most (lines of a document / share) supported lines, whatever its size, since each of them takes a share of the documents: so one group
    of the component search is bounded.
    """
    lines, sizes = _keyed(paragraphs, recordings)
    nodes = _blocks(lines, sizes, share, least)[0]
    keys = lines.where("counts").select("channel", "id", "key").join(nodes, ["channel", "id"]).distinct()
    return keys.select("channel", "key", "docs", "block")


def _followed(lines: DataFrame) -> DataFrame:
    """(video_id, n, line_no, channel, id, next): lines and the fingerprint of the line after them in their paragraph, of which one counts at least."""
    one = lines.where("line_no > 1").select("video_id", "n", "channel", (F.col("line_no") - 1).alias("line_no"), F.col("id").alias("next"), F.col("counts").alias("too"))
    both = lines.select("video_id", "n", "channel", "line_no", "id", "counts").join(one, ["video_id", "n", "channel", "line_no"])
    return both.where("counts or too").drop("counts", "too")


def _blocks(lines: DataFrame, sizes: DataFrame, share: float, least: int) -> tuple[DataFrame, DataFrame]:
    """((channel, id, docs, block) of the lines that count, (channel, id, next, block) of the edges of their blocks)."""
    nodes = cut(_supported(lines.where("counts"), ["id"], sizes, share, least))
    edges = cut(_supported(_followed(lines), ["id", "next"], sizes, share, least).drop("docs"))
    counted = nodes.select("channel", "id", F.lit(None).cast("string").alias("next"))

    def components(pdf: pd.DataFrame) -> pd.DataFrame:
        up: dict[str, str] = {}

        def root(x: str) -> str:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        own, joins = set(pdf[pdf.next.isna()].id), pdf[~pdf.next.isna()]
        for a, b in joins[["id", "next"]].itertuples(index=False):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        out = [(x, None, root(x)) for x in sorted(own)] + [(a, b, root(a)) for a, b in joins[["id", "next"]].itertuples(index=False)]
        return pd.DataFrame({"channel": pdf.channel.iloc[0], "id": [x[0] for x in out], "next": [x[1] for x in out], "block": [x[2] for x in out]})

    linked = edges.select("channel").distinct()
    found = cut(counted.join(linked, "channel", "left_semi").unionByName(edges).groupBy("channel").applyInPandas(components, "channel string, id string, next string, block string"))
    of = found.where("next is null").select("channel", "id", "block")
    return nodes.join(of, ["channel", "id"], "left").withColumn("block", F.coalesce("block", "id")), found.where("next is not null")


def without_repeated_lines(paragraphs: DataFrame, recordings: DataFrame, share: float = 0.1, least: int = 3) -> DataFrame:
    """Rows (video_id, n, text, removed): every paragraph without the lines of boilerplate blocks, and how many lines went.

    A paragraph that loses none keeps its text as it was; null texts stay null; of rows that share a key the least text stays.
    """
    bad = cut(repeated_lines(paragraphs, recordings, share, least).select("video_id", "n", "line_no"))
    touched = bad.groupBy("video_id", "n").agg(F.collect_set("line_no").alias("bad"))
    base = paragraphs.select("video_id", "n", "text").groupBy("video_id", "n").agg(F.min("text").alias("text"))
    out = _join(base, touched, ["video_id", "n"])
    kept = F.filter(_cut_lines(F.col("text")), lambda x, i: ~F.array_contains("bad", i + 1))
    return out.select("video_id", "n", F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("bad"), F.lit(0)).alias("removed"))
