"""A graph of people whose edges cite the recording: checks of the evidence, and one graph of many recordings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cuewright.functions import names as N
from cuewright.functions import text as T
from cuewright.functions.text import fold
from cuewright.operators.scan import _join

# The kinds of edges, how each reads from its two ends, what must be quoted.
KINDS = {
    "interviewed": ("interviewed", "was interviewed by"),
    "worked_with": ("worked with", "worked with"),
    "cites": ("cites", "is cited by"),
    "co_appeared": ("appeared alongside", "appeared alongside"),
    "discussed": ("talked about", "was talked about by"),
    "opposed": ("publicly disagreed with", "was publicly disagreed with by"),
}
LEAST_WORDS = 4


def spoken(text: Column) -> Column:
    """The words of a text with one blank around each, as quotes are looked up in."""
    return F.concat(F.lit(" "), F.array_join(T.ascii_words(text), " "), F.lit(" "))


def quoted_in(evidence: Column, words: Column) -> Column:
    """The words of the evidence, four at least, stand in a row in a text's words, as spoken gives them."""
    needle = T.ascii_words(evidence)
    return (F.size(needle) >= LEAST_WORDS) & F.contains(words, F.concat(F.lit(" "), F.array_join(needle, " "), F.lit(" ")))


def quote_is_real(evidence: Column, text: Column) -> Column:
    return quoted_in(evidence, spoken(text))


def quote_names(evidence: Column, *people: Column) -> Column:
    """The evidence holds a word of more than two characters of one of the people."""
    words = T.ascii_words(evidence)
    out = F.lit(False)
    for p in people:
        out = out | F.arrays_overlap(F.filter(T.ascii_words(N.tidy_name(p)), lambda w: F.length(w) > 2), words)
    return out


@F.pandas_udf(BooleanType())
def _nearly_named(evidence: pd.Series, people: pd.Series) -> pd.Series:
    """A word of more than three characters of the people, one slip apart."""
    out = []
    for e, p in zip(evidence, people):
        words = set(re.findall("[a-z0-9]+", (e or "").lower()))
        out.append(any(N.close_names(a, w) for a in re.findall("[a-z0-9]+", (p or "").lower()) if len(a) > 3 for w in words))
    return pd.Series(out, dtype="bool")


def supported(edges: DataFrame) -> DataFrame:
    """Adds supported: the evidence names an end, or nearly does; the fuzzy check runs only where the exact one fails."""
    d = edges.withColumn("__q", quote_names(F.col("evidence"), F.col("from_name"), F.col("to_name")))
    pair = F.when(~F.col("__q"), F.concat_ws(" ", N.tidy_name(F.col("from_name")), N.tidy_name(F.col("to_name"))))
    return d.withColumn("supported", F.col("__q") | _nearly_named(F.when(~F.col("__q"), F.col("evidence")), pair)).drop("__q")


def judge_edges(edges: DataFrame, texts: DataFrame, recordings: DataFrame, resolved: DataFrame) -> DataFrame:
    """Adds verdict to edges (video_id, pos, from_name, to_name, kind, evidence), and source, target: 'malformed', 'rejected' (the quote is not in the recording), 'irrelevant' (it names neither end), 'self', 'channel' or 'kept'; in that order.

    texts: (video_id, text). resolved: (video_id, claimed, name) of tidied names, as canonicalise gives it.
    """
    channel = recordings.select("video_id", F.trim("channel").alias("channel")).groupBy("video_id").agg(F.min("channel").alias("channel"))
    words = texts.join(edges.select("video_id").distinct(), "video_id", "left_semi").select("video_id", spoken(F.col("text")).alias("__said"))  # once a recording that has edges
    d = supported(_join(_join(edges, words, ["video_id"]), channel, ["video_id"]))
    for end, out in (("from_name", "source"), ("to_name", "target")):
        d = d.withColumn("claimed", N.tidy_name(F.col(end)))
        d = _join(d, resolved.select("video_id", "claimed", F.col("name").alias(out)), ["video_id", "claimed"]).withColumn(out, F.coalesce(out, "claimed")).drop("claimed")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    well = F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)) & filled("from_name") & filled("to_name")
    host = F.when(filled("channel"), fold(F.col("channel")))
    of_channel = F.coalesce((fold(F.col("source")) == host) | (fold(F.col("target")) == host), F.lit(False))
    verdict = (
        F.when(~well, "malformed").when(~F.coalesce(quoted_in(F.col("evidence"), F.col("__said")), F.lit(False)), "rejected").when(~F.coalesce("supported", F.lit(False)), "irrelevant")
        .when(fold(F.col("source")) == fold(F.col("target")), "self").when(of_channel, "channel").otherwise("kept")
    )
    return d.withColumn("verdict", verdict).drop("__said", "supported", "channel")


def with_urls(edges: DataFrame, paragraphs: DataFrame, recordings: DataFrame) -> DataFrame:
    """Adds url: that of the first paragraph with the edge's timestamp, else the recording's, else ''."""
    first = paragraphs.where("timestamp is not null").groupBy("video_id", "timestamp").agg(F.min_by("url", "n").alias("__u"))
    doc = recordings.groupBy("video_id").agg(F.min("url").alias("__d"))
    return _join(_join(edges, first, ["video_id", "timestamp"]), doc, ["video_id"]).withColumn("url", F.coalesce("__u", "__d", F.lit(""))).drop("__u", "__d")


def nodes_of(people: DataFrame, recordings: DataFrame, resolved: DataFrame) -> DataFrame:
    """(video_id, pos, name, role, is_local) of people as a recording's extraction gives them: canonical names, without the channel and empty ones."""
    channel = recordings.select("video_id", F.trim("channel").alias("channel")).groupBy("video_id").agg(F.min("channel").alias("channel"))
    d = people.where(F.coalesce("name", F.lit("")) != "").withColumn("claimed", N.tidy_name(F.col("name"))).drop("name")
    d = _join(_join(d, resolved.select("video_id", "claimed", "name"), ["video_id", "claimed"]), channel, ["video_id"])
    d = d.withColumn("name", F.coalesce("name", "claimed")).where("name <> ''")
    d = d.where(~F.coalesce((F.col("channel") != "") & (fold(F.col("name")) == fold(F.col("channel"))), F.lit(False)))
    return d.select("video_id", "pos", "name", F.trim(F.coalesce("role", F.lit(""))).alias("role"), (~N.is_full_name(F.col("name"))).alias("is_local"))


def node_key(name: Column, local: Column, video_id: Column) -> Column:
    """A person's key: the fold, within one recording for a bare given name."""
    return F.when(local, F.concat_ws("@", fold(name), video_id)).otherwise(fold(name))


def merge_people(people: DataFrame) -> DataFrame:
    """(key, name, roles, videos, appears_in, local) of people (video_id, pos, name, role, is_local): one node a key.

    name: the longest spelling, the first on a tie; roles: distinct ones by first mention; videos: distinct recordings. Mentions are first reduced to one per
    (key, recording), (key, role) and (key, name), so a very frequent key meets one task only with what its node holds.
    """
    p = people.where("name is not null").withColumn("key", node_key(F.col("name"), F.coalesce("is_local", F.lit(False)), F.col("video_id"))).where("key <> ''")
    at = F.struct("video_id", "pos")
    spell = p.groupBy("key", "name").agg(F.min(at).alias("at"), F.max(F.coalesce("is_local", F.lit(False))).alias("local"))
    head = spell.groupBy("key").agg(F.max(F.length("name")).alias("l"), F.max("local").alias("local"))
    name = spell.drop("local").join(head, "key").where(F.length("name") == F.col("l")).groupBy("key").agg(F.min_by("name", "at").alias("name"), F.first("local").alias("local"))
    role = p.where("role <> ''").groupBy("key", "role").agg(F.min(at).alias("at"))
    role = role.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "role"))), lambda x: x["role"]).alias("roles"))
    seen = p.groupBy("key", "video_id").agg(F.min("pos").alias("pos"))
    seen = seen.groupBy("key").agg(F.count(F.lit(1)).alias("videos"), F.sort_array(F.collect_list("video_id")).alias("appears_in"))
    out = name.join(seen, "key").join(role, "key", "left")
    return out.select("key", "name", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"), "videos", "appears_in", "local")


def tier(local: Column, videos: Column) -> Column:
    return F.when(local, "person/local").when(videos >= 2, "person/recurring").otherwise("person/named")


#: What a recording's extraction gives, as a line of a log holds it.
RESULT = (
    "video_id string, video string, failed string, rejected bigint, irrelevant bigint, people array<struct<name:string,role:string,local:boolean>>, "
    "edges array<struct<edge_id:bigint,from_name:string,to_name:string,kind:string,evidence:string,timestamp:string,confidence:string>>"
)


def merge_results(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(people, edges, failed, totals) of the results of many recordings, one row each as RESULT says: one graph.

    people: as merge_people; edges: all of them, (video_id, pos, *edge), pos from 1; failed: (video_id, video, why) of recordings that gave no result, so that a graph that lacks them says so; totals: one row (rejected, irrelevant, failed).
    """
    p = results.select("video_id", F.posexplode("people").alias("pos", "p")).select("video_id", (F.col("pos") + 1).alias("pos"), "p.name", "p.role", F.col("p.local").alias("is_local"))
    e = results.select("video_id", F.posexplode("edges").alias("pos", "e")).select("video_id", (F.col("pos") + 1).alias("pos"), "e.*")
    f = results.where("failed <> ''").select("video_id", "video", F.col("failed").alias("why"))
    return merge_people(p), e, f, totals(results)


def totals(results: DataFrame) -> DataFrame:
    """(rejected, irrelevant, failed) over results; a missing count is 0."""
    s = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long")
    return results.agg(s(F.col("rejected")).alias("rejected"), s(F.col("irrelevant")).alias("irrelevant"), F.count(F.nullif("failed", F.lit(""))).alias("failed"))


def ends_of(edges: DataFrame) -> DataFrame:
    """Every edge once for each of its ends: (key of the end, outgoing, *edge). A join of either end is then an equi-join."""
    out = edges.withColumn("end", fold(F.col("from_name"))).withColumn("outgoing", F.lit(True))
    back = edges.withColumn("end", fold(F.col("to_name"))).withColumn("outgoing", F.lit(False)).where(fold(F.col("from_name")) != fold(F.col("to_name")))
    return out.unionByName(back)
