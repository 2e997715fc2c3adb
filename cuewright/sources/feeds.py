"""Podcast feeds: episodes, references to them, and the episode a hint means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions import names as N
from cuewright.functions import text as T

ITEM = (
    "title string, link string, pubDate string, description string, `itunes:duration` string, guid struct<_VALUE:string,_isPermaLink:string>, enclosure struct<_url:string,_type:string,_length:string>, "
    "`podcast:transcript` array<struct<_url:string,_type:string>>"
)
FEED = f"channel struct<title:string,link:string,item:array<struct<{ITEM.replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array')}>>>"
# What a target looks like.
STOREFRONT = r"(?i)(?:music|open|podcasters)\.(?:amazon|spotify)\.|podcasts\.google\.|pca\.st|overcast\.fm|castbox\.fm|iheart\.com"
APPLE = r"(?i)podcasts\.apple\.com/.*?/id(\d+)"
FEED_SHAPE = r"(?i)\.(?:xml|rss)(?:$|\?)|/(?:feed|rss)(?:/|$|\?)|^feeds?\."


def episodes(feeds: DataFrame) -> DataFrame:
    """(feed, show, pos, id, title, audio, page, published, description, duration_s, transcript_url) of feeds (feed, body). A body that is no feed gives none."""
    x = feeds.select("feed", F.from_xml("body", FEED, {"rowTag": "rss", "mode": "PERMISSIVE"})["channel"].alias("c"))
    d = x.select("feed", N.unescape("c.title").alias("show"), F.posexplode("c.item").alias("pos", "i"))
    text = lambda c: F.coalesce(N.unescape(c), F.lit(""))
    audio = F.coalesce("i.enclosure._url", F.lit(""))
    guid = F.coalesce(F.nullif(text(F.col("i.guid._VALUE")), F.lit("")), F.nullif(audio, F.lit("")), text(F.col("i.title")))
    urls = F.filter(F.transform(F.col("i.podcast:transcript"), lambda t: t["_url"]), lambda u: F.coalesce(u, F.lit("")) != "")
    return d.select(
        "feed", "show", "pos", T.short_sha1(guid).alias("id"), text(F.col("i.title")).alias("title"), audio.alias("audio"), text(F.col("i.link")).alias("page"), T.rfc822_date(F.col("i.pubDate")).alias("published"),
        F.trim(T.strip_markup(text(F.col("i.description")))).alias("description"), T.duration_seconds(F.col("i.itunes:duration")).alias("duration_s"), F.coalesce(F.get(urls, F.lit(0)), F.lit("")).alias("transcript_url"),
    )


def playable(episodes_: DataFrame) -> DataFrame:
    return episodes_.where("audio <> '' or transcript_url <> ''")


def reference(feed: Column, episode: Column) -> Column:
    return F.concat(F.lit("podcast:"), feed, F.lit("#"), episode)


def parse_reference(c: Column) -> Column:
    """struct<feed,episode> of a reference; any other target is a feed without episode."""
    is_ref = c.startswith("podcast:")
    body = F.regexp_replace(c, r"\Apodcast:", "")
    episode = F.nullif(F.when(is_ref & F.contains(body, F.lit("#")), F.regexp_extract(body, r"(?s)#(.*)\z", 1)), F.lit(""))
    return F.struct(F.when(is_ref, F.substring_index(body, "#", 1)).otherwise(c).alias("feed"), episode.alias("episode"))


def _path(c: Column) -> Column:
    """The path of a url, without host, parameters, query and fragment."""
    return F.regexp_extract(c, r"(?i)^https?://[^/?#;]*([^?#;]*)", 1)


def is_podcast(c: Column) -> Column:
    """A reference, a name, a storefront, or a url whose path looks like a feed's (the whole url where it has no path); a host called feeds is no sign."""
    url = c.rlike(r"(?i)^https?://")
    return F.when((c == "") | c.startswith("-"), False).otherwise(c.startswith("podcast:") | ~url | c.rlike(STOREFRONT) | c.rlike(APPLE) | F.coalesce(F.nullif(_path(c), F.lit("")), c).rlike(FEED_SHAPE))


def route(c: Column) -> Column:
    """How a target becomes a feed: 'reference', 'feed', 'apple', 'storefront' (which has none), or 'search'."""
    feedish = c.rlike(r"(?i)^https?://") & _path(c).rlike(FEED_SHAPE)
    return F.when(c.startswith("podcast:"), "reference").when(feedish, "feed").when(c.rlike(APPLE), "apple").when(c.rlike(STOREFRONT), "storefront").otherwise("search")


#: Characters by which a target meets the shows that may contain it.
GRAM = 6


def resolve(targets: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(target, feed, how) of targets against a catalogue (show, feed, apple_id, rank): references and feeds as they stand, Apple ids by lookup, names by the first show in rank that contains them, also inside a word; feed is null where there is none. Candidates meet on the first GRAM characters of the target."""
    t = targets.withColumn("how", route(F.col("target")))
    c = catalogue.where("feed <> ''")
    own = t.where("how in ('reference', 'feed', 'storefront')").select("target", F.when(F.col("how") != "storefront", parse_reference(F.col("target"))["feed"]).alias("feed"), "how")
    apple = t.where("how = 'apple'").withColumn("id", F.regexp_extract("target", APPLE, 1)).join(c.groupBy(F.col("apple_id").cast("string").alias("id")).agg(F.min_by("feed", "rank").alias("feed")), "id", "left").select("target", "feed", "how")
    named = t.where("how = 'search'").select("target", "how").distinct()
    low = c.where("show <> ''").select("feed", "rank", F.lower("show").alias("show"))
    # All runs of GRAM characters, and of fewer for targets that are shorter.
    starts = F.sequence(F.lit(1), F.length("show"))
    runs = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda k: F.substring(F.col("show"), i, k)))))
    grams = low.select("feed", "rank", "show", F.explode(runs).alias("w"))
    hit = named.where(F.trim("target") != "").withColumn("w", F.substring(F.lower("target"), 1, GRAM)).join(grams, "w").where(F.contains("show", F.lower("target")))
    first = hit.groupBy("target").agg(F.min_by("feed", "rank").alias("feed"))
    return own.unionByName(apple).unionByName(named.join(first, "target", "left").select("target", "feed", "how"))


def search(catalogue: DataFrame, term: str, limit: int = 5) -> DataFrame:
    """The shows whose name holds the term, in rank, 25 at most: a top-k report."""
    return catalogue.where((F.coalesce("feed", F.lit("")) != "") & F.contains(F.lower("show"), F.lit(term.lower()))).orderBy("rank").limit(max(1, min(limit, 25)))


def pick_episode(episodes_: DataFrame, hint: str | None = None, least: float = 0.35) -> DataFrame:
    """The episode a hint means in each feed: without one the first in feed order; the only title holding it; else the most similar title among those, or of all if similar enough."""
    if not hint:
        return episodes_.join(episodes_.groupBy("feed").agg(F.min("pos").alias("pos")), ["feed", "pos"])
    low = hint.lower()
    d = episodes_.withColumn("__in", F.contains(F.lower("title"), F.lit(low)).cast("int")).withColumn("__s", N.similarity(F.lit(low), F.lower("title")))
    w = Window.partitionBy("feed").orderBy(F.desc("__in"), F.desc("__s"), "pos")
    return d.withColumn("__r", F.row_number().over(w)).where((F.col("__r") == 1) & ((F.col("__in") == 1) | (F.col("__s") >= least))).drop("__in", "__s", "__r")


def expand(entries: DataFrame) -> DataFrame:
    """Video urls of playlist entries (playlist, pos, url, webpage_url, id): the url, the page, or the watch page of the id; entries without any are left out."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    url = F.coalesce(filled("url"), filled("webpage_url"), F.concat(F.lit(T.WATCH), filled("id")))
    return entries.select("playlist", "pos", url.alias("url")).where("url is not null")


def references(episodes_: DataFrame) -> DataFrame:
    """(feed, pos, reference) of the playable episodes of each feed: a whole feed, asked for."""
    return playable(episodes_).select("feed", "pos", reference(F.col("feed"), F.col("id")).alias("reference"))
