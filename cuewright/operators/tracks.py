"""The caption track to take of each recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bare_language(c: Column) -> Column:
    return F.lower(F.substring_index(F.coalesce(c, F.lit("")), "-", 1))


def is_translated(native: Column, key: Column) -> Column:
    """A track in another language than the recording's own, where that is known."""
    n = bare_language(native)
    return (n != "") & (bare_language(key) != n)


def pick_tracks(tracks: DataFrame, recordings: DataFrame, want: str | None = None) -> DataFrame:
    """(video_id, source, key, translated) of tracks (video_id, source, key, pos) and recordings (video_id, language); none for a recording without a fitting one.

    want: a key to take, manual before auto; 'auto' for the spoken language only. Otherwise manual English, manual and auto in the spoken language, auto English; among keys of a language the bare
    one, then -orig, -US, -GB, then the first listed.
    """
    d = tracks.join(recordings.select("video_id", bare_language(F.col("language")).alias("native")), "video_id")
    prefix, manual = bare_language(F.col("key")), F.col("source") == "manual"
    if want and want != "auto":
        rank = F.when(F.col("key") == want, F.when(manual, 0).otherwise(1))
        within = F.lit(0)
    else:
        english = (prefix == "en") if want != "auto" else F.lit(False)
        spoken = (F.col("native") != "") & (prefix == F.col("native"))
        rank = F.when(manual & english, 0).when(manual & spoken, 1).when(~manual & spoken, 2).when(~manual & english, 3)
        rest = F.substring(F.col("key"), F.length(prefix) + 1, F.length("key"))
        within = F.coalesce(F.when(F.col("key") == prefix, 0), F.when(rest == "-orig", 1), F.when(rest == "-US", 2), F.when(rest == "-GB", 3), F.lit(4))
    d = d.withColumn("r", rank).where("r is not null").withColumn("w", within)
    best = d.groupBy("video_id").agg(F.min(F.struct("r", "w", "pos", "source", "key", "native")).alias("b")).select("video_id", "b.source", "b.key", "b.native")
    return best.select("video_id", "source", "key", ((F.col("source") == "auto") & is_translated(F.col("native"), F.col("key"))).alias("translated"))


def names_shown(keys: Column, limit: int = 8) -> Column:
    """The first keys of a sorted array, and how many more there are."""
    k = F.sort_array(keys)
    head = F.array_join(F.slice(k, 1, limit), ", ")
    return F.when(F.size(k) == 0, "(none)").when(F.size(k) <= limit, head).otherwise(F.concat(head, F.lit(", +"), (F.size(k) - limit).cast("string"), F.lit(" more")))


def shown_of(df: DataFrame, key: str, name: str, limit: int = 8) -> DataFrame:
    """(key, shown) of rows (key, name): the first names of each key in order, and how many more there are. Only the first of each part of the table travel, so a hot key is never collected."""
    d = df.select(F.col(key).alias("k"), F.col(name).alias("v")).where("v is not null").distinct()
    first = d.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("v"))).where(F.col("r") <= limit).groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("v")), ", ").alias("head"))
    more = d.groupBy("k").agg((F.count(F.lit(1)) - limit).alias("more"))
    out = df.select(F.col(key).alias("k")).distinct().join(first, "k", "left").join(more, "k", "left")
    return out.select(F.col("k").alias(key), F.when(F.col("head").isNull(), "(none)").when(F.col("more") <= 0, F.col("head")).otherwise(F.concat("head", F.lit(", +"), F.col("more").cast("string"), F.lit(" more"))).alias("shown"))
