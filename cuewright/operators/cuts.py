"""Declared spans cut out of cues, and chapters placed among paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions.text import stamp
from cuewright.operators.scan import _join, last_value

MOST_REMOVABLE = 0.5
#: Width of the time buckets spans are joined by.
BUCKET_MS = 60_000
#: Width of the time buckets of an ordered scan.
SCAN_MS = 1_800_000


def hits(cues: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds hit_start, hit_end to the cues: the first span (by start, then end) that holds the middle of the cue, null if none does.

    Spans are put into every minute they touch and joined on (recording, minute), so a long recording is spread over its minutes and no cue meets a span far from it.
    """
    s = spans.select(F.col("video_id").alias("sv"), F.col("start_ms").cast("long").alias("hit_start"), F.col("end_ms").cast("long").alias("hit_end")).where("sv is not null and hit_end > hit_start").distinct()
    c = cues.withColumn("__m", F.floor((F.col("start_ms") + F.col("end_ms")) / 2))
    talk = c.groupBy(F.col("video_id").alias("sv")).agg(F.min("__m").alias("__a"), F.max("__m").alias("__z"))
    s = s.join(talk, "sv").withColumn("__a", F.greatest("hit_start", "__a")).withColumn("__z", F.least(F.col("hit_end") - 1, F.col("__z"))).where("__a <= __z")  # a span's wild end makes no rows beyond the recording
    s = s.withColumn("sb", F.explode(F.sequence(F.floor(F.col("__a") / BUCKET_MS), F.floor(F.col("__z") / BUCKET_MS)))).drop("__a", "__z")
    on = (F.col("video_id") == F.col("sv")) & (F.floor(F.col("__m") / BUCKET_MS) == F.col("sb")) & (F.col("hit_start") <= F.col("__m")) & (F.col("__m") < F.col("hit_end"))
    first = c.join(s, on).groupBy("video_id", "seq").agg(F.min(F.struct("hit_start", "hit_end")).alias("h")).select("video_id", "seq", "h.hit_start", "h.hit_end")
    return _join(cues, first, ["video_id", "seq"])


def cut_spans(cues: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues that stay, spans (video_id, start_ms, end_ms) that removed something). A recording that would lose more than half its cues is left whole."""
    h = hits(cues, spans)
    counts = h.groupBy("video_id").agg(F.count(F.lit(1)).alias("__all"), F.count("hit_start").alias("__hit"))
    sane = counts.select("video_id", (F.col("__all") - F.col("__hit") >= F.col("__all") * (1 - MOST_REMOVABLE)).alias("__sane"))
    h = _join(h, sane, ["video_id"])
    kept = h.where(F.col("hit_start").isNull() | ~F.col("__sane")).select(*cues.columns)
    applied = h.where(F.col("hit_start").isNotNull() & F.col("__sane")).select("video_id", F.col("hit_start").alias("start_ms"), F.col("hit_end").alias("end_ms")).distinct()
    return kept, applied


# Fixed value: what an extractor calls a gap between titled sections.
UNTITLED = r"(?i)<untitled chapter \d+>"


def titled(chapters: DataFrame) -> DataFrame:
    """Chapters (video_id, start_ms, title) whose title says something: blanks around it are cut, empty and invented ones are left out."""
    d = chapters.withColumn("title", F.regexp_replace("title", r"(?U)^\s+|\s+$", ""))
    return d.where((F.col("title") != "") & ~F.col("title").rlike(f"^(?:{UNTITLED})$"))


def chapters_of(metadata: DataFrame) -> DataFrame:
    """(video_id, start_ms, timestamp, title) of the chapters in a recording's metadata (video_id, info: JSON with chapters of start_time in seconds and title); a start that is missing is 0, and so is one that is no number."""
    x = metadata.select("video_id", F.from_json("info", "chapters array<struct<start_time:string,title:string>>")["chapters"].alias("c"))
    x = x.select("video_id", F.explode("c").alias("c")).select("video_id", F.coalesce((F.col("c.start_time").try_cast("double") * 1000).try_cast("bigint"), F.lit(0).cast("bigint")).alias("start_ms"), F.col("c.title").alias("title"))
    return titled(x).select("video_id", "start_ms", stamp(F.col("start_ms")).alias("timestamp"), "title")


def place_chapters(chapters: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(video_id, start_ms, title, n, at_ms): each chapter before the first paragraph that does not begin before it; chapters after the last one vanish. An as-of join forward, as one ordered scan from the end."""
    p = paragraphs.select("video_id", "start_ms", F.lit(None).cast("string").alias("title"), F.struct(F.col("start_ms").alias("at_ms"), F.col("n").alias("n")).alias("x"), F.lit(1).alias("k")).where("start_ms is not null")
    c = chapters.select("video_id", "start_ms", "title", F.lit(None).cast(p.schema["x"].dataType).alias("x"), F.lit(0).alias("k")).where("start_ms is not null")
    d = p.unionByName(c).withColumn("__b", F.floor(-F.col("start_ms") / SCAN_MS)).withColumn("__s", -F.col("start_ms")).withColumn("__k", -F.col("k")).withColumn("__n", -F.coalesce("x.n", F.lit(0)))
    d = last_value(d, ["video_id"], "__b", ["__s", "__k", "__n"], F.col("x"), "y")
    return d.where("k = 0 and y is not null").select("video_id", "start_ms", "title", F.col("y.n").alias("n"), F.col("y.at_ms").alias("at_ms"))
