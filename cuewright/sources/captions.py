"""Cues out of caption payloads (json3) and timed text (WebVTT, SubRip)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as T

JSON3 = "events array<struct<tStartMs:bigint,dDurationMs:bigint,aAppend:int,segs:array<struct<utf8:string>>>>"


def json3_cues(payloads: DataFrame) -> DataFrame:
    """Cues (video_id, seq, start_ms, end_ms, text) of payloads (video_id, payload): events that append or hold no words are left out, a missing duration is 0, times missing are 0. A payload that is no JSON gives none."""
    p = payloads.select("video_id", F.from_json("payload", JSON3)["events"].alias("events"))
    e = p.select("video_id", F.posexplode("events").alias("seq", "e"))
    text = F.trim(T.clean_text(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), "")))
    start = F.coalesce("e.tStartMs", F.lit(0))
    d = e.where((F.coalesce("e.aAppend", F.lit(0)) != 1) & F.col("e.segs").isNotNull()).select("video_id", F.col("seq").cast("long").alias("seq"), start.alias("start_ms"), (start + F.coalesce("e.dDurationMs", F.lit(0))).alias("end_ms"), text.alias("text"))
    return d.where("text <> ''")


def payload_errors(payloads: DataFrame) -> DataFrame:
    """(video_id, error): why a payload gives no cues: 'empty', 'not json3', or null."""
    p = F.from_json("payload", JSON3)
    body = F.trim(F.coalesce("payload", F.lit("")))
    return payloads.select("video_id", F.when(body == "", "empty").when(~body.startswith("{") | p.isNull() | F.get_json_object("payload", "$").isNull(), "not json3").alias("error"))


def timed_text_cues(bodies: DataFrame) -> DataFrame:
    """Cues of timed text (video_id, body): HH:MM:SS.mmm or MM:SS.mmm on both sides of the arrow, settings after it cut off, markup gone, cues without words left out."""
    clock = r"((?:\d{1,3}:)?\d{1,2}:\d{2}[.,]\d{3})"
    block = rf"(?s){clock}[ \t]*-->[ \t]*{clock}[^\n]*\n?(.*?)(?=\n[ \t]*\n|\z)"
    body = F.regexp_replace("body", r"\r\n?", "\n")
    hits = lambda k: F.regexp_extract_all(body, F.lit(block), F.lit(k))
    d = bodies.select("video_id", F.posexplode(F.arrays_zip(hits(1).alias("a"), hits(2).alias("z"), hits(3).alias("t"))).alias("seq", "x"))
    text = F.regexp_replace(T.strip_markup(F.col("x.t"), ""), r"(?U)^\s+|\s+$", "")
    return d.select("video_id", F.col("seq").cast("long").alias("seq"), _ms(F.col("x.a")).alias("start_ms"), _ms(F.col("x.z")).alias("end_ms"), text.alias("text")).where("text <> ''")


def _ms(c: Column) -> Column:
    parts = F.transform(F.split(c, "[:.,]"), lambda p: p.cast("long"))
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.lit(0).cast("long"), lambda a, x: a * 60 + x) * 1000 + F.element_at(parts, -1)


def published_or_recognised(published: DataFrame, recognised: DataFrame) -> DataFrame:
    """Cues with their source: the published ones of a recording, speech recognition only where there is no published cue."""
    has = published.select("video_id").distinct()
    return published.withColumn("source", F.lit("published")).unionByName(recognised.join(has, "video_id", "left_anti").withColumn("source", F.lit("whisper")))


def asr_cues(segments: DataFrame) -> DataFrame:
    """Cues of recognised segments (video_id, seq, start_s, end_s, text) in seconds; times are cut to whole ms."""
    ms = lambda c: (F.col(c) * 1000).cast("long")
    return segments.select("video_id", "seq", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), F.trim("text").alias("text")).where("text <> ''")
