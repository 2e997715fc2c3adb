"""Spans declared by others, out of an API's payload. A lookup tells only the head of an id's hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions.text import hash_prefix

PAYLOAD = "array<struct<videoID:string,segments:array<struct<category:string,segment:array<string>>>>>"


def spans_of(payloads: DataFrame, wanted: DataFrame, category: str = "sponsor") -> DataFrame:
    """(video_id, start_ms, end_ms), distinct, for the wanted recordings out of payloads (prefix, body): answers for others that share the prefix, other categories, pairs that are not two numbers and reversed ones are left out; seconds are cut to whole ms."""
    w = wanted.select("video_id", hash_prefix(F.col("video_id")).alias("prefix")).where("video_id <> ''").distinct()
    e = payloads.select("prefix", F.explode(F.from_json("body", PAYLOAD)).alias("e"))
    e = e.join(w, "prefix").where("e.videoID = video_id").select("video_id", F.explode("e.segments").alias("s")).where((F.col("s.category") == category) & (F.size("s.segment") == 2))
    a, z = F.col("s.segment")[0].try_cast("double"), F.col("s.segment")[1].try_cast("double")
    return e.select("video_id", a.alias("a"), z.alias("z")).where("z > a").select("video_id", (F.col("a") * 1000).cast("long").alias("start_ms"), (F.col("z") * 1000).cast("long").alias("end_ms")).distinct()
