"""Whole transcripts: cues to paragraphs with their numbers and times, and one row of facts a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.operators import render
from cuewright.operators.cuts import cut_spans
from cuewright.operators.scan import _join, running_sum
from cuewright.operators.segment import TARGET_WORDS, paragraphs, punctuated

#: Turns of one bucket when paragraphs are numbered.
TURNS = 256


def transcripts(cues: DataFrame, recordings: DataFrame, spans: DataFrame | None = None, target: int = TARGET_WORDS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(facts, paragraphs, spans that cut something): cues cut by the spans if there are any, then folded.

    facts: the recordings with punctuated, turns, captions_end_ms and duration_ms (the last cue's end where it is missing or 0). paragraphs: (video_id, n, start_ms, timestamp, turn, text).
    A recording without cues has no paragraph, 0 turns and is not punctuated.
    """
    applied = None
    if spans is not None:
        cues, applied = cut_spans(cues, spans)
    flags = punctuated(cues)
    p = paragraphs(cues, flags, target).withColumn("__b", F.floor(F.col("turn") / TURNS))
    p = running_sum(p, ["video_id"], "__b", ["turn", "k"], F.lit(1), "n")
    p = p.select("video_id", F.col("n").cast("int").alias("n"), "start_ms", T.stamp(F.col("start_ms")).alias("timestamp"), "turn", "text")
    end = cues.groupBy("video_id").agg(F.max_by("end_ms", "seq").alias("captions_end_ms"))
    turns = p.groupBy("video_id").agg(F.count_distinct("turn").alias("turns"))
    base = recordings.drop("punctuated", "turns", "captions_end_ms")
    facts = _join(_join(_join(base, flags, ["video_id"]), end, ["video_id"]), turns, ["video_id"])
    facts = facts.withColumn("punctuated", F.coalesce("punctuated", F.lit(False))).withColumn("turns", F.coalesce("turns", F.lit(0))).withColumn("captions_end_ms", F.coalesce("captions_end_ms", F.lit(0)))
    if "duration_ms" in facts.columns:
        facts = facts.withColumn("duration_ms", F.when(F.coalesce("duration_ms", F.lit(0)) > 0, F.col("duration_ms")).otherwise(F.col("captions_end_ms")))
    return facts, p, applied


def rendered(form: str, facts: DataFrame, paragraphs_: DataFrame, cues: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """(video_id, body) in one of the forms: md, json, srt, vtt."""
    if form == "md":
        for c in ("speaker", "speaker_confidence"):
            if c not in paragraphs_.columns:
                paragraphs_ = paragraphs_.withColumn(c, F.lit(None).cast("string"))
        return render.markdown(facts, paragraphs_, chapters)
    if form == "json":
        p = paragraphs_.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in ("n", "start_ms", "timestamp", "turn", "text") if c in paragraphs_.columns]))).alias("paragraphs"))
        d = _join(facts, p, ["video_id"])
        return d.select("video_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("body"))
    return {"srt": render.srt, "vtt": render.vtt}[form](cues)


def context(recordings: DataFrame, people: DataFrame | None = None, names: int = 40, limit: int = 1500) -> DataFrame:
    """(video_id, context): what a recording says about itself, for a model to read; people: (video_id, name) established elsewhere, the first `names` of them in order."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    d = recordings.select("video_id", "title", "channel", "upload_date", "description")
    seen: Column = F.lit(None).cast("string")
    if people is not None:
        one = people.select("video_id", "name").distinct().groupBy("video_id").agg(F.array_join(F.slice(F.sort_array(F.collect_list("name")), 1, names), ", ").alias("__seen"))
        d, seen = _join(d, one, ["video_id"]), F.col("__seen")
    lines = [
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))), F.concat(F.lit("Channel (the host): "), F.when(has("channel"), F.col("channel")).otherwise("unknown")),
        F.when(has("upload_date"), F.concat(F.lit("Published: "), "upload_date")), F.when(has("description"), F.concat(F.lit("Description:\n"), F.left(F.trim("description"), F.lit(limit)))),
        F.when(seen.isNotNull(), F.concat(F.lit("People already identified elsewhere: "), seen)),
    ]
    return d.select("video_id", F.array_join(F.array_compact(F.array(*lines)), "\n").alias("context"))


def numbered_batches(paragraphs_: DataFrame, size: int = 40) -> DataFrame:
    """(video_id, batch, body): paragraphs with their absolute numbers, `size` of them at a time."""
    d = paragraphs_.select("video_id", "n", F.floor((F.col("n") - 1) / size).cast("int").alias("batch"), F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.coalesce("text", F.lit(""))).alias("line"))
    return d.groupBy("video_id", "batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n\n").alias("body"))


def retry_hints(violations: DataFrame, known: DataFrame) -> DataFrame:
    """(video_id, hint): what to tell a model that broke constraints: their details, then the names the metadata gives."""
    v = violations.groupBy("video_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "detail"))), lambda x: F.concat(F.lit("- "), x["detail"])), "\n").alias("__v"))
    k = known.select("video_id", "name").distinct().groupBy("video_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("__k"))
    tail = F.coalesce(F.concat(F.lit("\n\nPeople this recording's metadata names: "), "__k"), F.lit(""))
    return _join(v, k, ["video_id"]).select("video_id", F.concat(F.lit("The previous answer broke these constraints:\n"), "__v", tail).alias("hint"))


def failures(people: DataFrame, recordings: DataFrame, named: DataFrame) -> DataFrame:
    """(video_id, failed): recordings whose own metadata names speakers (named: video_id) though no person was found; an empty result that cannot be one."""
    d = recordings.select("video_id").distinct().join(named.select("video_id").distinct(), "video_id", "left_semi")
    return d.join(people.select("video_id").distinct(), "video_id", "left_anti").withColumn("failed", F.lit("no people found, though the metadata names a speaker"))
