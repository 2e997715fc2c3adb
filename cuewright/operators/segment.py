"""Cues into turns and paragraphs, and cue timings fit for a subtitle file."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.operators.scan import _join, last_value, running_sum

# What parts paragraphs.
GAP_MS, TARGET_WORDS, MIN_WORDS = 2000, 110, 25
PUNCTUATED_SHARE = 0.05
#: Cues of one bucket in ordered scans.
BUCKET = 4096


def cues_of(segments: DataFrame) -> DataFrame:
    """Cues (video_id, seq, start_ms, end_ms, text) of raw segments: a repeated one once, without those lacking a bound or words, typography made plain."""
    s = segments.select("video_id", "seq", "start_ms", "end_ms", F.trim(T.clean_text(F.col("text"))).alias("text"))
    return s.where("video_id is not null and seq is not null and start_ms is not null and end_ms is not null and text <> ''").groupBy("video_id", "seq").agg(F.min(F.struct("start_ms", "end_ms", "text")).alias("x")).select("video_id", "seq", "x.*")


def punctuated(cues: DataFrame) -> DataFrame:
    """(video_id, punctuated): at least one cue in twenty ends a sentence."""
    return cues.groupBy("video_id").agg((F.avg(T.ends_sentence(F.col("text")).cast("int")) >= PUNCTUATED_SHARE).alias("punctuated"))


def split_turns(cues: DataFrame) -> DataFrame:
    """Cues cut at change markers: (video_id, seq, part, start_ms, end_ms, text, starts_turn). The parts of a cue share its times; empty parts go."""
    p = F.transform(F.split("text", ">{2,}"), lambda x: F.trim(x))
    full = F.filter(p, lambda x: x != "")
    d = cues.select("video_id", "seq", "start_ms", "end_ms", (p[0] == "").alias("lead"), F.posexplode(full).alias("k", "text"))
    return d.select("video_id", "seq", (F.col("k") + 1).alias("part"), "start_ms", "end_ms", "text", (F.col("lead") | (F.col("k") > 0)).alias("starts_turn"))


def number_turns(parts: DataFrame) -> DataFrame:
    """Adds turn: how many parts of the recording started a turn so far."""
    d = parts.withColumn("__b", F.floor(F.col("seq") / BUCKET))
    return running_sum(d, ["video_id"], "__b", ["seq", "part"], F.col("starts_turn").cast("int"), "turn").drop("__b")


def paragraphs(cues: DataFrame, is_punctuated: DataFrame | None = None, target: int = TARGET_WORDS) -> DataFrame:
    """(video_id, turn, k, start_ms, cues, words, text): cues grouped into paragraphs, k counting those of a turn; paragraphs of sound tags only are left out.

    A change of turn always parts; a silence of two seconds parts from MIN_WORDS words on; else a sentence end after `target` words where the recording is punctuated, or the cap
    (twice the target, or the target where it is not). A turn begins with nothing open, so turns are folded apart from each other: rows are shuffled by (recording, turn), sorted, and folded as a stream
    with one open paragraph in memory, however long the recording.
    """
    target = max(target, MIN_WORDS)
    flags = punctuated(cues) if is_punctuated is None else is_punctuated.select("video_id", "punctuated")
    d = _join(number_turns(split_turns(cues)), flags, ["video_id"])
    d = d.select("video_id", "turn", "seq", "part", "start_ms", "end_ms", "text", F.coalesce("punctuated", F.lit(False)).alias("p"), T.ends_sentence(F.col("text")).alias("ends"), T.word_count(F.col("text")).alias("w"))
    d = d.repartition("video_id", "turn").sortWithinPartitions("video_id", "turn", "seq", "part")

    def fold(batches):
        of, k, start, words, n, buf, before = None, 0, 0, 0, 0, [], None

        def done():
            return (*of, k, start, n, words, re.sub(r"\s+", " ", " ".join(buf)).strip())

        for pdf in batches:
            out = []
            for v, turn, s, e, text, p, ends, w in zip(pdf.video_id, pdf.turn, pdf.start_ms, pdf.end_ms, pdf.text, pdf.p, pdf.ends, pdf.w):
                cut = False
                if (v, turn) != of:
                    if buf:
                        out.append(done())
                    of, k, cut = (v, turn), 0, True
                elif words >= MIN_WORDS and before is not None and s - before >= GAP_MS and buf:
                    out.append(done())
                    cut = True
                if cut or not buf:
                    k += 1
                    buf, words, n, start = [], 0, 0, s
                buf.append(text)
                words, n, before = words + w, n + 1, e
                if (p and words >= target and ends) or words >= (2 * target if p else target):
                    out.append(done())
                    buf, words, n = [], 0, 0
            yield pd.DataFrame(out, columns=["video_id", "turn", "k", "start_ms", "cues", "words", "text"])
        if buf:
            yield pd.DataFrame([done()], columns=["video_id", "turn", "k", "start_ms", "cues", "words", "text"])

    schema = "video_id string, turn long, k int, start_ms long, cues int, words int, text string"
    return d.mapInPandas(fold, schema).where(~T.tags_only(F.col("text")))


def repaired(cues: DataFrame) -> DataFrame:
    """Cues whose times do not overlap: an end is cut at the next start, and lies at least 1 ms after its own."""
    d = cues.withColumn("__b", F.floor(-F.col("seq") / BUCKET)).withColumn("__o", -F.col("seq"))
    d = last_value(d, ["video_id"], "__b", ["__o"], F.col("start_ms"), "__next", before=True)
    end = F.greatest(F.least("end_ms", F.coalesce("__next", "end_ms")), F.col("start_ms") + 1)
    return d.select("video_id", "seq", "start_ms", end.alias("end_ms"), "text")


def turn_markers(paragraphs_: DataFrame) -> DataFrame:
    """Adds marker to (video_id, n, turn, speaker, speaker_confidence): the speaker where it differs from the last named one, '>> ' where nobody is named and the turn changes."""
    named = F.nullif("speaker", F.lit(""))
    d = paragraphs_.withColumn("__b", F.floor(F.col("n") / BUCKET))
    d = last_value(d, ["video_id"], "__b", ["n"], named, "__last", before=True)
    d = last_value(d, ["video_id"], "__b", ["n"], F.struct("turn"), "__before", before=True)
    sure = F.when(F.col("speaker_confidence") == "low", "?**: ").otherwise("**: ")
    who = F.when(F.col("__last").isNotNull() & (F.col("__last") == named), F.lit("")).otherwise(F.concat(F.lit("**"), named, sure))
    before = F.col("__before.turn")
    marker = F.when(named.isNotNull(), who).when(before.isNotNull() & ~before.eqNullSafe(F.col("turn")), ">> ").otherwise("")
    return d.withColumn("marker", marker).drop("__b", "__last", "__before")
