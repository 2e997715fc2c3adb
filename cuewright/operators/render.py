"""Documents: subtitles, markdown, JSON, and a linked note for each person. One row a line until the last step, which joins the lines of one document in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.functions.text import fold
from cuewright.operators.cuts import place_chapters
from cuewright.operators.graph import KINDS, ends_of, tier
from cuewright.operators.scan import running_sum
from cuewright.operators.segment import BUCKET, repaired, turn_markers


def _document(lines: DataFrame, keys: list[str], order: list[str], line: str, between: str) -> DataFrame:
    """(keys, body): the lines of each document in order. A document is one value, so its lines meet in one task."""
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(line).alias("__l")))), lambda x: x["__l"]), between).alias("body"))


def srt_rows(cues: DataFrame) -> DataFrame:
    """(video_id, number, seq, block): numbered blocks of a SubRip file."""
    d = repaired(cues).withColumn("__b", F.floor(F.col("seq") / BUCKET))
    d = running_sum(d, ["video_id"], "__b", ["seq"], F.lit(1), "number")
    span = F.concat(T.subtitle_time(F.col("start_ms"), ","), F.lit(" --> "), T.subtitle_time(F.col("end_ms"), ","))
    return d.select("video_id", F.col("number").cast("int").alias("number"), "seq", F.concat_ws("\n", F.col("number").cast("string"), span, "text", F.lit("")).alias("block"))


def srt(cues: DataFrame) -> DataFrame:
    return _document(srt_rows(cues), ["video_id"], ["number"], "block", "\n")


def vtt(cues: DataFrame) -> DataFrame:
    d = repaired(cues)
    span = F.concat(T.subtitle_time(F.col("start_ms"), "."), F.lit(" --> "), T.subtitle_time(F.col("end_ms"), "."))
    d = _document(d.withColumn("block", F.concat_ws("\n", span, "text", F.lit(""))), ["video_id"], ["seq"], "block", "\n")
    return d.withColumn("body", F.concat(F.lit("WEBVTT\n\n"), "body"))


def _line(key: str, value: Column, when: Column | None = None) -> Column:
    text = F.concat(F.lit(f"{key}: "), F.coalesce(value.cast("string"), F.lit("")))
    return text if when is None else F.when(when, text)


# The literal lines of a document's head below are part of its format.
def front_matter(recordings: DataFrame) -> DataFrame:
    """(video_id, head): the lines at the top of a document."""
    r = recordings
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    about = T.first_prose(F.col("description"))
    source = F.concat(F.lit("source: "), F.col("source"), F.when(F.col("source") == "whisper", "  # generated by speech recognition, not a published transcript").otherwise(""))
    lines = [
        F.lit("---"), _line("title", F.col("title")), _line("channel", F.col("channel"), has("channel")), _line("published", F.col("upload_date"), has("upload_date")),
        _line("about", about, about != ""), _line("url", F.col("url")), source, _line("lang", F.col("lang")), _line("punctuated", F.lower(F.coalesce(F.col("punctuated"), F.lit(False)).cast("string"))),
        F.when(F.col("translated"), "translated: true  # machine translation of machine transcription"),
        F.when(F.col("turns") > 1, F.concat(F.lit("turns: "), F.col("turns").cast("string"), F.lit("  # speaker changes; who is speaking is not marked"))),
        F.when(~F.coalesce("punctuated", F.lit(False)), "note: unpunctuated speech recognition - no sentence breaks or speaker labels").when(
            F.col("source") == "whisper", "note: no transcript is published for this episode; every word here is ASR output and names in particular should be checked against the audio"),
        F.lit("---"),
    ]
    return r.select("video_id", F.array_join(F.array_compact(F.array(*lines)), "\n").alias("head"))


def markdown(recordings: DataFrame, paragraphs: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """(video_id, body): front matter, title, chapters as headings, and paragraphs with linked times and markers of speaker or turn.

    A time without start_ms is read from timestamp; one that can be read from neither is 00:00. A timestamp in another form than the documents' is written in theirs.
    """
    r = recordings.select("video_id", "title", "url")
    p = turn_markers(paragraphs).join(r, "video_id").withColumn("__ms", T.milliseconds(F.col("start_ms"), F.col("timestamp")))  # a column of its own, as it is used many times
    ms = F.col("__ms")
    shown = F.coalesce(F.when(F.col("timestamp").rlike(r"^\d[\d:]*$"), F.col("timestamp")), T.stamp(ms), F.lit("00:00"))
    link = F.concat(F.lit("["), shown, F.lit("]("), T.anchor_url(F.col("url"), F.coalesce(ms, F.lit(0))), F.lit(") "), "marker", "text")
    lines = p.select("video_id", "n", F.lit(1).alias("k"), F.lit(0).cast("long").alias("s"), link.alias("line"))
    if chapters is not None:
        placed = place_chapters(chapters, paragraphs).select("video_id", "n", F.lit(0).alias("k"), F.col("start_ms").cast("long").alias("s"), F.concat(F.lit("## "), "title").alias("line"))
        lines = lines.unionByName(placed)
    body = _document(lines, ["video_id"], ["n", "k", "s"], "line", "\n\n").withColumnRenamed("body", "lines")
    d = r.join(front_matter(recordings), "video_id").join(body, "video_id", "left")
    return d.select("video_id", F.concat("head", F.lit("\n\n# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("lines", F.lit("")), F.lit("\n")).alias("body"))


def stacked(documents: DataFrame, as_json: bool = False) -> DataFrame:
    """(video_id, chunk) of documents (video_id, body): chunks that, written in the order of video_id, are one output: bodies with a blank line between, or a JSON array, which a single document is without. No task holds more than a document."""
    d = documents.where("body is not null")
    n, a, z = d.agg(F.count(F.lit(1)), F.min("video_id"), F.max("video_id")).first()
    first, last = F.col("video_id") == F.lit(a), F.col("video_id") == F.lit(z)
    if not as_json:
        return d.select("video_id", F.concat("body", F.when(last, "").otherwise("\n\n")).alias("chunk"))
    if n < 2:
        return d.select("video_id", F.col("body").alias("chunk"))
    return d.select("video_id", F.concat(F.when(first, "[").otherwise(""), "body", F.when(last, "]").otherwise(",")).alias("chunk"))


def json_document(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body"))


def note_name(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|#^\[\]]', "-"), r"^[. -]+|[. -]+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unnamed"))


def wiki_link(target: Column, shown: Column) -> Column:
    return F.when((shown != "") & (shown != target), F.concat(F.lit("[["), target, F.lit("|"), shown, F.lit("]]"))).otherwise(F.concat(F.lit("[["), target, F.lit("]]")))


def short_quote(c: Column, limit: int = 240) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.left(t, F.lit(limit)), r" [^ ]*\z", ""), F.lit("…")))


def connection_lines(edges: DataFrame, people: DataFrame, weights: bool = False) -> DataFrame:
    """(end, stated, video_id, pos, edge_id, text): how each edge reads in the note of each of its ends, joined by key. Bare given names are linked within their recording."""
    phrase = F.create_map(*[F.lit(x) for k, (a, b) in KINDS.items() for x in (f"{k}>", a, f"{k}<", b)])
    known = people.where("not local").select(F.col("key").alias("__k"), F.lit(True).alias("__known"))
    e = ends_of(edges).withColumn("other", F.when(F.col("outgoing"), F.col("to_name")).otherwise(F.col("from_name")))
    e = e.join(known, fold(F.col("other")) == F.col("__k"), "left")
    scope = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("url", F.lit("")), r"[?&]v=([\w-]{11})", 1), F.lit("")), short_quote(F.col("video"), 40))
    scoped = F.when(scope != "", F.concat("other", F.lit(" ("), scope, F.lit(")"))).otherwise(F.col("other"))
    link = F.when(F.col("__known"), wiki_link(note_name(F.col("other")), F.lit(""))).otherwise(wiki_link(note_name(scoped), F.col("other")))
    if weights:
        link = F.concat(link, F.when(F.col("confidence") == "high", "::3").otherwise("::1"))
    way = F.coalesce(F.try_element_at(phrase, F.concat("kind", F.when(F.col("outgoing"), ">").otherwise("<"))), F.lit("is connected to"))
    quote = short_quote(F.col("evidence"))
    where = F.coalesce("video", F.lit(""))
    at = F.when((F.coalesce("url", F.lit("")) != "") & (F.coalesce("timestamp", F.lit("")) != ""), F.concat(F.lit("  — ["), "timestamp", F.lit("]("), "url", F.lit(") in "), where)).when(where != "", F.concat(F.lit("  — "), where))
    text = F.array_join(F.array_compact(F.array(F.concat(F.lit("- "), way, F.lit(" "), link), F.when(quote != "", F.concat(F.lit("  > "), quote)), at)), "\n")
    return e.select("end", (~F.col("confidence").eqNullSafe("low")).alias("stated"), "video_id", "pos", "edge_id", text.alias("text"))


def person_notes(people: DataFrame, edges: DataFrame, recordings: DataFrame, weights: bool = False, files: DataFrame | None = None) -> DataFrame:
    """(key, file, body) for every person who is not local: tags, roles, stated and implied connections, appearances. Files that would share a name get the end of their key's hash.

    files: (video_id, stem) of the transcripts there are, as documents.transcript_index gives them; an appearance links to its transcript where there is one, else it is only named.
    """
    p = people.where("not local")
    c = connection_lines(edges, people, weights)
    by = lambda stated, out: _document(c.where(F.col("stated") == stated), ["end"], ["video_id", "pos", "edge_id"], "text", "\n\n").select(F.col("end").alias("key"), F.col("body").alias(out))
    titles = recordings.groupBy("video_id").agg(F.min("title").alias("title"))
    spots = p.select("key", F.explode("appears_in").alias("video_id")).join(titles, "video_id", "left")
    spots = spots.withColumn("stem", F.lit(None).cast("string")) if files is None else spots.join(files.select("video_id", "stem"), "video_id", "left")
    called = F.coalesce(F.nullif("title", F.lit("")), "video_id", F.lit("unknown"))
    spot = F.concat(F.lit("- "), F.when(F.col("stem").isNotNull(), wiki_link(F.col("stem"), called)).otherwise(called))
    seen = _document(spots.withColumn("line", spot), ["key"], ["video_id"], "line", "\n").withColumnRenamed("body", "seen")
    d = p.join(by(True, "said"), "key", "left").join(by(False, "implied"), "key", "left").join(seen, "key", "left")
    head = F.concat(F.lit("---\ntags:\n  - person\n  - "), tier(F.col("local"), F.col("videos")), F.lit("\nappearances: "), F.col("videos").cast("string"), F.lit("\n---\n\n# "), "name")
    roles = F.when(F.size("roles") > 0, F.array_join(F.transform("roles", lambda r: F.concat(F.lit("- "), r)), "\n"))
    said = F.when(F.col("said").isNotNull(), F.concat(F.lit("## Connections\n\n"), "said"))
    implied = F.when(F.col("implied").isNotNull(), F.concat(F.lit("## Possible connections\n\n*The transcript implies these rather than saying them.*\n\n"), "implied"))
    at = F.when(F.col("seen").isNotNull(), F.concat(F.lit("## Appears in\n\n"), "seen"))
    body = F.concat(F.array_join(F.array_compact(F.array(head, roles, said, implied, at)), "\n\n"), F.lit("\n"))
    d = d.select("key", note_name(F.col("name")).alias("file"), body.alias("body"))
    twice = d.groupBy("file").agg(F.count(F.lit(1)).alias("__c"))
    return d.join(twice, "file").select("key", F.when(F.col("__c") > 1, F.concat("file", F.lit(" "), F.substring(F.sha1("key"), 1, 6))).otherwise(F.col("file")).alias("file"), "body")


def note_statistics(people: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (people, recurring, local, edges, stated, implied)."""
    none, of_people, of_edges = F.lit(None).cast("boolean"), people.select("local", (F.col("videos") >= 2).alias("often")), edges.select((~F.col("confidence").eqNullSafe("low")).alias("stated"))
    d = of_people.withColumn("stated", none).unionByName(of_edges.withColumn("local", none).withColumn("often", none))
    return d.agg(
        F.count_if(~F.col("local")).alias("people"), F.count_if(~F.col("local") & F.col("often")).alias("recurring"), F.count_if("local").alias("local"),
        F.count("stated").alias("edges"), F.count_if("stated").alias("stated"), F.count_if(~F.col("stated")).alias("implied"),
    )
