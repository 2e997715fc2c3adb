"""Queries over urls, feeds, documents read back, tracks, dates and messages; test tables serve as raw material for formats they do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.operators import render, segment, tracks, transcript
from cuewright.plans.caption_queries import TRANSCRIPTS
from cuewright.session import ship, table
from cuewright.sources import captions, documents, feeds
from cuewright.streaming import resume


def _urls(spark: SparkSession, d: str) -> DataFrame:
    """Urls of every shape, made of the ids of the recordings."""
    r = table(spark, d, "recordings").select("video_id", "url").distinct()
    shapes = [F.col("url")] + [F.concat(F.lit(a), F.col("video_id"), F.lit(z)) for a, z in (
        ("https://www.youtube.com/watch?v=", ""), ("https://www.youtube.com/watch?v=", "&list=PL1&t=9s"), ("https://youtu.be/", "?si=1"), ("https://www.youtube.com/shorts/", ""), ("https://www.youtube.com/playlist?list=", ""),
        ("https://www.youtube.com/@", ""), ("podcast:https://cast.invalid/feed.xml#", ""), ("https://cast.invalid/", "/rss"), ("https://feeds.cast.invalid/", ""), ("https://podcasts.apple.com/us/podcast/x/id12345?i=", ""), ("https://open.spotify.com/show/", ""), ("A show of ", ""),
    )]
    return r.select(F.explode(F.array(*shapes)).alias("url"))


def url_class(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("url", T.is_video_url(u).alias("video"), T.is_playlist_url(u).alias("playlist"), T.is_playlist_url(u, True).alias("forced"), T.is_ambiguous_url(u).alias("ambiguous"))


def url_id(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("url", T.video_id(u).alias("id"), T.anchor_url(u, F.lit(61500)).alias("anchor"))


def url_route(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("url", feeds.is_podcast(u).alias("podcast"), feeds.route(u).alias("how"), feeds.parse_reference(u)["feed"].alias("feed"), feeds.parse_reference(u)["episode"].alias("episode"))


def sha_ids(spark, d):
    return table(spark, d, "recordings").select("video_id", T.short_sha1(F.col("url")).alias("episode"), T.hash_prefix(F.col("video_id")).alias("prefix")).distinct()


def date_iso(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("c"))
    return o.select("o_orderkey", T.iso_date(F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("x"), "c")).otherwise(F.col("c"))).alias("iso"))


def rfc822_iso(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", T.rfc822_date(F.concat(F.lit("Mon, "), F.date_format("o_orderdate", "d MMM yyyy"), F.lit(" 10:00:00 +0200"))).alias("iso"))


def duration_seconds(spark, d):
    """Durations in every spelling, made of the starts of the cues."""
    s = table(spark, d, "segments").where("start_ms is not null").select("start_ms").distinct()
    sec = F.floor(F.col("start_ms") / 1000)
    forms = F.array(sec.cast("string"), F.concat_ws(":", F.floor(sec / 60).cast("string"), (sec % 60).cast("string")), T.subtitle_time(F.col("start_ms"), "."), F.concat(sec.cast("string"), F.lit("s")), F.concat_ws(":", F.lit("1"), F.lit("2"), F.lit("3"), sec.cast("string")))
    return s.select(F.explode(forms).alias("spelled")).distinct().select("spelled", T.duration_seconds(F.col("spelled")).alias("seconds"))


def slugs(spark, d):
    return table(spark, d, "recordings").select("video_id", T.slug(F.col("title"), F.col("video_id")).alias("slug")).distinct()


def first_prose(spark, d):
    """The opening of each document's text."""
    return table(spark, d, "documents").select("doc_id", T.first_prose(F.col("text")).alias("opening"))


def markup(spark, d):
    return table(spark, d, "paragraphs").select("video_id", "n", F.md5(T.strip_markup(F.col("text")).cast("binary")).alias("hash")).distinct()


def clean_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_text(F.col("text")).cast("binary")).alias("hash"), T.word_count(F.col("text")).alias("words"))


def error_classes(spark, d):
    """Messages of an extractor, made of the recordings' sources."""
    said = {"auto": "HTTP Error 429: Too Many Requests", "manual": "Subtitles are disabled for this video", "published": "Sign in to confirm your age", "whisper": "Sign in to confirm you're not a bot"}
    m = F.lit("Something else")
    for k, v in said.items():
        m = F.when(F.col("source") == k, F.lit(v)).otherwise(m)
    full = F.concat(F.lit("ERROR: [youtube] "), "video_id", F.lit(": "), m, F.lit(". Use --cookies for the rest"))
    return table(spark, d, "recordings").select("video_id", T.error_class(full).alias("class"), T.tidy_error(full).alias("message")).distinct()


def track_pick(spark, d):
    """Caption tracks of each channel: the sources and languages of its recordings; the spoken language is that of its first recording."""
    r = table(spark, d, "recordings").where("channel is not null")
    t = r.select(F.col("channel").alias("video_id"), F.when(F.col("source") == "manual", "manual").otherwise("auto").alias("source"), F.when(F.col("turns") % 3 == 0, F.concat("lang", F.lit("-orig"))).otherwise(F.col("lang")).alias("key")).distinct()
    t = t.withColumn("pos", F.ascii("key") * 1000 + F.length("key"))
    own = r.groupBy(F.col("channel").alias("video_id")).agg(F.min_by("lang", "video_id").alias("language"))
    return tracks.pick_tracks(t, own)


def tracks_shown(spark, d):
    return tracks.shown_of(table(spark, d, "recordings").where("channel is not null"), "channel", "video_id")


def playlist_entries(spark, d):
    r = table(spark, d, "recordings").where("channel is not null").select("channel", "video_id", "url", "source").distinct()
    e = r.select(F.col("channel").alias("playlist"), F.lit(0).alias("pos"), F.when(F.col("source") == "auto", F.col("url")).alias("url"), F.when(F.col("source") == "manual", F.col("url")).alias("webpage_url"), F.when(F.col("source") != "whisper", F.col("video_id")).alias("id"))
    return feeds.expand(e).select("playlist", "url")


def feed_scan(spark, d):
    """Each channel as a feed, written as RSS and read again."""
    ship(spark)
    r = table(spark, d, "recordings").where("channel is not null").groupBy("channel", "video_id").agg(F.max(F.coalesce("title", F.lit(""))).alias("title"), F.max("duration_ms").alias("ms"), F.max("upload_date").alias("day"))
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    day = F.coalesce(F.date_format(F.try_to_date("day", "yyyy-MM-dd"), "EEE, d MMM yyyy"), F.lit(""))
    item = F.concat(F.lit("<item><title>"), esc(F.col("title")), F.lit("</title><guid>"), "video_id", F.lit("</guid><pubDate>"), day, F.lit("</pubDate><description>&lt;p&gt;"), esc(F.col("title")), F.lit("&lt;/p&gt;</description><itunes:duration>"),
                    T.stamp(F.col("ms")), F.lit('</itunes:duration><enclosure url="https://audio.invalid/'), "video_id", F.lit('.mp3" type="audio/mpeg" length="1"/></item>'))
    f = r.groupBy(F.col("channel").alias("feed")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("video_id", item.alias("i")))), lambda x: x["i"]), "").alias("items"))
    body = F.concat(F.lit('<?xml version="1.0"?><rss xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>'), esc(F.col("feed")), F.lit("</title>"), "items", F.lit("</channel></rss>"))
    return feeds.playable(feeds.episodes(f.select("feed", body.alias("body")))).select("feed", "pos", "id", "title", "audio", "published", "duration_s")


def _markdown(spark, d, timed=False):
    r = table(spark, d, "recordings").groupBy("video_id").agg(*[F.max(c).alias(c) for c in ("title", "channel", "upload_date", "description", "url", "source", "lang", "translated", "punctuated", "turns")])
    p = table(spark, d, "paragraphs").where("start_ms is not null" if timed else "true").withColumn("start_ms", T.milliseconds(F.col("start_ms"), F.col("timestamp")))
    p = p.groupBy("video_id", "n").agg(F.min(F.struct(F.col("start_ms").isNull().alias("late"), "start_ms", "turn", "text", "speaker", "speaker_confidence")).alias("x")).select("video_id", "n", "x.*").drop("late")
    p = p.withColumn("text", F.trim(T.clean_text(F.col("text")))).withColumn("timestamp", T.stamp(F.col("start_ms")))
    return render.markdown(r, p)


def _read_back(documents_):
    m = documents.parse_markdown(documents_.select(F.col("video_id").alias("path"), F.col("body").alias("raw")))
    return m.select(F.col("path").alias("video_id"), "title", "channel", "url", F.size("paragraphs").alias("paragraphs"))


def markdown_scan(spark, d):
    """Documents written as markdown and read back, of the paragraphs with start_ms only, as its SQL has it; markdown_documents has all."""
    return _read_back(_markdown(spark, d, timed=True))


def markdown_documents(spark, d):
    """Documents of all paragraphs written as markdown and read back."""
    return _read_back(_markdown(spark, d))


def json_documents(spark, d):
    j = render.json_document(table(spark, d, "recordings").select("video_id", "title", "lang", "turns").distinct())
    return j.select(F.get_json_object("body", "$.video_id").alias("video_id"), F.get_json_object("body", "$.lang").alias("lang"), F.get_json_object("body", "$.turns").cast("int").alias("turns"))


def resume_pending(spark, d):
    """Recordings without paragraphs of speakers yet: what a batch still has to do."""
    done = table(spark, d, "paragraphs").where("speaker is not null").select("video_id").distinct()
    return resume.pending(table(spark, d, "recordings").select("video_id").distinct(), done)


def source_tally(spark, d):
    return resume.tally(table(spark, d, "recordings").select(F.col("source").alias("status")))


def asr_fallback(spark, d):
    """Published cues where there are any, else recognised ones."""
    s = table(spark, d, "segments").where("text is not null and start_ms is not null and end_ms is not null")
    pub = s.join(table(spark, d, "recordings").where("source = 'published'").select("video_id").distinct(), "video_id", "left_semi").select("video_id", "seq", "start_ms", "end_ms", "text")
    asr = captions.asr_cues(s.select("video_id", "seq", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), "text"))
    return captions.published_or_recognised(pub, asr).groupBy("video_id", "source").agg(F.count(F.lit(1)).alias("cues"))


def silence_sessions(spark, d):
    s = table(spark, d, "segments").where("start_ms is not null and end_ms > start_ms").select("video_id", "start_ms", "end_ms")
    return resume.silence_sessions(s)


def _transcripts(spark, d):
    ship(spark)
    spans = table(spark, d, "sponsors_removed").where("category = 'sponsor' and start_ms is not null and end_ms is not null")
    rec = table(spark, d, "recordings").groupBy("video_id").agg(*[F.max(c).alias(c) for c in ("title", "channel", "upload_date", "description", "url", "source", "lang", "translated", "duration_ms")])
    return transcript.transcripts(segment.cues_of(table(spark, d, "segments")), rec, spans)


def transcript_facts(spark, d):
    return _transcripts(spark, d)[0].select("video_id", "punctuated", "turns", "captions_end_ms", "duration_ms")


def transcript_paragraphs(spark, d):
    return _transcripts(spark, d)[1]


def prompt_contexts(spark, d):
    r = table(spark, d, "recordings").groupBy("video_id").agg(*[F.min(c).alias(c) for c in ("title", "channel", "upload_date", "description")])
    return transcript.context(r, table(spark, d, "known").where("origin = 'corpus'"))


def prompt_batches(spark, d):
    p = table(spark, d, "paragraphs").groupBy("video_id", "n").agg(F.min("text").alias("text"))
    return transcript.numbered_batches(p).select("video_id", "batch", F.md5(F.col("body").cast("binary")).alias("hash"))


def missing_people(spark, d):
    return transcript.failures(table(spark, d, "people").where("name is not null"), table(spark, d, "recordings"), table(spark, d, "known"))


QUERIES = {f.__name__: f for f in (
    url_class, url_id, url_route, sha_ids, date_iso, rfc822_iso, duration_seconds, slugs, first_prose, markup, clean_documents, error_classes, track_pick, tracks_shown, playlist_entries, feed_scan, markdown_scan, markdown_documents, json_documents,
    transcript_facts, transcript_paragraphs, prompt_contexts, prompt_batches, missing_people, resume_pending, source_tally, asr_fallback, silence_sessions,
)}

_URLS = """r AS (SELECT DISTINCT video_id, url FROM recordings), u AS (SELECT unnest([url, 'https://www.youtube.com/watch?v=' || video_id, 'https://www.youtube.com/watch?v=' || video_id || '&list=PL1&t=9s', 'https://youtu.be/' || video_id || '?si=1',
'https://www.youtube.com/shorts/' || video_id, 'https://www.youtube.com/playlist?list=' || video_id, 'https://www.youtube.com/@' || video_id, 'podcast:https://cast.invalid/feed.xml#' || video_id, 'https://cast.invalid/' || video_id || '/rss',
'https://feeds.cast.invalid/' || video_id, 'https://podcasts.apple.com/us/podcast/x/id12345?i=' || video_id, 'https://open.spotify.com/show/' || video_id, 'A show of ' || video_id]) AS url FROM r)"""
_VIDEO = r"(?:[?&]v=|youtu\.be/|/shorts/)([\w-]{11})"
_LIST = "(?i)/playlist|/channel/|/@|/c/|/user/|[?&]list="
_WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}]"
# The path of a url, without host, parameters, query and fragment; a feed is told by it alone, a podcast by the whole url where there is none.
_PATH = r"regexp_extract(url, '(?i)^https?://[^/?#;]*([^?#;]*)', 1)"
_SHAPE = r"'(?i)\.(?:xml|rss)(?:$|\?)|/(?:feed|rss)(?:/|$|\?)|^feeds?\.'"
_FEEDISH = f"(regexp_matches(url, '(?i)^https?://') AND regexp_matches({_PATH}, {_SHAPE}))"
_PODCAST = f"regexp_matches(coalesce(nullif({_PATH}, ''), url), {_SHAPE})"
_STORE = r"regexp_matches(url, '(?i)(?:music|open|podcasters)\.(?:amazon|spotify)\.|podcasts\.google\.|pca\.st|overcast\.fm|castbox\.fm|iheart\.com')"
_APPLE = r"regexp_matches(url, '(?i)podcasts\.apple\.com/.*?/id(\d+)')"

SQL = {
    **TRANSCRIPTS,
    "prompt_contexts": """WITH r AS (SELECT video_id, min(title) AS title, min(channel) AS channel, min(upload_date) AS day, min(description) AS about FROM recordings GROUP BY video_id),
k0 AS (SELECT DISTINCT video_id, name FROM known WHERE origin = 'corpus'), k AS (SELECT video_id, list(name ORDER BY name) AS names FROM k0 GROUP BY video_id)
SELECT video_id, 'Title: ' || coalesce(title, '') || chr(10) || 'Channel (the host): ' || CASE WHEN trim(coalesce(channel, '')) <> '' THEN channel ELSE 'unknown' END || CASE WHEN trim(coalesce(day, '')) <> '' THEN chr(10) || 'Published: ' || day ELSE '' END
|| CASE WHEN trim(coalesce(about, '')) <> '' THEN chr(10) || 'Description:' || chr(10) || left(trim(about), 1500) ELSE '' END || CASE WHEN names IS NOT NULL THEN chr(10) || 'People already identified elsewhere: ' || array_to_string(names[1:40], ', ') ELSE '' END AS context
FROM r LEFT JOIN k USING (video_id)""",
    "prompt_batches": """WITH p AS (SELECT video_id, n, min(text) AS text FROM paragraphs GROUP BY video_id, n)
SELECT video_id, ((n - 1) // 40)::INTEGER AS batch, md5(string_agg('[' || n || '] ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY n)) AS hash FROM p GROUP BY 1, 2""",
    "missing_people": """SELECT DISTINCT video_id, 'no people found, though the metadata names a speaker' AS failed FROM recordings r
WHERE EXISTS (SELECT 1 FROM known k WHERE k.video_id = r.video_id) AND NOT EXISTS (SELECT 1 FROM people p WHERE p.video_id = r.video_id AND name IS NOT NULL)""",
    "url_class": f"WITH {_URLS} SELECT url, regexp_matches(url, '{_VIDEO}') AS video, regexp_matches(url, '{_LIST}') AND NOT regexp_matches(url, '{_VIDEO}') AS playlist, regexp_matches(url, '{_LIST}') AS forced, regexp_matches(url, '{_LIST}') AND regexp_matches(url, '{_VIDEO}') AS ambiguous FROM u",
    "url_id": f"""WITH {_URLS} SELECT url, CASE WHEN starts_with(url, 'podcast:') THEN nullif(regexp_extract(url, '#(.*)$', 1), '') ELSE nullif(regexp_extract(url, '{_VIDEO}', 1), '') END AS id,
CASE WHEN regexp_matches(url, '{_VIDEO}') THEN 'https://www.youtube.com/watch?v=' || regexp_extract(url, '{_VIDEO}', 1) || '&t=61s' ELSE string_split(url, '#')[1] || '#t=61' END AS anchor FROM u""",
    "url_route": f"""WITH {_URLS} SELECT url, starts_with(url, 'podcast:') OR NOT regexp_matches(url, '(?i)^https?://') OR {_STORE} OR {_APPLE} OR {_PODCAST} AS podcast,
CASE WHEN starts_with(url, 'podcast:') THEN 'reference' WHEN {_FEEDISH} THEN 'feed' WHEN {_APPLE} THEN 'apple' WHEN {_STORE} THEN 'storefront' ELSE 'search' END AS how,
CASE WHEN starts_with(url, 'podcast:') THEN string_split(substr(url, 9), '#')[1] ELSE url END AS feed, CASE WHEN starts_with(url, 'podcast:') THEN nullif(regexp_extract(url, '#(.*)$', 1), '') END AS episode FROM u""",
    "sha_ids": "SELECT DISTINCT video_id, substr(sha1(url), 1, 11) AS episode, substr(sha256(video_id), 1, 4) AS prefix FROM recordings",
    "date_iso": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders",
    "rfc822_iso": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders",
    "duration_seconds": """WITH s AS (SELECT DISTINCT start_ms, start_ms // 1000 AS sec FROM segments WHERE start_ms IS NOT NULL),
f AS (SELECT unnest([sec::VARCHAR, (sec // 60) || ':' || (sec % 60), printf('%02d:%02d:%02d.%03d', sec // 3600, sec // 60 % 60, sec % 60, start_ms % 1000), sec || 's', '1:2:3:' || sec]) AS spelled, unnest([sec, sec, sec, 0, 0]) AS seconds FROM s)
SELECT DISTINCT spelled, seconds FROM f""",
    "slugs": r"""WITH s AS (SELECT DISTINCT video_id, trim(left(trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '-'), 60), '-') AS s FROM recordings) SELECT video_id, CASE WHEN s = '' THEN video_id ELSE s || '-' || video_id END AS slug FROM s""",
    "first_prose": rf"""WITH d AS (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '^{_WS}+|{_WS}+$', '', 'g'), '\n{_WS}*\n') AS bs FROM documents),
b AS (SELECT doc_id, unnest(range(1, len(bs) + 1)) AS i, unnest(bs) AS b FROM d),
p AS (SELECT doc_id, i, trim(regexp_replace(array_to_string(list_filter(string_split_regex(b, '\r\n|[\n\r\x0B\f\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: NOT regexp_matches(x, '(?i)^{_WS}*(?:[-*•]|\d{{1,2}}:\d{{2}}|#[\pL\pN_]|https?://|[^\pL\pN\pM_]*$)|^{_WS}*[\pL\pN\pM_ ]{{0,24}}:{_WS}*$')), ' '), '{_WS}+', ' ', 'g')) AS p FROM b),
f AS (SELECT doc_id, arg_min(p, i) AS p FROM p WHERE length(p) > 40 GROUP BY doc_id)
SELECT d.doc_id, coalesce(CASE WHEN length(p) > 300 THEN rtrim(left(p, 300)) || '...' ELSE p END, '') AS opening FROM d LEFT JOIN f USING (doc_id)""",
    "markup": "SELECT DISTINCT video_id, n, md5(regexp_replace(text, '<[^>]+>', ' ', 'g')) AS hash FROM paragraphs",
    "clean_documents": f"""SELECT doc_id, md5(regexp_replace(translate(text, chr(8209) || chr(8208) || chr(160) || chr(8203), '-- '), '{_WS}+', ' ', 'g')) AS hash, len(list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> ''))::INTEGER AS words FROM documents""",
    "error_classes": """SELECT DISTINCT video_id, CASE source WHEN 'auto' THEN 'rate_limited' WHEN 'manual' THEN 'no_captions' WHEN 'published' THEN 'unavailable' WHEN 'whisper' THEN 'rate_limited' ELSE 'error' END AS class,
CASE source WHEN 'auto' THEN 'HTTP Error 429: Too Many Requests' WHEN 'manual' THEN 'Subtitles are disabled for this video' WHEN 'published' THEN 'Sign in to confirm your age' WHEN 'whisper' THEN 'Sign in to confirm you''re not a bot' ELSE 'Something else' END AS message FROM recordings""",
    "track_pick": """WITH r AS (SELECT * FROM recordings WHERE channel IS NOT NULL), o AS (SELECT channel, arg_min(lang, video_id) AS native FROM r GROUP BY channel),
t AS (SELECT DISTINCT channel, CASE WHEN source = 'manual' THEN 'manual' ELSE 'auto' END AS source, CASE WHEN turns % 3 = 0 THEN lang || '-orig' ELSE lang END AS key FROM r),
k AS (SELECT t.*, native, string_split(key, '-')[1] AS p FROM t JOIN o USING (channel)),
w AS (SELECT *, CASE WHEN source = 'manual' AND p = 'en' THEN 0 WHEN source = 'manual' AND p = native THEN 1 WHEN source = 'auto' AND p = native THEN 2 WHEN source = 'auto' AND p = 'en' THEN 3 END AS rk FROM k)
SELECT channel AS video_id, source, key, source = 'auto' AND p <> native AS translated FROM w WHERE rk IS NOT NULL QUALIFY row_number() OVER (PARTITION BY channel ORDER BY rk, key = p DESC, key) = 1""",
    "tracks_shown": "WITH k AS (SELECT channel, list(DISTINCT video_id ORDER BY video_id) AS k FROM recordings WHERE channel IS NOT NULL GROUP BY channel) SELECT channel, array_to_string(k[1:8], ', ') || CASE WHEN len(k) > 8 THEN ', +' || (len(k) - 8) || ' more' ELSE '' END AS shown FROM k",
    "playlist_entries": "SELECT DISTINCT channel AS playlist, CASE WHEN source IN ('auto', 'manual') THEN url ELSE 'https://www.youtube.com/watch?v=' || video_id END AS url FROM recordings WHERE channel IS NOT NULL AND source <> 'whisper'",
    "feed_scan": """WITH r AS (SELECT channel, video_id, max(coalesce(title, '')) AS title, max(duration_ms) AS ms, max(upload_date) AS day FROM recordings WHERE channel IS NOT NULL GROUP BY channel, video_id)
SELECT channel AS feed, (row_number() OVER (PARTITION BY channel ORDER BY video_id) - 1)::INTEGER AS pos, substr(sha1(video_id), 1, 11) AS id, trim(title) AS title, 'https://audio.invalid/' || video_id || '.mp3' AS audio, coalesce(day, '') AS published, ms // 1000 AS duration_s FROM r""",
    "markdown_scan": """WITH r AS (SELECT video_id, max(title) AS title, max(channel) AS channel, max(url) AS url FROM recordings GROUP BY video_id),
p AS (SELECT video_id, count(DISTINCT n)::INTEGER AS k FROM paragraphs WHERE start_ms IS NOT NULL GROUP BY video_id) SELECT video_id, coalesce(trim(title), '') AS title, coalesce(channel, '') AS channel, url, coalesce(k, 0)::INTEGER AS paragraphs FROM r LEFT JOIN p USING (video_id)""",
    "markdown_documents": """WITH r AS (SELECT video_id, max(title) AS title, max(channel) AS channel, max(url) AS url FROM recordings GROUP BY video_id),
p AS (SELECT video_id, count(DISTINCT n)::INTEGER AS k FROM paragraphs GROUP BY video_id) SELECT video_id, coalesce(trim(title), '') AS title, coalesce(channel, '') AS channel, url, coalesce(k, 0)::INTEGER AS paragraphs FROM r LEFT JOIN p USING (video_id)""",
    "json_documents": "SELECT video_id, lang, turns FROM (SELECT DISTINCT video_id, title, lang, turns FROM recordings)",
    "resume_pending": "SELECT DISTINCT video_id FROM recordings r WHERE NOT EXISTS (SELECT 1 FROM paragraphs p WHERE p.video_id = r.video_id AND p.speaker IS NOT NULL)",
    "source_tally": "SELECT source AS status, count(*) AS n FROM recordings GROUP BY source",
    "asr_fallback": f"""WITH s AS (SELECT * FROM segments WHERE text IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL), p AS (SELECT DISTINCT video_id FROM recordings WHERE source = 'published'), b AS (SELECT DISTINCT s.video_id FROM s JOIN p USING (video_id))
SELECT video_id, 'published' AS source, count(*) AS cues FROM s JOIN b USING (video_id) GROUP BY video_id UNION ALL SELECT video_id, 'whisper', count(*) FROM s WHERE video_id NOT IN (SELECT video_id FROM b) AND trim(text) <> '' GROUP BY video_id""",
    "silence_sessions": """WITH s AS (SELECT video_id, start_ms, end_ms, max(end_ms + 2000) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM segments WHERE start_ms IS NOT NULL AND end_ms > start_ms),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR start_ms > m THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS cues FROM g GROUP BY video_id, k""",
}
