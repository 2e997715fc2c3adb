"""Queries over what a run keeps and gives out: logs, graphs and files written and read again, merged results, retries, targets resolved against a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.operators import cuts, graph, render, resolve, transcript
from cuewright.plans import caption_queries as C
from cuewright.plans import name_queries as N
from cuewright.plans import source_queries as S
from cuewright.session import cut, scratch, ship, table
from cuewright.sources import captions, documents, feeds, sinks
from cuewright.streaming import resume


def chapters_scan(spark: SparkSession, d: str) -> DataFrame:
    """Chapters out of a recording's metadata: declared spans as sections, some of them without a title of their own."""
    s = table(spark, d, "sponsors_removed").where("video_id is not null and start_ms is not null").select("video_id", "start_ms", "category").distinct()
    kind = F.pmod("start_ms", F.lit(5))
    title = F.when(kind == 0, F.concat(F.lit("<Untitled Chapter "), F.pmod("start_ms", F.lit(7)).cast("string"), F.lit(">"))).when(kind == 1, "  ").otherwise(F.concat(F.lit(" "), F.coalesce("category", F.lit("?")), F.lit(" ")))
    one = F.struct((F.col("start_ms") / 1000).alias("start_time"), title.alias("title"))
    info = s.groupBy("video_id").agg(F.to_json(F.struct(F.collect_list(one).alias("chapters"))).alias("info"))
    return cuts.chapters_of(info).distinct()


def srt_scan(spark, d):
    """SubRip files written and read again, texts and all."""
    return captions.timed_text_cues(render.srt(C._cues(spark, d))).select("video_id", "start_ms", "end_ms", F.md5(F.encode("text", "utf-8")).alias("hash"))


def rendered_srt(spark, d):
    """The renderer by the name of its form."""
    body = transcript.rendered("srt", C._cues(spark, d).limit(0), C._cues(spark, d).limit(0), C._cues(spark, d))
    return body.select("video_id", F.length("body").alias("chars"), F.md5(F.encode("body", "utf-8")).alias("hash"))


def stacked_srt(spark, d):
    """All documents as one output, in chunks."""
    return render.stacked(render.srt(C._cues(spark, d))).select("video_id", F.md5(F.encode("chunk", "utf-8")).alias("hash"))


def learned_names(spark, d):
    return resolve.learned(N._corrected(spark, d), table(spark, d, "known").where("origin = 'corpus'"))


def retry_hints(spark, d):
    found = resolve.violations(N._corrected(spark, d), table(spark, d, "recordings"))
    return transcript.retry_hints(found, table(spark, d, "known").where("origin = 'own'"))


def retry_choice(spark, d):
    """Unlabelled paragraphs as violations of a first answer, unsure ones as those of its retry."""
    labels = N._labels(spark, d)
    first = labels.groupBy("video_id").agg(F.count_if(F.col("speaker").isNull()).alias("broken"))
    second = labels.where("speaker is not null").groupBy("video_id").agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.coalesce("confidence", F.lit("low")) == "low").alias("broken"))
    return resolve.better_answer(first, second)


def _results(spark, d):
    """Results of every recording as lines of a log hold them, read with their schema."""
    v = N._judged(spark, d)
    e = F.struct("pos", "edge_id", "from_name", "to_name", "kind", "evidence", "timestamp", "confidence")
    p = F.struct("pos", "person_id", "name", "role", F.col("is_local").alias("local"))
    counts = v.groupBy("video_id").agg(F.count_if(F.col("verdict") == "rejected").alias("rejected"), F.count_if(F.col("verdict") == "irrelevant").alias("irrelevant"))
    edges = table(spark, d, "edges").groupBy("video_id").agg(F.sort_array(F.collect_list(e)).alias("edges"))
    people = N._people(spark, d).groupBy("video_id").agg(F.sort_array(F.collect_list(p)).alias("people"))
    r = table(spark, d, "recordings").where("video_id is not null").groupBy("video_id").agg(F.min("title").alias("video"))
    r = r.join(counts, "video_id", "left").join(edges, "video_id", "left").join(people, "video_id", "left")
    r = r.withColumn("failed", F.when(F.col("people").isNull(), "no people found"))
    return r.select(F.from_json(F.to_json(F.struct("*")), graph.RESULT).alias("x")).select("x.*")


def merged_edges(spark, d):
    return graph.merge_results(_results(spark, d))[1].select("video_id", "pos", "edge_id", "kind", "confidence")


def merged_failed(spark, d):
    return graph.merge_results(_results(spark, d))[2]


def merged_totals(spark, d):
    return graph.merge_results(_results(spark, d))[3]


def log_scan(spark, d):
    """A log appended to twice, with failures and lines that are no JSON: the last good result of each recording."""
    r = table(spark, d, "recordings").where("video_id is not null").groupBy("video_id").agg(F.max(F.coalesce("punctuated", F.lit(False))).alias("p"), F.max(F.coalesce("translated", F.lit(False))).alias("t"), F.max("turns").alias("turns"))
    path = scratch(spark)
    sinks.append_log(r.select("video_id", F.lit(0).alias("turns"), F.when(F.col("t"), "limit reached").alias("failed")), path)
    sinks.append_log(r.where("p").select("video_id", "turns", F.lit(None).cast("string").alias("failed")), path)
    r.select(F.concat(F.lit("{broken "), "video_id").alias("value")).write.mode("append").text(path)
    return documents.read_log(spark, path, "video_id string, turns int, failed string").select("video_id", "turns")


def graph_saved(spark, d):
    """A graph written as two tables and read again."""
    path = scratch(spark)
    sinks.write_graph(graph.merge_people(N._people(spark, d).where("video_id is not null")), table(spark, d, "edges"), path)
    m, e = spark.read.parquet(f"{path}/people"), spark.read.parquet(f"{path}/edges")
    named = e.select(T.fold(F.col("from_name")).alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("begins"))
    return m.join(named, "key", "left").select("key", "name", "videos", F.coalesce("begins", F.lit(0)).alias("begins"))


def people_saved(spark, d):
    """The confirmed people of a corpus as a file of names, read again."""
    ship(spark)
    path = scratch(spark)
    sinks.write_people(cut(resolve.confirmed(N._corrected(spark, d))), path)
    return documents.read_people(spark, path)


def files_saved(spark, d):
    """Every document as a file of a folder, the folder read again, and its transcripts found by their names."""
    ship(spark)
    folder = f"{scratch(spark)}-files"
    titles = table(spark, d, "recordings").where("video_id is not null").groupBy("video_id").agg(F.max("title").alias("title"))
    docs = S._markdown(spark, d).join(titles, "video_id").select(T.slug(F.col("title"), F.col("video_id")).alias("name"), "body")
    sinks.write_files(docs, folder, ".md")
    back = documents.read_markdown(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.size("paragraphs").alias("paragraphs"), "channel")
    return back.join(documents.transcript_index(back), F.col("name") == F.concat("stem", F.lit(".md"))).select("video_id", "stem", "channel", "paragraphs")


def notes_saved(spark, d):
    """All notes written in one call: how many files there are then, and the statistics the call gives."""
    folder = f"{scratch(spark)}-notes"
    r = table(spark, d, "recordings")
    m = cut(graph.merge_people(N._people(spark, d).where("video_id is not null")))
    e = table(spark, d, "edges").join(r.groupBy("video_id").agg(F.min("title").alias("video"), F.min("url").alias("url")), "video_id", "left")
    said = sinks.write_notes(m, e, r, folder)
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return said.withColumn("files", F.lit(files.count()).cast("long"))


def first_mentions(spark, d):
    """The first mention of each name in its recording."""
    p = N._people(spark, d).where("video_id is not null and name is not null").groupBy("video_id", "name", "pos").agg(F.min("person_id").alias("person_id"))
    return documents.first_seen(p, ["video_id"], "name", "pos").select("video_id", "name", "pos", "person_id")


def stream_resumed(spark, d):
    """Files that come in twice, some recordings with both deliveries, run by a stream that is stopped and taken up again: each recording is worked on once."""
    base = scratch(spark)
    r = table(spark, d, "recordings").where("video_id is not null").select("video_id", F.coalesce("punctuated", F.lit(False)).alias("p")).distinct()
    first, second = r.where("p").select("video_id"), r.select("video_id")
    for k, part in enumerate((first, second)):
        part.write.mode("append").json(f"{base}/in")
        resume.process_new(spark, f"{base}/in", "video_id string", f"{base}/out", f"{base}/state", lambda b: b.withColumn("failed", F.lit(None).cast("string")))
    return spark.read.parquet(f"{base}/out").select("video_id", "batch")


def _catalogue(spark, d):
    c = table(spark, d, "recordings").where("channel <> ''").select("channel").distinct()
    code = F.md5(F.encode("channel", "utf-8"))
    return c.select(F.col("channel").alias("show"), F.concat(F.lit("https://cast.invalid/"), code, F.lit("/rss")).alias("feed"), F.when(F.ascii("channel") % 2 == 0, "12345").otherwise("999").alias("apple_id"), F.col("channel").alias("rank"))


def show_search(spark, d):
    """The first five shows that hold a term: a top-k report."""
    return feeds.search(_catalogue(spark, d), "the", 5).select("show", "feed")


def feed_targets(spark, d):
    """Targets of every shape against a catalogue of shows."""
    names = table(spark, d, "recordings").where("length(channel) > 8").select(F.substring("channel", 3, 9).alias("target"))
    urls = S._urls(spark, d).where("url is not null").select(F.col("url").alias("target"))
    return feeds.resolve(names.unionByName(urls).distinct(), _catalogue(spark, d))


def newest_episode(spark, d):
    """Without a hint, the first episode in feed order."""
    return feeds.pick_episode(S.feed_scan(spark, d)).select("feed", "pos", "id", "title")


def best_episode(spark, d):
    """The episode of each feed whose title holds a hint, or is most like it."""
    return feeds.pick_episode(S.feed_scan(spark, d), "the long talk").select("feed", "pos", "id", "title")


def feed_references(spark, d):
    """A whole feed asked for."""
    return feeds.references(S.feed_scan(spark, d).withColumn("transcript_url", F.lit("")))


QUERIES = {f.__name__: f for f in (
    chapters_scan, srt_scan, rendered_srt, stacked_srt, learned_names, retry_hints, retry_choice, merged_edges, merged_failed, merged_totals, log_scan, graph_saved, people_saved, files_saved, notes_saved, first_mentions, stream_resumed, show_search, feed_targets, newest_episode, best_episode, feed_references,
)}

_CATALOGUE = "cat AS (SELECT DISTINCT channel AS sh, 'https://cast.invalid/' || md5(channel) || '/rss' AS feed, CASE WHEN unicode(channel) % 2 = 0 THEN '12345' ELSE '999' END AS apple_id FROM recordings WHERE channel <> '')"
_SRT = C.SQL["srt_files"].rsplit("\n", 1)[0]
SQL = {
    "chapters_scan": f"""WITH s AS (SELECT DISTINCT video_id, start_ms AS ms, coalesce(category, '?') AS title FROM sponsors_removed WHERE video_id IS NOT NULL AND start_ms IS NOT NULL AND ((start_ms % 5) + 5) % 5 > 1), t AS (SELECT video_id, trunc(ms::DOUBLE / 1000 * 1000)::BIGINT AS start_ms, trim(title) AS title FROM s)
SELECT DISTINCT video_id, start_ms, {C._STAMP} AS timestamp, title FROM t""",
    "srt_scan": f"WITH {C._REPAIR}, x AS (SELECT video_id, start_ms, end_ms, trim(regexp_replace(text, '<[^>]+>', '', 'g')) AS t FROM r) SELECT video_id, start_ms, end_ms, md5(t) AS hash FROM x WHERE t <> ''",
    "rendered_srt": C.SQL["srt_files"],
    "stacked_srt": f"{_SRT} SELECT video_id, md5(body || CASE WHEN video_id = (SELECT max(video_id) FROM b) THEN '' ELSE chr(10) || chr(10) END) AS hash FROM b",
    "learned_names": N._ATTRIBUTED + f""", g AS (SELECT video_id, {N._fold('speaker')} AS key FROM lab WHERE grounded AND speaker IS NOT NULL), f AS (SELECT key, min(video_id) AS video_id FROM g WHERE key NOT IN (SELECT key FROM known WHERE origin = 'corpus' AND key IS NOT NULL) GROUP BY key)
SELECT video_id, count(*) AS learned FROM f GROUP BY video_id""",
    "retry_hints": N._ATTRIBUTED + """, v AS (SELECT video_id, string_agg('- ' || detail, chr(10) ORDER BY kind, detail) AS v FROM viol GROUP BY video_id), kn AS (SELECT video_id, string_agg(name, ', ' ORDER BY name) AS k FROM (SELECT DISTINCT video_id, name FROM known WHERE origin = 'own') GROUP BY video_id)
SELECT v.video_id, 'The previous answer broke these constraints:' || chr(10) || v || coalesce(chr(10) || chr(10) || 'People this recording''s metadata names: ' || k, '') AS hint FROM v LEFT JOIN kn USING (video_id)""",
    "retry_choice": f"""WITH {N._LABELS} SELECT video_id, count(x.s) > 0 AND count(*) FILTER (x.s IS NOT NULL AND coalesce(x.c, 'low') = 'low') < count(*) FILTER (x.s IS NULL) AS use_second FROM l WHERE video_id IS NOT NULL GROUP BY video_id""",
    "merged_edges": "SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY pos, edge_id)::INTEGER AS pos, edge_id, kind, confidence FROM edges WHERE video_id IN (SELECT video_id FROM recordings)",
    "merged_failed": "SELECT video_id, min(title) AS video, 'no people found' AS why FROM recordings r WHERE video_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM people p WHERE p.video_id = r.video_id) GROUP BY video_id",
    "merged_totals": N._JUDGED + """ SELECT count(*) FILTER (verdict = 'rejected') AS rejected, count(*) FILTER (verdict = 'irrelevant') AS irrelevant,
(SELECT count(DISTINCT video_id) FROM recordings r WHERE video_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM people p WHERE p.video_id = r.video_id)) AS failed FROM verdicts WHERE video_id IN (SELECT video_id FROM recordings)""",
    "log_scan": """WITH r AS (SELECT video_id, bool_or(coalesce(punctuated, false)) AS p, bool_or(coalesce(translated, false)) AS t, max(turns) AS turns FROM recordings WHERE video_id IS NOT NULL GROUP BY video_id)
SELECT video_id, CASE WHEN p THEN turns ELSE 0 END::INTEGER AS turns FROM r WHERE p OR NOT t""",
    "graph_saved": f"WITH {N._MERGE}, b AS (SELECT {N._fold('from_name')} AS key, count(*) AS begins FROM edges GROUP BY 1) SELECT key, name, videos, coalesce(begins, 0) AS begins FROM m LEFT JOIN b USING (key)",
    "people_saved": N.SQL["confirmed"],
    "files_saved": f"""WITH m AS ({S.SQL['markdown_documents']}), s AS ({S.SQL['slugs']}), t AS (SELECT video_id, max(coalesce(title, '')) AS title FROM recordings GROUP BY video_id),
u AS (SELECT video_id, trim(left(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 60), '-') AS s FROM t)
SELECT video_id, CASE WHEN s = '' THEN video_id ELSE s || '-' || video_id END AS stem, channel, paragraphs FROM m JOIN u USING (video_id) WHERE s <> ''""",
    "notes_saved": f"WITH {N._MERGE}, {N._NOTES}, z AS ({N.SQL['note_statistics']}) SELECT z.*, (SELECT count(*) FROM nt) AS files FROM z",
    "first_mentions": "SELECT video_id, name, min(pos) AS pos, arg_min(person_id, (pos, person_id)) AS person_id FROM people WHERE video_id IS NOT NULL AND name IS NOT NULL GROUP BY video_id, name",
    "stream_resumed": "SELECT video_id, (NOT bool_or(coalesce(punctuated, false)))::INTEGER AS batch FROM recordings WHERE video_id IS NOT NULL GROUP BY video_id",
    "show_search": f"WITH {_CATALOGUE} SELECT sh AS \"show\", feed FROM cat WHERE contains(lower(sh), 'the') ORDER BY sh LIMIT 5",
    "feed_targets": f"""WITH {S._URLS}, {_CATALOGUE}, t AS (SELECT DISTINCT url FROM u WHERE url IS NOT NULL UNION SELECT substr(channel, 3, 9) FROM recordings WHERE length(channel) > 8),
h AS (SELECT url, CASE WHEN starts_with(url, 'podcast:') THEN 'reference' WHEN {S._FEEDISH} THEN 'feed' WHEN {S._APPLE} THEN 'apple' WHEN {S._STORE} THEN 'storefront' ELSE 'search' END AS how FROM t),
a AS (SELECT apple_id, arg_min(feed, sh) AS feed FROM cat GROUP BY apple_id), n AS (SELECT url, arg_min(feed, sh) AS feed FROM h JOIN cat ON how = 'search' AND trim(url) <> '' AND contains(lower(sh), lower(url)) GROUP BY url)
SELECT url AS target, how, CASE how WHEN 'reference' THEN string_split(regexp_replace(url, '^podcast:', ''), '#')[1] WHEN 'feed' THEN url WHEN 'apple' THEN (SELECT feed FROM a WHERE a.apple_id = regexp_extract(h.url, '(?i)podcasts\\.apple\\.com/.*?/id(\\d+)', 1)) WHEN 'search' THEN n.feed END AS feed FROM h LEFT JOIN n USING (url)""",
    "newest_episode": f"WITH f AS ({S.SQL['feed_scan']}) SELECT feed, pos, id, title FROM f WHERE pos = 0",
    "feed_references": f"WITH f AS ({S.SQL['feed_scan']}) SELECT feed, pos, 'podcast:' || feed || '#' || id AS reference FROM f",
}
