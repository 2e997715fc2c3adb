"""Queries over captions: cues, turns, paragraphs, subtitles, spans and chapters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.operators import cuts, render, segment
from cuewright.session import ship, table
from cuewright.sources import captions, spans


def _cues(spark: SparkSession, d: str) -> DataFrame:
    return segment.cues_of(table(spark, d, "segments"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """The cues of each recording as a json3 payload, with an append event between any two."""
    c = _cues(spark, d)
    event = F.to_json(F.struct(F.col("start_ms").alias("tStartMs"), (F.col("end_ms") - F.col("start_ms")).alias("dDurationMs"), F.array(F.struct(F.col("text").alias("utf8"))).alias("segs")))
    both = F.concat(event, F.lit(',{"tStartMs":0,"aAppend":1,"segs":[{"utf8":"\\n"}]}'))
    events = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", both.alias("e")))), lambda x: x["e"]), ",")
    return c.groupBy("video_id").agg(F.concat(F.lit('{"events":['), events, F.lit("]}")).alias("payload"))


def json3_scan(spark, d):
    return captions.json3_cues(_payloads(spark, d)).select("video_id", "start_ms", "end_ms", "text")


def vtt_scan(spark, d):
    return captions.timed_text_cues(render.vtt(_cues(spark, d))).select("video_id", "start_ms", "end_ms", F.length("text").alias("chars"))


def clean_cues(spark, d):
    return _cues(spark, d)


def cue_shape(spark, d):
    c = _cues(spark, d)
    return c.select("video_id", "seq", T.word_count(F.col("text")).alias("words"), T.stamp(F.col("start_ms")).alias("stamp"), T.subtitle_time(F.col("start_ms"), ",").alias("srt"), T.subtitle_time(F.col("end_ms"), ".").alias("vtt"), T.ends_sentence(F.col("text")).alias("ends"))


def punctuated_ratio(spark, d):
    return segment.punctuated(_cues(spark, d))


def turn_split(spark, d):
    return segment.split_turns(_cues(spark, d)).select("video_id", "seq", "part", "text", "starts_turn")


def turn_numbers(spark, d):
    return segment.number_turns(segment.split_turns(_cues(spark, d))).select("video_id", "seq", "part", "turn")


def _folded(spark, d, target):
    ship(spark)
    p = segment.paragraphs(_cues(spark, d), target=target)
    return p.select("video_id", "turn", "k", "start_ms", "cues", "words")


def paragraph_fold(spark, d):
    return _folded(spark, d, segment.TARGET_WORDS)


def paragraph_fold_short(spark, d):
    return _folded(spark, d, 40)


def cue_repair(spark, d):
    return segment.repaired(_cues(spark, d)).select("video_id", "seq", "start_ms", "end_ms")


def srt_rows(spark, d):
    return render.srt_rows(_cues(spark, d)).select("video_id", "number", "block")


def srt_files(spark, d):
    return render.srt(_cues(spark, d)).select("video_id", F.length("body").alias("chars"), F.md5(F.col("body").cast("binary")).alias("hash"))


def doc_text_join(spark, d):
    """The text of each recording out of its paragraphs in order, and its turns."""
    p = table(spark, d, "paragraphs").groupBy("video_id", "n").agg(F.min("text").alias("text"), F.min("turn").alias("turn"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ")
    return p.groupBy("video_id").agg(text.alias("t"), F.count_distinct("turn").alias("turns")).select("video_id", "turns", F.length("t").alias("chars"), F.md5(F.col("t").cast("binary")).alias("hash"))


def captions_end(spark, d):
    return _cues(spark, d).groupBy("video_id").agg(F.max_by("end_ms", "seq").alias("captions_end_ms"))


def _spans(spark, d):
    return table(spark, d, "sponsors_removed").where("category = 'sponsor' and start_ms is not null and end_ms is not null")


def sponsor_cut(spark, d):
    return cuts.cut_spans(_cues(spark, d), _spans(spark, d))[0].select("video_id", "seq")


def applied_spans(spark, d):
    return cuts.cut_spans(_cues(spark, d), _spans(spark, d))[1]


def span_payload(spark, d):
    """The declared spans through their API's payload: by hash prefix, one answer a prefix, then exact id."""
    s = table(spark, d, "sponsors_removed")
    sec = lambda c: F.coalesce((F.col(c) / 1000).cast("string"), F.lit("n/a"))
    seg = F.struct("category", F.array(sec("start_ms"), sec("end_ms")).alias("segment"))
    one = s.groupBy("video_id").agg(F.collect_list(seg).alias("segments")).select(T.hash_prefix(F.col("video_id")).alias("prefix"), F.struct(F.col("video_id").alias("videoID"), "segments").alias("e"))
    return spans.spans_of(one.groupBy("prefix").agg(F.to_json(F.collect_list("e")).alias("body")), table(spark, d, "recordings"))


def chapter_asof(spark, d):
    """Declared starts as chapters, each before the first paragraph that does not begin before it."""
    c = table(spark, d, "sponsors_removed").where("start_ms is not null").select("video_id", "start_ms", F.col("category").alias("title")).distinct()
    p = table(spark, d, "paragraphs").where("start_ms is not null").groupBy("video_id", "n").agg(F.min("start_ms").alias("start_ms"))
    return cuts.place_chapters(c, p).select("video_id", "start_ms", "title", "n")


def marker_lines(spark, d):
    p = table(spark, d, "paragraphs").groupBy("video_id", "n").agg(F.min(F.struct("turn", "speaker", "speaker_confidence")).alias("x")).select("video_id", "n", "x.*")
    return segment.turn_markers(p).select("video_id", "n", "marker")


def ngram_repetition(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.repetition(F.col("text")), 6).alias("repetition"))


QUERIES = {f.__name__: f for f in (
    paragraph_fold, paragraph_fold_short, json3_scan, vtt_scan, clean_cues, cue_shape, punctuated_ratio, turn_split, turn_numbers, cue_repair, srt_rows, srt_files, doc_text_join, captions_end, sponsor_cut, applied_spans,
    span_payload, chapter_asof, marker_lines, ngram_repetition,
)}

# What SQL calls white space here: RE2's own is ASCII only.
_WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}]"
_CUES = f"""c0 AS (SELECT video_id, seq, start_ms, end_ms, trim(regexp_replace(translate(text, chr(8209) || chr(8208) || chr(160) || chr(8203), '-- '), '{_WS}+', ' ', 'g')) AS text FROM segments
           WHERE video_id IS NOT NULL AND seq IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL),
c AS (SELECT video_id, seq, min(start_ms) AS start_ms, min_by(end_ms, start_ms) AS end_ms, min_by(text, start_ms) AS text FROM c0 WHERE text <> '' GROUP BY video_id, seq)"""
_ENDS = r"""regexp_matches(text, '[.!?]["'')\]]?\s*$')"""
_REPAIR = f"{_CUES}, r AS (SELECT video_id, seq, start_ms, greatest(least(end_ms, coalesce(lead(start_ms) OVER (PARTITION BY video_id ORDER BY seq), end_ms)), start_ms + 1) AS end_ms, text FROM c)"


def _clock(c: str, point: str) -> str:
    c = f"greatest({c}, 0)"
    return f"printf('%02d:%02d:%02d{point}%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"


_STAMP = "CASE WHEN start_ms >= 3600000 THEN printf('%d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) ELSE printf('%02d:%02d', start_ms // 60000, start_ms // 1000 % 60) END"
_PARTS = f"""{_CUES}, s AS (SELECT *, string_split_regex(text, '>{{2,}}') AS ps FROM c),
q AS (SELECT *, trim(ps[1]) = '' AS lead, list_filter(list_transform(ps, lambda x: trim(x)), lambda x: x <> '') AS full_ FROM s),
t AS (SELECT video_id, seq, start_ms, end_ms, lead, unnest(range(1, len(full_) + 1)) AS part, unnest(full_) AS text FROM q),
parts AS (SELECT video_id, seq, part::INTEGER AS part, start_ms, end_ms, text, (lead OR part > 1) AS starts_turn FROM t),
turns AS (SELECT *, sum(starts_turn::INTEGER) OVER (PARTITION BY video_id ORDER BY seq, part ROWS UNBOUNDED PRECEDING)::BIGINT AS turn FROM parts)"""


def _fold_sql(target: int) -> str:
    return rf"""WITH RECURSIVE {_PARTS}, flags AS (SELECT video_id, avg({_ENDS}::INTEGER) >= 0.05 AS p FROM c GROUP BY video_id),
o AS (SELECT turns.video_id, turn, row_number() OVER (PARTITION BY turns.video_id, turn ORDER BY seq, part) AS i, start_ms, end_ms, text, p, len(list_filter(string_split_regex(text, ' +'), lambda x: x <> '')) AS w, {_ENDS} AS ends
      FROM turns JOIN flags USING (video_id)),
f AS (SELECT video_id, turn, i, end_ms, 1 AS k, start_ms AS s, w AS words, w AS open, 1 AS n,
             (p AND w >= {target} AND ends) OR w >= (CASE WHEN p THEN {2 * target} ELSE {target} END) AS shut, text FROM o WHERE i = 1
      UNION ALL
      SELECT o.video_id, o.turn, o.i, o.end_ms, f.k + b.b::INTEGER, CASE WHEN b.b THEN o.start_ms ELSE f.s END, CASE WHEN b.b THEN o.w ELSE f.words + o.w END, o.w, CASE WHEN b.b THEN 1 ELSE f.n + 1 END,
             (p AND (CASE WHEN b.b THEN o.w ELSE f.words + o.w END) >= {target} AND o.ends) OR (CASE WHEN b.b THEN o.w ELSE f.words + o.w END) >= (CASE WHEN p THEN {2 * target} ELSE {target} END), CASE WHEN b.b THEN o.text ELSE f.text || ' ' || o.text END
      FROM f JOIN o ON o.video_id = f.video_id AND o.turn = f.turn AND o.i = f.i + 1, LATERAL (SELECT f.shut OR (f.words >= 25 AND o.start_ms - f.end_ms >= 2000) AS b) b)
SELECT video_id, turn, k::INTEGER AS k, max_by(s, i) AS start_ms, max(n)::INTEGER AS cues, max_by(words, i)::INTEGER AS words FROM f GROUP BY video_id, turn, k
HAVING NOT regexp_full_match(max_by(text, i), '(\[[^\]]*\]|\s)+')"""


_SPONSORS = "sp AS (SELECT DISTINCT video_id, start_ms AS a, end_ms AS z FROM sponsors_removed WHERE category = 'sponsor' AND video_id IS NOT NULL AND end_ms > start_ms)"
_HITS = f"""{_CUES}, {_SPONSORS}, m AS (SELECT c.video_id, seq, min(struct_pack(a := a, z := z)) AS h FROM c JOIN sp ON sp.video_id = c.video_id AND a <= floor((start_ms + end_ms) / 2.0) AND floor((start_ms + end_ms) / 2.0) < z GROUP BY c.video_id, seq),
j AS (SELECT c.video_id, c.seq, h FROM c LEFT JOIN m USING (video_id, seq)), g AS (SELECT video_id, count(*) - count(h) >= count(*) * 0.5 AS sane FROM j GROUP BY video_id)"""



def _transcript_sql(select: str) -> str:
    """Paragraphs (pf) and facts out of cues that spans have cut: the fold as above, of the cues that stay."""
    chain = re.sub(r"\bc\b", "ca", _HITS) + ", c AS (SELECT ca.* FROM ca JOIN j USING (video_id, seq) JOIN g USING (video_id) WHERE h IS NULL OR NOT sane)"
    fold = _fold_sql(110).replace(_CUES, chain)
    head, tail = fold.split("\nSELECT video_id, turn, k::INTEGER AS k")
    having = tail[tail.index("HAVING") :]
    return f"{head}, pf AS (SELECT video_id, turn, k, max_by(s, i) AS start_ms, max_by(text, i) AS text FROM f GROUP BY video_id, turn, k {having}) {select}"


TRANSCRIPTS = {
    "transcript_paragraphs": _transcript_sql(f"SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY turn, k)::INTEGER AS n, start_ms, {_STAMP} AS timestamp, turn, text FROM pf"),
    "transcript_facts": _transcript_sql("""SELECT video_id, coalesce(p, false) AS punctuated, coalesce(n, 0) AS turns, coalesce(z, 0) AS captions_end_ms, CASE WHEN coalesce(duration_ms, 0) > 0 THEN duration_ms ELSE coalesce(z, 0) END AS duration_ms
FROM (SELECT video_id, max(duration_ms) AS duration_ms FROM recordings GROUP BY video_id) LEFT JOIN flags USING (video_id) LEFT JOIN (SELECT video_id, arg_max(end_ms, seq) AS z FROM c GROUP BY video_id) USING (video_id)
LEFT JOIN (SELECT video_id, count(DISTINCT turn) AS n FROM pf GROUP BY video_id) USING (video_id)"""),
}
SQL = {
    "paragraph_fold": _fold_sql(110),
    "paragraph_fold_short": _fold_sql(40),
    "json3_scan": f"WITH {_CUES} SELECT video_id, start_ms, end_ms, text FROM c",
    "clean_cues": f"WITH {_CUES} SELECT video_id, seq, start_ms, end_ms, text FROM c",
    "cue_shape": f"WITH {_CUES} SELECT video_id, seq, len(list_filter(string_split(text, ' '), lambda x: x <> ''))::INTEGER AS words, {_STAMP} AS stamp, {_clock('start_ms', ',')} AS srt, {_clock('end_ms', '.')} AS vtt, {_ENDS} AS ends FROM c",
    "punctuated_ratio": f"WITH {_CUES} SELECT video_id, avg({_ENDS}::INTEGER) >= 0.05 AS punctuated FROM c GROUP BY video_id",
    "turn_split": f"WITH {_PARTS} SELECT video_id, seq, part, text, starts_turn FROM parts",
    "turn_numbers": f"WITH {_PARTS} SELECT video_id, seq, part, turn FROM turns",
    "cue_repair": f"WITH {_REPAIR} SELECT video_id, seq, start_ms, end_ms FROM r",
    "srt_rows": f"""WITH {_REPAIR}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS k FROM r)
SELECT video_id, k::INTEGER AS number, k || chr(10) || {_clock('start_ms', ',')} || ' --> ' || {_clock('end_ms', ',')} || chr(10) || text || chr(10) AS block FROM n""",
    "srt_files": f"""WITH {_REPAIR}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS k FROM r),
b AS (SELECT video_id, string_agg(k || chr(10) || {_clock('start_ms', ',')} || ' --> ' || {_clock('end_ms', ',')} || chr(10) || text || chr(10), chr(10) ORDER BY k) AS body FROM n GROUP BY video_id)
SELECT video_id, length(body)::INTEGER AS chars, md5(body) AS hash FROM b""",
    "vtt_scan": f"WITH {_REPAIR}, x AS (SELECT video_id, start_ms, end_ms, trim(regexp_replace(text, '<[^>]+>', '', 'g')) AS t FROM r) SELECT video_id, start_ms, end_ms, length(t)::INTEGER AS chars FROM x WHERE t <> ''",
    "doc_text_join": """WITH p AS (SELECT video_id, n, min(text) AS text, min(turn) AS turn FROM paragraphs GROUP BY video_id, n), t AS (SELECT video_id, string_agg(text, ' ' ORDER BY n) AS t, count(DISTINCT turn) AS turns FROM p GROUP BY video_id)
SELECT video_id, turns, length(t)::INTEGER AS chars, md5(t) AS hash FROM t""",
    "captions_end": f"WITH {_CUES} SELECT video_id, arg_max(end_ms, seq) AS captions_end_ms FROM c GROUP BY video_id",
    "sponsor_cut": f"WITH {_HITS} SELECT video_id, seq FROM j JOIN g USING (video_id) WHERE h IS NULL OR NOT sane",
    "applied_spans": f"WITH {_HITS} SELECT DISTINCT video_id, h.a AS start_ms, h.z AS end_ms FROM j JOIN g USING (video_id) WHERE h IS NOT NULL AND sane",
    "span_payload": "SELECT DISTINCT video_id, trunc(start_ms::DOUBLE / 1000 * 1000)::BIGINT AS start_ms, trunc(end_ms::DOUBLE / 1000 * 1000)::BIGINT AS end_ms FROM sponsors_removed s WHERE category = 'sponsor' AND end_ms > start_ms AND EXISTS (SELECT 1 FROM recordings r WHERE r.video_id = s.video_id)",
    "chapter_asof": """WITH ch AS (SELECT DISTINCT video_id, start_ms, category AS title FROM sponsors_removed WHERE start_ms IS NOT NULL), p AS (SELECT video_id, n, min(start_ms) AS at_ms FROM paragraphs WHERE start_ms IS NOT NULL GROUP BY video_id, n)
SELECT ch.video_id, ch.start_ms, title, min(struct_pack(at_ms := at_ms, n := n)).n AS n FROM ch JOIN p ON p.video_id = ch.video_id AND at_ms >= ch.start_ms GROUP BY ch.video_id, ch.start_ms, title""",
    "marker_lines": """WITH p0 AS (SELECT DISTINCT video_id, n, turn, speaker, speaker_confidence FROM paragraphs), p AS (SELECT *, nullif(speaker, '') AS named FROM p0),
w AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, lag(turn) OVER (PARTITION BY video_id ORDER BY n) AS before FROM p)
SELECT video_id, n, CASE WHEN named IS NOT NULL THEN CASE WHEN last = named THEN '' ELSE '**' || named || CASE WHEN speaker_confidence = 'low' THEN '?**: ' ELSE '**: ' END END
       WHEN before IS NOT NULL AND before IS DISTINCT FROM turn THEN '>> ' ELSE '' END AS marker FROM w""",
    "ngram_repetition": f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{_WS}+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM w)
SELECT doc_id, CASE WHEN len(w) < 3 THEN 0.0::DOUBLE ELSE round(1 - len(list_distinct(g))::DOUBLE / len(g), 6) END AS repetition FROM g""",
}
