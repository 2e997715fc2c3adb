"""Operators of the core on small tables, edge cases included."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cuewright.operators import cuts, graph, intervals, render, resolve, scan, segment, tracks
from cuewright.session import ship
from cuewright.sources import captions, documents, feeds, spans
from cuewright.streaming import resume

CUE = "video_id string, seq long, start_ms long, end_ms long, text string"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.mark.parametrize("seed", range(3))
def test_scans_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice(["a", "b", None]), i, rng.choice([None, rng.randrange(9)])) for i in range(200)]
    d = spark.createDataFrame(data, "k string, o int, v int").withColumn("b", F.floor(F.col("o") / 7))
    got = scan.last_value(scan.running_sum(d, ["k"], "b", ["o"], F.col("v"), "s"), ["k"], "b", ["o"], F.col("v"), "l", before=True)
    s, last, want = {}, {}, []
    for k, o, v in data:
        s[k] = s.get(k, 0) + (v or 0)
        want.append((o, s[k], last.get(k)))
        last[k] = v if v is not None else last.get(k)
    assert sorted((r.o, r.s, r.l) for r in got.collect()) == want


def plain_periods(spans_):
    out, at = [], None
    for a, z in sorted(spans_):
        if at and a <= at[1]:
            at[1] = max(at[1], z)
        else:
            at = [a, z]
            out.append(at)
    return [("period", *p) for p in out] + [("gap", p[1], q[0]) for p, q in zip(out, out[1:])]


@pytest.mark.parametrize("bucket", [1, 10, 1000])
def test_periods(spark, bucket):
    rng = random.Random(bucket)
    data = [(rng.choice(["a", "b", None]), a, a + rng.choice([-5, 0, 1, 3, 40])) for a in (rng.randrange(300) for _ in range(120))]
    df = spark.createDataFrame([*data, *data[:20], ("c", None, 4), ("c", 4, None)], "video_id string, start_ms long, end_ms long").withColumn("what", F.lit("x")).withColumn("__s", F.lit(1))
    want = []
    for k in ("a", "b", None):
        want += [(k or "", *p) for p in plain_periods({(a, z) for v, a, z in data if v == k and z > a})]
    got = sorted((r.video_id or "", r.what, r.start_ms, r.end_ms) for r in intervals.periods_and_gaps(df, ["video_id"], "start_ms", "end_ms", bucket).collect())
    assert got == sorted(want)
    assert intervals.periods_and_gaps(df.limit(0), ["video_id"], "start_ms", "end_ms").collect() == []


def cues(spark, *texts, gap=0, each=1000):
    return spark.createDataFrame([("a", i, i * each, i * each + each - gap, t) for i, t in enumerate(texts)], CUE)


def test_split_turns(spark):
    got = rows(segment.number_turns(segment.split_turns(cues(spark, ">> hi", "so >>> yes >> no", "more"))), "seq", "part", "text", "starts_turn", "turn")
    assert got == [(0, 1, "hi", True, 1), (1, 1, "so", False, 1), (1, 2, "yes", True, 2), (1, 3, "no", True, 3), (2, 1, "more", False, 3)]


def paragraphs(spark, c, **kw):
    ship(spark)
    return rows(segment.paragraphs(c, **kw), "turn", "k", "start_ms", "cues", "words")


def test_three_turns(spark):
    assert paragraphs(spark, cues(spark, ">> one", ">> two", ">> three")) == [(1, 1, 0, 1, 1), (2, 1, 1000, 1, 1), (3, 1, 2000, 1, 1)]


def test_silence_parts_from_25_words(spark):
    long, short = "word " * 30, "word"
    assert len(paragraphs(spark, spark.createDataFrame([("a", 0, 0, 1000, long), ("a", 1, 8000, 9000, long)], CUE))) == 2
    assert len(paragraphs(spark, spark.createDataFrame([("a", 0, 0, 1000, short), ("a", 1, 9000, 9500, short)], CUE))) == 1


def test_caps(spark):
    ten = "w " * 9 + "w"
    assert all(p[4] <= 60 for p in paragraphs(spark, cues(spark, *[ten] * 30), target=50))
    ended = [ten] * 4 + [ten + "."] + [ten] * 10
    assert paragraphs(spark, cues(spark, *ended), target=30)[0][4] == 50
    flags = spark.createDataFrame([("a", True)], "video_id string, punctuated boolean")
    assert paragraphs(spark, cues(spark, *[ten] * 12), is_punctuated=flags, target=30)[0][4] == 60
    assert paragraphs(spark, cues(spark, *["w"] * 30), target=1)[0][4] == 25
    assert paragraphs(spark, cues(spark, "[music]", ">> [x] [y]")) == [] and paragraphs(spark, cues(spark, "x").limit(0)) == []


def test_punctuated(spark):
    assert rows(segment.punctuated(cues(spark, *["open"] * 19, "Shut.")))[0][1] is True and rows(segment.punctuated(cues(spark, *["open"] * 20)))[0][1] is False


def test_repaired(spark):
    c = spark.createDataFrame([("a", 1, 0, 900, "x"), ("a", 2, 500, 500, "y"), ("a", 9000, 700, 600, "z")], CUE)
    assert rows(segment.repaired(c), "seq", "start_ms", "end_ms") == [(1, 0, 500), (2, 500, 501), (9000, 700, 701)]


def test_cut_spans(spark):
    c = cues(spark, *"abcdef")
    s = spark.createDataFrame([("a", 0, 1600), ("a", 0, 900), ("a", 90_000, 99_000), ("b", 0, 9), ("a", 5, 5), ("a", None, 3)], "video_id string, start_ms long, end_ms long")
    kept, applied = cuts.cut_spans(c, s)
    assert [r[0] for r in rows(kept, "seq")] == [2, 3, 4, 5] and rows(applied) == [("a", 0, 900), ("a", 0, 1600)]
    all_ = spark.createDataFrame([("a", 0, 10**6)], s.schema)
    assert cuts.cut_spans(c, all_)[0].count() == 6 and cuts.cut_spans(c, all_)[1].count() == 0
    half = spark.createDataFrame([("a", 0, 3000)], s.schema)
    assert cuts.cut_spans(c, half)[0].count() == 3


def test_chapters(spark):
    p = spark.createDataFrame([("a", 1, 0), ("a", 2, 5000), ("a", 3, 9_000_000), ("b", 1, 0)], "video_id string, n int, start_ms long")
    c = spark.createDataFrame([("a", 0, "in"), ("a", 1, "x"), ("a", 5000, "at"), ("a", 5001, "far"), ("a", 10**8, "gone")], "video_id string, start_ms long, title string")
    assert rows(cuts.place_chapters(c, p), "title", "n") == [("at", 2), ("far", 3), ("in", 1), ("x", 2)]


def test_markers(spark):
    p = spark.createDataFrame([("a", 1, 1, "Ann", None), ("a", 2, 1, None, None), ("a", 3, 1, "Ann", "high"), ("a", 4, 2, "Bo", "low"), ("a", 5, 3, "", None), ("a", 6, 3, None, None)], "video_id string, n int, turn int, speaker string, speaker_confidence string")
    assert [r[1] for r in rows(segment.turn_markers(p), "n", "marker")] == ["**Ann**: ", "", "", "**Bo?**: ", ">> ", ""]


def known(spark, *names, v="a"):
    from cuewright.functions.text import fold

    return spark.createDataFrame([(v, n) for n in names], "video_id string, name string").withColumn("key", fold(F.col("name")))


@pytest.mark.parametrize("claim,name,stage", [
    ("tom o'neill", "Tom O'Neill", 1), ("Tom O'Neil", "Tom O'Neill", 2), ("Dr. Daniel Sheehan", "Daniel Peter Sheehan", 3), ("O'Neill", "Tom O'Neill", 4), ("Sheehn", "Daniel Peter Sheehan", 4), ("Tim O'Neill", "Tim O'Neill", None),
    ("Nobody", "Nobody", None), ("Smith", "Smith", None), ("", "", None),
])
def test_canonicalise(spark, claim, name, stage):
    ship(spark)
    k = known(spark, "Tom O'Neill", "Daniel Peter Sheehan", "Ann Smith", "Bob Smith")
    got = resolve.canonicalise(spark.createDataFrame([("a", claim), (None, claim), ("a", None)], "video_id string, claimed string"), k).where("video_id = 'a'").collect()
    assert [(r.name, r.stage, r.grounded) for r in got] == [(name, stage, stage is not None)]


def test_known_people(spark):
    r = spark.createDataFrame([("a", "Some Host", "Story — Ann Lee", "Here is Ann  Lee and Bo Carter."), ("b", None, None, None)], "video_id string, channel string, title string, description string")
    corpus = spark.createDataFrame([("a", "ann lee", "ANN LEE"), ("a", "cy dole", "Cy Dole")], "video_id string, key string, name string")
    assert rows(resolve.known_people(r, corpus), "key", "name", "origin") == [("ann lee", "Ann  Lee", "own"), ("bo carter", "Bo Carter", "own"), ("cy dole", "Cy Dole", "corpus"), ("some host", "Some Host", "own")]


def test_violations(spark):
    ship(spark)
    labels = [("a", i, s, "high") for i, s in enumerate(["tom oneil", "Tom O'Neill", "Ghost", None, "Max Host", "A B", "C D", "E F"], 1)] + [("b", i, "Tom O'Neill" if i == 1 else None, "high") for i in range(1, 5)]
    df = spark.createDataFrame(labels, "video_id string, n int, speaker string, confidence string")
    k = known(spark, "Tom O'Neill").unionByName(known(spark, "Tom O'Neill", v="b"))
    c = resolve.corrected(df, resolve.canonicalise(df.select("video_id", F.col("speaker").alias("claimed")), k))
    got = {(r.video_id, r.kind): r for r in resolve.violations(c, spark.createDataFrame([("a", "Uncle Host"), ("b", "Show")], "video_id string, channel string")).collect()}
    assert {x for _, x in got} == {"ungrounded_speaker", "spelling_variants", "host_guest_conflict", "many_speakers", "sparse_coverage"}
    assert ("b", "sparse_coverage") in got and ("a", "many_speakers") in got and c.where("speaker = 'Ghost' and confidence = 'low'").count() == 1
    assert rows(resolve.confirmed(c)) == [("tom oneill", "Tom O'Neill")]
    one = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "video_id string, broken int")
    two = spark.createDataFrame([("a", 5, 2), ("b", 5, 2), ("c", 0, 0)], "video_id string, labels int, broken int")
    assert rows(resolve.better_answer(one, two)) == [("a", True), ("b", False), ("c", False)]


def test_labels_by_absolute_number(spark):
    p = spark.createDataFrame([("a", n) for n in range(1, 83)], "video_id string, n int")
    r = spark.createDataFrame([("a", 0, [(1, "A", "high"), (1, "B", None), (0, "X", None), (41, "X", None)]), ("a", 2, [(82, "C", "low"), (99, "X", None)])], "video_id string, batch int, labels array<struct<n:int,speaker:string,confidence:string>>")
    assert rows(resolve.labels_of(r, p).where("speaker is not null")) == [("a", 1, "B", "low"), ("a", 82, "C", "low")]


@pytest.mark.parametrize("evidence,real", [("We MET, Dex Horthy at noon", True), ("met Dex Horthy", False), ("we met Horthy Dex at", False), ("", False), (None, False)])
def test_quotes(spark, evidence, real):
    d = spark.createDataFrame([(evidence, "Then we met Dex Horthy, at noon.")], "e string, t string")
    assert d.select(F.coalesce(graph.quote_is_real(F.col("e"), F.col("t")), F.lit(False))).first()[0] is real


def test_judge_edges(spark):
    ship(spark)
    e = [("a", 1, "Ann Lee", "Bo Carter", "cites", "then ann lee told us"), ("a", 2, "Ann Lee", "Bo Carter", "likes", "then ann lee told us"), ("a", 3, "Ann Lee", "Bo Carter", "cites", "never said at all here"), ("a", 4, "Cy Dole", "Bo Carter", "cites", "then ann lee told us"),
         ("a", 5, "Ann Lee", "ann lee", "cites", "then ann lee told us"), ("a", 6, "Ann Lee", "The Show", "cites", "then ann lee told us"), ("a", 7, "Ann Horthy", None, "cites", "then ann lee told us"), ("a", 8, "Zed Horthyy", "Bo Carter", "cites", "and horthy spoke to everyone")]
    df = spark.createDataFrame(e, "video_id string, pos int, from_name string, to_name string, kind string, evidence string")
    t = spark.createDataFrame([("a", "Well, then Ann Lee told us. And Horthy spoke to everyone.")], "video_id string, text string")
    r = spark.createDataFrame([("a", "The Show")], "video_id string, channel string")
    none = spark.createDataFrame([], "video_id string, claimed string, name string")
    assert [x[1] for x in rows(graph.judge_edges(df, t, r, none), "pos", "verdict")] == ["kept", "malformed", "rejected", "irrelevant", "self", "channel", "malformed", "kept"]


def test_merge(spark):
    p = [("v1", 0, "Ann Lee", "host", False), ("v1", 1, "ann  lee", "guest", False), ("v2", 0, "ANN LEE", "host", False), ("v1", 2, "Max", "x", True), ("v2", 1, "Max", "", True), ("v2", 2, None, "x", False)]
    got = {r.key: r for r in graph.merge_people(spark.createDataFrame(p, "video_id string, pos int, name string, role string, is_local boolean")).collect()}
    assert set(got) == {"ann lee", "max@v1", "max@v2"} and got["ann lee"].name == "ann  lee" and got["ann lee"].roles == ["host", "guest"] and got["ann lee"].videos == 2 and got["ann lee"].appears_in == ["v1", "v2"]
    t = spark.createDataFrame([(1, None, None), (None, 2, "bad")], "rejected int, irrelevant int, failed string")
    assert rows(graph.totals(t)) == [(1, 2, 1)] and rows(graph.totals(t.limit(0))) == [(0, 0, 0)]


def test_notes(spark):
    p = graph.merge_people(spark.createDataFrame([("v1", 0, "Ann Lee", "host", False), ("v1", 1, "Bo/Carter X", "", False), ("v1", 2, "Max", "", True), ("v1", 3, "Bo:Carter X", "", False)], "video_id string, pos int, name string, role string, is_local boolean"))
    e = spark.createDataFrame([(1, "v1", 0, "Ann Lee", "Bo/Carter X", "interviewed", "so it was", "00:10", "high", "Talk", "https://x.invalid/?v=abcdefghijk"), (2, "v1", 1, "Max", "Ann Lee", "cites", "", None, "low", "Talk", "")],
                              "edge_id int, video_id string, pos int, from_name string, to_name string, kind string, evidence string, timestamp string, confidence string, video string, url string")
    r = spark.createDataFrame([("v1", "Talk")], "video_id string, title string")
    notes = {x.key: x for x in render.person_notes(p, e, r, weights=True).collect()}
    body = notes["ann lee"].body
    assert "- interviewed [[Bo-Carter X]]::3\n  > so it was\n  — [00:10](https://x.invalid/?v=abcdefghijk) in Talk" in body and "- is cited by [[Max (Talk)|Max]]::1" in body and "## Possible connections" in body and body.endswith("## Appears in\n\n- Talk\n")
    assert "max@v1" not in notes and len({x.file for x in notes.values()}) == len(notes)


def test_a_target_may_begin_inside_a_word(spark):
    cat = spark.createDataFrame([("Broadcast News", "f1", 1, 2), ("Podcast News Now", "f2", 2, 1), ("Chk (!!!)", "f3", 3, 3), (None, "f4", 4, 0)], "show string, feed string, apple_id long, rank int")
    t = spark.createDataFrame([("cast news",), ("ROADCAST NEWS",), ("oa",), ("!!!",), ("cast new now",), (" ",)], "target string")
    assert {r.target: r.feed for r in feeds.resolve(t, cat).collect()} == {"cast news": "f2", "ROADCAST NEWS": "f1", "oa": "f1", "!!!": "f3", "cast new now": None, " ": None}


def test_markdown_round_trip(spark):
    r = spark.createDataFrame([("abcdefghijk", "A: title", "Chan", "2024-01-02", "", "https://x.invalid/a", "whisper", "en", False, True, 2)], "video_id string, title string, channel string, upload_date string, description string, url string, source string, lang string, translated boolean, punctuated boolean, turns int")
    p = spark.createDataFrame([("abcdefghijk", 1, 0, "00:00", 1, "Hello.", "Ann", "low"), ("abcdefghijk", 2, 70_000, "01:10", 2, "Bye.", None, None), ("abcdefghijk", 3, 90_000, "01:30", 3, "End.", None, None)], "video_id string, n int, start_ms long, timestamp string, turn int, text string, speaker string, speaker_confidence string")
    c = spark.createDataFrame([("abcdefghijk", 60_000, "Part two")], "video_id string, start_ms long, title string")
    body = render.markdown(r, p, c).first().body
    assert "**Ann?**: Hello.\n\n## Part two\n\n[01:10](https://x.invalid/a#t=70) >> Bye." in body and "note: no transcript is published" in body and body.startswith("---\ntitle: A: title\nchannel: Chan\npublished: 2024-01-02\n")
    back = documents.parse_markdown(spark.createDataFrame([("f.md", body)], "path string, raw string")).first()
    assert back.title == "A: title" and [x.text for x in back.paragraphs] == ["Hello.", "Bye.", "End."] and back.text == "Hello. Bye. End."


def test_markdown_keeps_paragraphs_without_a_start(spark):
    r = spark.createDataFrame([("abcdefghijk", "T", "", "", "", "https://x.invalid/a", "auto", "en", False, True, 1)], "video_id string, title string, channel string, upload_date string, description string, url string, source string, lang string, translated boolean, punctuated boolean, turns int")
    times = [(0, None), (None, "00:01:02,500"), (None, "[1:03]"), (None, "1m04s"), (None, "--:--"), (None, None)]
    p = spark.createDataFrame([("abcdefghijk", n, ms, at, 1, f"text {n}", None, None) for n, (ms, at) in enumerate(times)], "video_id string, n int, start_ms long, timestamp string, turn int, text string, speaker string, speaker_confidence string")
    read = lambda body: [(x.timestamp, x.url, x.text) for x in documents.parse_markdown(spark.createDataFrame([("f.md", body)], "path string, raw string")).first().paragraphs]
    want = [("00:00", 0), ("01:02", 62), ("01:03", 63), ("01:04", 64), ("00:00", 0), ("00:00", 0)]
    assert read(render.markdown(r, p).first().body) == [(at, f"https://x.invalid/a#t={s}", f"text {n}") for n, (at, s) in enumerate(want)]
    assert read("---\n---\n\n[00:01:02,500](u) a\n\n[[1:03]](u) b\n\n[1h02m03s](u) c\n\n[](u) d\n\n[more](u) e\n") == [("00:01:02,500", "u", "a"), ("1:03", "u", "b"), ("1h02m03s", "u", "c"), ("", "u", "d")]


def test_subtitles(spark):
    c = spark.createDataFrame([("a", 1, 0, 900, "x"), ("a", 2, 500, 1500, "<i>y</i>")], CUE)
    assert render.srt(c).first().body == "1\n00:00:00,000 --> 00:00:00,500\nx\n\n2\n00:00:00,500 --> 00:00:01,500\n<i>y</i>\n"
    assert rows(captions.timed_text_cues(render.vtt(c)), "start_ms", "end_ms", "text") == [(0, 500, "x"), (500, 1500, "y")]
    odd = spark.createDataFrame([("a", "WEBVTT\r\n\r\n01:02.500 --> 01:04.000 align:start\r\nHi\r\nthere\r\n\r\n00:00:05,000 --> 00:00:06,000\r\n<b></b>\r\n"), ("b", None), ("c", "junk")], "video_id string, body string")
    assert rows(captions.timed_text_cues(odd), "video_id", "start_ms", "end_ms", "text") == [("a", 62500, 64000, "Hi\nthere")]


def test_json3(spark):
    events = [{"tStartMs": 1500, "dDurationMs": 700, "segs": [{"utf8": "real‑"}, {"utf8": "time\n"}]}, {"aAppend": 1, "segs": [{"utf8": "no"}]}, {"tStartMs": 9}, {"tStartMs": 5, "segs": [{"utf8": " \n"}]}, {"tStartMs": 7, "segs": [{"utf8": "x"}, {}]}]
    d = spark.createDataFrame([("a", json.dumps({"events": events})), ("b", ""), ("c", '{"events": [{'), ("d", "{}"), ("e", None)], "video_id string, payload string")
    assert rows(captions.json3_cues(d), "video_id", "start_ms", "end_ms", "text") == [("a", 7, 7, "x"), ("a", 1500, 2200, "real-time")]
    assert dict(rows(captions.payload_errors(d))) == {"a": None, "b": "empty", "c": "not json3", "d": None, "e": "empty"}


def test_span_payload(spark):
    body = json.dumps([{"videoID": "abc", "segments": [{"category": "sponsor", "segment": [1.5, "2.25"]}, {"category": "intro", "segment": [0, 9]}, {"category": "sponsor", "segment": [3]}, {"category": "sponsor", "segment": [5, 4]}, {"category": "sponsor", "segment": ["x", None]}]}, {"videoID": "other", "segments": [{"category": "sponsor", "segment": [0, 1]}]}])
    d = spark.createDataFrame([("ba78", body), ("ba78", "junk"), ("0000", body)], "prefix string, body string")
    assert rows(spans.spans_of(d, spark.createDataFrame([("abc",), (None,), ("",)], "video_id string"))) == [("abc", 1500, 2250)]


def test_feed(spark):
    ship(spark)
    item = '<item><title>One &amp;amp; two</title><guid>g1</guid><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;Hi&lt;/p&gt;</description><itunes:duration>37:00</itunes:duration><enclosure url="https://a.invalid/1.mp3"/><podcast:transcript url="https://a.invalid/1.vtt"/></item><item><title>Bare</title></item>'
    body = f'<rss xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:podcast="https://podcastindex.org/namespace/1.0"><channel><title>Show</title>{item}</channel></rss>'
    d = spark.createDataFrame([("f", body), ("bad", "no feed"), ("none", None)], "feed string, body string")
    got = feeds.episodes(d).orderBy("pos").collect()
    assert [(r.feed, r.title, r.duration_s, r.published, r.description, r.transcript_url) for r in got] == [("f", "One & two", 2220, "2024-03-05", "Hi", "https://a.invalid/1.vtt"), ("f", "Bare", 0, "", "", "")]
    assert got[0].id == "".join(__import__("hashlib").sha1(b"g1").hexdigest()[:11]) and feeds.playable(feeds.episodes(d)).count() == 1


def test_pick_episode(spark):
    ship(spark)
    e = spark.createDataFrame([("f", 0, "Newest"), ("f", 1, "The long road home"), ("f", 2, "A short walk")], "feed string, pos int, title string")
    pick = lambda h: [r.title for r in feeds.pick_episode(e, h).collect()]
    assert pick(None) == ["Newest"] and pick("road") == ["The long road home"] and pick("a shrt wlak") == ["A short walk"] and pick("zzzzqq") == []


def test_resolve_targets(spark):
    cat = spark.createDataFrame([("My Big Show", "https://f.invalid/1", 12, 1), ("Big Show Two", "https://f.invalid/2", 13, 2), ("Gone", "", 14, 3)], "show string, feed string, apple_id long, rank int")
    t = spark.createDataFrame([(x,) for x in ("big show", "podcast:https://z.invalid/rss#1", "https://podcasts.apple.com/us/podcast/id13", "https://open.spotify.com/show/1", "nothing")], "target string")
    assert [(r.target, r.feed) for r in feeds.resolve(t, cat).orderBy("target").collect()] == [("big show", "https://f.invalid/1"), ("https://open.spotify.com/show/1", None), ("https://podcasts.apple.com/us/podcast/id13", "https://f.invalid/2"), ("nothing", None), ("podcast:https://z.invalid/rss#1", "https://z.invalid/rss")]
    assert feeds.search(cat, "show", 1).count() == 1


@pytest.mark.parametrize("listed,language,want,got", [
    ([("manual", "en"), ("auto", "en")], "en", None, ("manual", "en", False)), ([("auto", "en"), ("auto", "de")], "de", None, ("auto", "de", False)), ([("auto", "en-x1"), ("auto", "en-orig")], "en", None, ("auto", "en-orig", False)),
    ([("manual", "de"), ("auto", "en")], "de", None, ("manual", "de", False)), ([("auto", "en")], "de", None, ("auto", "en", True)), ([("manual", "en"), ("auto", "de")], "de", "auto", ("auto", "de", False)), ([("auto", "fr")], "de", "fr", ("auto", "fr", True)), ([("manual", "fr")], "de", None, None),
])
def test_pick_tracks(spark, listed, language, want, got):
    t = spark.createDataFrame([("a", s, k, i) for i, (s, k) in enumerate(listed)], "video_id string, source string, key string, pos int")
    r = tracks.pick_tracks(t, spark.createDataFrame([("a", language)], "video_id string, language string"), want).collect()
    assert [(x.source, x.key, x.translated) for x in r] == ([got] if got else [])


def test_logs_and_people_files(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"video_id":"a","n":1}\nnot json\n{"video_id":"a","n":2}\n{"video_id":"b","failed":"x"}\n{"video_id":"c","n":1}\n{"video_id":"c","failed":"x"}\n')
    assert rows(documents.read_log(spark, str(log), "video_id string, n int, failed string"), "video_id", "n") == [("a", 2), ("c", 1)]
    good, bad = tmp_path / "p.json", tmp_path / "q.json"
    good.write_text('{"ann lee": "Ann Lee", "x": 5, "y": {"z": 1}}')
    bad.write_text("{broken")
    assert rows(documents.read_people(spark, str(good))) == [("ann lee", "Ann Lee")] and rows(documents.read_people(spark, str(bad))) == []
    files = spark.createDataFrame([("some-talk-abcdefghijk.md",), ("notes.md",), ("x-abcdefghijk.txt",)], "name string")
    assert rows(documents.transcript_index(files)) == [("abcdefghijk", "some-talk-abcdefghijk")]


def test_resumed_stream(spark, tmp_path):
    src, sink, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    src.mkdir()
    runs = []

    def work(df):
        runs.append(df.count())
        return df.select("video_id", F.when(F.col("n") < 0, "bad").alias("failed"))

    go = lambda: resume.process_new(spark, str(src), "video_id string, n int", str(sink), str(check), work)
    (src / "1.json").write_text('{"video_id":"a","n":1}\n{"video_id":"b","n":-1}\n')
    go()
    (src / "2.json").write_text('{"video_id":"a","n":1}\n{"video_id":"b","n":2}\n{"video_id":"c","n":3}\n')
    go()
    go()
    assert runs == [2, 2] and rows(spark.read.parquet(str(sink)).where("failed is null"), "video_id") == [("a",), ("b",), ("c",)]


def test_transcripts_in_all_forms(spark, tmp_path):
    from cuewright.operators import transcript
    from cuewright.sources import sinks

    ship(spark)
    c = spark.createDataFrame([("a", i, i * 1000, i * 1000 + 900, t) for i, t in enumerate([">> Hello there.", "buy this now", ">> Bye."])], CUE)
    r = spark.createDataFrame([("a", "T", None, "", "", "https://x.invalid/a", "auto", "en", False, 0), ("b", "Empty", "Ch", "2024-01-01", "About it.", "u", "auto", "en", False, 7)], "video_id string, title string, channel string, upload_date string, description string, url string, source string, lang string, translated boolean, duration_ms long")
    s = spark.createDataFrame([("a", 900, 1900)], "video_id string, start_ms long, end_ms long")
    facts, p, applied = transcript.transcripts(c, r, s)
    assert rows(p) == [("a", 1, 0, "00:00", 1, "Hello there."), ("a", 2, 2000, "00:02", 2, "Bye.")] and rows(applied) == [("a", 900, 1900)]
    assert rows(facts, "video_id", "punctuated", "turns", "captions_end_ms", "duration_ms") == [("a", True, 2, 2900, 2900), ("b", False, 0, 0, 7)]
    got = {f: {x.video_id: x.body for x in transcript.rendered(f, facts, p, c).collect()} for f in ("md", "json", "srt", "vtt")}
    assert "[00:02](https://x.invalid/a#t=2) >> Bye." in got["md"]["a"] and json.loads(got["json"]["a"])["paragraphs"][1]["text"] == "Bye." and got["srt"]["a"].startswith("1\n00:00:00,000") and got["vtt"]["a"].startswith("WEBVTT")
    assert [x[1] for x in rows(transcript.context(r, spark.createDataFrame([("b", "Zoe"), ("b", "Ann")], "video_id string, name string")))] == ["Title: T\nChannel (the host): unknown", "Title: Empty\nChannel (the host): Ch\nPublished: 2024-01-01\nDescription:\nAbout it.\nPeople already identified elsewhere: Ann, Zoe"]
    assert rows(transcript.numbered_batches(p, 1)) == [("a", 0, "[1] Hello there."), ("a", 1, "[2] Bye.")]
    v = spark.createDataFrame([("a", "many_speakers", "7 speakers")], "video_id string, kind string, detail string")
    assert rows(transcript.retry_hints(v, spark.createDataFrame([("a", "Ann")], "video_id string, name string")))[0][1].endswith("- 7 speakers\n\nPeople this recording's metadata names: Ann")
    assert rows(transcript.failures(spark.createDataFrame([("a",)], "video_id string"), r, r)) == [("b", "no people found, though the metadata names a speaker")]
    out = tmp_path / "docs"
    for _ in range(2):
        sinks.write_files(spark.createDataFrame([("x", "one"), ("y", "two\n"), (None, "z")], "name string, body string"), str(out), ".md")
    assert sorted(f.name for f in out.iterdir()) == ["x.md", "y.md"] and (out / "x.md").read_text() == "one\n"
    sinks.write_people(spark.createDataFrame([("b b", "B B"), ("a a", "A A")], "key string, name string"), str(tmp_path / "people"))
    assert rows(documents.read_people(spark, str(tmp_path / "people"))) == [("a a", "A A"), ("b b", "B B")]
    e = spark.createDataFrame([("f", 0, "i1", "a", ""), ("f", 1, "i2", "", "")], "feed string, pos int, id string, audio string, transcript_url string")
    assert rows(feeds.references(e)) == [("f", 0, "podcast:f#i1")]


def test_chapters_of_metadata(spark):
    """Titles that say nothing are dropped, the rest are trimmed and placed."""
    info = '{"chapters": [{"start_time": 1.5, "title": " Opening "}, {"start_time": 60, "title": "<Untitled Chapter 2>"}, {"start_time": 61, "title": "<UNTITLED chapter 12>"}, {"title": "No start"}, {"start_time": 90, "title": "  "}, {"start_time": 100, "title": "Untitled Chapter 1"}]}'
    m = spark.createDataFrame([("a", info), ("b", None), ("c", "{}"), ("d", "broken")], "video_id string, info string")
    got = sorted(tuple(r) for r in cuts.chapters_of(m).collect())
    assert got == [("a", 0, "00:00", "No start"), ("a", 1500, "00:01", "Opening"), ("a", 100_000, "01:40", "Untitled Chapter 1")]
    assert cuts.chapters_of(m.limit(0)).collect() == []


def test_spans_with_wild_ends(spark):
    """A span that ends in a million years costs no more than the recording it lies in."""
    c = spark.createDataFrame([("a", i, i * 1000, i * 1000 + 900, "w") for i in range(100)], "video_id string, seq long, start_ms long, end_ms long, text string")
    s = spark.createDataFrame([("a", 60_000, 10**16), ("b", 0, 10**17), ("a", -(10**16), 500)], "video_id string, start_ms long, end_ms long")
    kept, applied = cuts.cut_spans(c, s)
    assert sorted(r.seq for r in kept.collect()) == list(range(1, 60)) and applied.count() == 2


def test_results_of_many_recordings_are_one_graph(spark):
    r = spark.createDataFrame(
        [("v1", "First", None, 2, None, [("Ann Berger", "host", False), ("Bob", "", True)], [(1, "Ann Berger", "Bob", "cites", "q", "00:01", "high")]), ("v2", "Second", "limit reached", None, None, None, None), ("v3", "Third", "", 1, 4, [("ANN BERGER", "guest", False)], [])],
        graph.RESULT,
    )
    people, edges, failed, totals = graph.merge_results(r)
    assert sorted((p.key, p.name, p.videos, list(p.roles)) for p in people.collect()) == [("ann berger", "Ann Berger", 2, ["host", "guest"]), ("bob@v1", "Bob", 1, [])]
    assert [(e.video_id, e.pos, e.edge_id) for e in edges.collect()] == [("v1", 1, 1)]
    assert [tuple(f) for f in failed.collect()] == [("v2", "Second", "limit reached")] and tuple(totals.first()) == (3, 4, 1)
    assert tuple(graph.merge_results(r.limit(0))[3].first()) == (0, 0, 0)


def test_appearances_link_to_their_transcripts(spark):
    m = spark.createDataFrame([("ann berger", "Ann Berger", [], 2, ["abcdefghijk", "zzzzzzzzzzz"], False)], "key string, name string, roles array<string>, videos long, appears_in array<string>, local boolean")
    e = spark.createDataFrame([], "edge_id long, video_id string, pos int, from_name string, to_name string, kind string, evidence string, timestamp string, confidence string, video string, url string")
    r = spark.createDataFrame([("abcdefghijk", "A talk"), ("zzzzzzzzzzz", "Gone")], "video_id string, title string")
    files = documents.transcript_index(spark.createDataFrame([("a-talk-abcdefghijk.md",), ("notes.md",)], "name string"))
    body = render.person_notes(m, e, r, files=files).first().body
    assert body.endswith("## Appears in\n\n- [[a-talk-abcdefghijk|A talk]]\n- Gone\n") and "[[" not in render.person_notes(m, e, r).first().body


def test_one_output_of_many_documents(spark):
    import json

    d = spark.createDataFrame([("b", '{"x": 2}'), ("a", '{"x": 1}'), ("c", None)], "video_id string, body string")
    out = lambda df, js: "".join(r.chunk for r in render.stacked(df, js).orderBy("video_id").collect())
    assert json.loads(out(d, True)) == [{"x": 1}, {"x": 2}] and json.loads(out(d.where("video_id = 'a'"), True)) == {"x": 1}
    assert out(d, False) == '{"x": 1}\n\n{"x": 2}' and out(d.limit(0), True) == ""


def test_names_a_corpus_learns(spark):
    labels = spark.createDataFrame([("v1", 1, "Ann Berger", True), ("v2", 1, "ann berger", True), ("v2", 2, "Bob Carter", True), ("v2", 3, "Eve", False), ("v3", 1, None, False)], "video_id string, n int, speaker string, grounded boolean")
    corpus = spark.createDataFrame([("bob carter", "Bob Carter")], "key string, name string")
    assert [tuple(r) for r in resolve.learned(labels, corpus).collect()] == [("v1", 1)]
    assert sorted(tuple(r) for r in resolve.learned(labels, corpus.limit(0)).collect()) == [("v1", 1), ("v2", 1)]


def test_a_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from cuewright import session

    class Context:
        master = "spark://head:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())


def test_whole_files_in_order(spark, tmp_path):
    for name, title in (("b.md", "Second"), ("a.md", "First"), ("c.txt", "None")):
        (tmp_path / name).write_text(f"---\ntitle: {title}\n---\n\n# {title}\n\n[00:01](https://x.invalid#t=1) one line\n\n[00:02](https://x.invalid#t=2) another\n", encoding="utf-8")
    got = documents.read_markdown(spark, str(tmp_path), ordered=True).collect()
    assert [(r.title, r.text) for r in got] == [("First", "one line another"), ("Second", "one line another")]
