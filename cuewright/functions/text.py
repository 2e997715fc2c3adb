"""Column functions over caption text, times, urls and dates. All stay in the JVM; null in, null out unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and names that decide results.
SENTENCE_END = r"""[.!?]["')\]]?\s*\z"""
VIDEO_URL = r"(?:[?&]v=|youtu\.be/|/shorts/)([\w-]{11})"
LIST_URL = r"(?i)/playlist|/channel/|/@|/c/|/user/|[?&]list="
TAGS_ONLY = r"\A(?:\[[^\]]*\]|\s)+\z"
NOT_PROSE = r"(?i)^\s*(?:[-*•]|\d{1,2}:\d{2}|#\w|https?://|\W*$)|^\s*[\w ]{0,24}:\s*$"
BLOCKED = r"(?i)429|too many requests|rate.?limit|not a bot|block\w*[^.]*\bip\b|\bip\b[^.]*block"
NO_SUBS = r"(?i)subtitles are disabled|no subtitles"
GONE = r"(?i)video unavailable|private video|has been removed|account.*terminated|not available in your country|confirm your age|age.?restricted|members[- ]only"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WATCH = "https://www.youtube.com/watch?v="
LIGATURES = ("ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "ﬅ", "ﬆ", "ĳ", "Ĳ")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: without it a value used inside a lambda is computed again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """White space of any kind to one blank."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def clean_text(c: Column) -> Column:
    """Caption typography made plain: hyphens that do not break, blanks that do not break, zero-width spaces, runs of white space."""
    return squeeze(F.translate(c, "‑‐ ​", "-- "))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(squeeze(_blank(c)), " "), lambda w: w != ""))


def ends_sentence(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?U)" + SENTENCE_END), F.lit(False))


def tags_only(c: Column) -> Column:
    return F.coalesce(c.rlike(TAGS_ONLY), F.lit(False))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def stamp(ms: Column) -> Column:
    """MM:SS, from an hour on H:MM:SS."""
    s = F.floor(ms / 1000)
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    short = F.concat(_two(m), F.lit(":"), _two(rest))
    return F.when(s >= 3600, F.concat(h.cast("string"), F.lit(":"), short)).otherwise(short)


def subtitle_time(ms: Column, point: str) -> Column:
    """HH:MM:SS and three digits after `point`; negative times are 0."""
    t = F.greatest(ms.cast("long"), F.lit(0))
    s = F.floor(t / 1000)
    hour = F.floor(s / 3600).cast("string")
    return F.concat(F.lpad(hour, F.greatest(F.length(hour), F.lit(2)), F.lit("0")), F.lit(":"), _two(F.floor(s % 3600 / 60)), F.lit(":"), _two(s % 60), F.lit(point), F.lpad((t % 1000).cast("string"), 3, "0"))


def _strip(c: Column, chars: str) -> Column:
    inside = "".join("\\" + x if x in r"\]^-[" else x for x in chars)
    return F.regexp_replace(c, f"^[{inside}]+|[{inside}]+$", "")


def slug(title: Column, id_: Column, limit: int = 60) -> Column:
    s = _strip(F.left(_strip(F.regexp_replace(F.lower(_blank(title)), "[^a-z0-9]+", "-"), "-"), F.lit(limit)), "-")
    fallback = F.coalesce(F.nullif(id_, F.lit("")), F.lit("transcript"))
    return F.when(s == "", fallback).otherwise(F.concat(s, F.lit("-"), _blank(id_)))


def video_id(url: Column) -> Column:
    """The 11 characters of a video's url, the id of an episode reference, or null."""
    found = F.nullif(F.regexp_extract(url, VIDEO_URL, 1), F.lit(""))
    return F.when(url.startswith("podcast:"), F.nullif(F.regexp_extract(url, r"\Apodcast:[^#]*#(.*)\z", 1), F.lit(""))).otherwise(found)


def milliseconds(start_ms: Column, stamp: Column) -> Column:
    """start_ms, else the time a timestamp spells: MM:SS, H:MM:SS, with a fraction, in brackets, or 1h02m03s; null where neither can be read."""
    s = F.regexp_replace(F.trim(stamp), r"^[\[(]|[\])]$", "")
    clock = r"^(?:(\d+):)?(\d{1,3}):(\d{2})(?:[.,](\d{1,3}))?$"
    worded = r"^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)$"
    part = lambda pattern, k: F.coalesce(F.expr("1L") * F.nullif(F.regexp_extract(s, pattern, k), F.lit("")).try_cast("long"), F.lit(0))
    hms = lambda p: (part(p, 1) * 3600 + part(p, 2) * 60 + part(p, 3)) * 1000
    frac = F.rpad(F.regexp_extract(s, clock, 4), 3, "0").try_cast("long")
    read = F.when(s.rlike(clock), hms(clock) + F.coalesce(frac, F.lit(0))).when(s.rlike(worded), hms(worded))
    return F.coalesce(F.when(start_ms >= 0, start_ms), read)


def anchor_url(url: Column, ms: Column) -> Column:
    """The recording at that second: rebuilt from a video's id, a media fragment on anything else."""
    second = F.floor(ms / 1000).cast("string")
    found, base = F.regexp_extract(url, VIDEO_URL, 1), F.substring_index(url, "#", 1)
    return F.when(found != "", F.concat(F.lit(WATCH), found, F.lit("&t="), second, F.lit("s"))).when(base == "", base).otherwise(F.concat(base, F.lit("#t="), second))


def is_video_url(url: Column) -> Column:
    return url.rlike(VIDEO_URL)


def is_playlist_url(url: Column, force: bool = False) -> Column:
    listed = url.rlike(LIST_URL)
    return listed if force else listed & ~is_video_url(url)


def is_ambiguous_url(url: Column) -> Column:
    return is_video_url(url) & url.rlike(LIST_URL)


def iso_date(c: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD; anything else is ''."""
    return F.when(c.rlike(r"\A\d{8}\z"), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))).otherwise(F.lit(""))


def rfc822_date(c: Column) -> Column:
    """Day, month name and year found anywhere as YYYY-MM-DD, no shift of zone; else ''."""
    pattern = r"(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})"
    c = _blank(c)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(c, pattern, 2)))
    return F.when(month > 0, F.concat_ws("-", F.regexp_extract(c, pattern, 3), _two(month), F.lpad(F.regexp_extract(c, pattern, 1), 2, "0"))).otherwise(F.lit(""))


def duration_seconds(c: Column) -> Column:
    """Seconds, MM:SS or H:MM:SS; more parts or anything else is 0. Fractions of a part are cut off."""
    c = F.regexp_replace(_blank(c), r"(?U)^\s+|\s+$", "")
    parts = F.transform(F.split(c, ":"), lambda p: p.try_cast("double").try_cast("long"))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + x)
    return F.coalesce(F.when(F.size(parts) <= 3, total), F.lit(0)).cast("long")


def first_prose(c: Column, limit: int = 300) -> Column:
    """The first block of a description that is prose of more than 40 characters, on one line, cut at `limit`; else ''."""
    blocks = F.split(F.regexp_replace(_blank(c), r"(?U)^\s+|\s+$", ""), r"\n\s*\n")
    prose = F.transform(blocks, lambda b: F.trim(squeeze(F.array_join(F.filter(F.split(b, r"\r\n|[\n\r\x0B\f\x{85}\x{2028}\x{2029}]"), lambda x: ~x.rlike(r"(?U)" + NOT_PROSE)), " "))))
    first = F.get(F.filter(prose, lambda p: F.length(p) > 40), F.lit(0))
    cut = F.concat(F.rtrim(F.left(first, F.lit(limit))), F.lit("..."))
    return F.coalesce(F.when(F.length(first) > limit, cut).otherwise(first), F.lit(""))


def strip_markup(c: Column, to: str = " ") -> Column:
    return F.regexp_replace(c, r"<[^>]+>", to)


def short_sha1(c: Column, size: int = 11) -> Column:
    return F.substring(F.sha1(c), 1, size)


def hash_prefix(c: Column, size: int = 4) -> Column:
    """What of an id a span lookup may tell: the head of its SHA-256."""
    return F.substring(F.sha2(c, 256), 1, size)


def error_class(c: Column) -> Column:
    """What an extractor's message means; the order decides."""
    return F.when(c.rlike(BLOCKED), "rate_limited").when(c.rlike(NO_SUBS), "no_captions").when(c.rlike(GONE), "unavailable").otherwise("error")


def tidy_error(c: Column) -> Column:
    """A message without its prefix, its advice and its last stop."""
    s = F.regexp_replace(c, "ERROR: ", "")
    s = F.element_at(F.split(s, r"\s*(?:Use --cookies|(?:Also s|S)ee\s+https?://)"), 1)
    s = F.regexp_replace(F.trim(s), r"^\[[\w:]+\]\s*[\w-]{11}:\s*", "")
    return F.regexp_replace(F.trim(s), r"\.+\z", "")


def ascii_words(c: Column) -> Column:
    """The words evidence is compared by: runs of a-z and 0-9 in lower case. Accented letters part words, on purpose."""
    return F.regexp_extract_all(F.lower(_blank(c)), F.lit("([a-z0-9]+)"), F.lit(1))


def fold(c: Column) -> Column:
    """The key names are compared by: compatibility forms and accents undone, lower case, only a-z, 0-9 and single blanks."""
    for x in LIGATURES:
        c = F.replace(c, F.lit(x), F.lit(unicodedata.normalize("NFKD", x)))
    source, target = _plain_letters()
    s = F.regexp_replace(F.lower(F.translate(c, source, target)), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(s, " +", " "))


_LETTERS: list[tuple[str, str]] = []


def _plain_letters() -> tuple[str, str]:
    """All characters below U+2200 and the full-width forms that decompose to one ASCII letter, digit or blank; by rule."""
    if not _LETTERS:
        a, b = [], []
        for cp in [*range(0x80, 0x2200), *range(0x3000, 0x3001), *range(0xFF01, 0xFF5F)]:
            plain = "".join(x for x in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(x))
            if len(plain) == 1 and plain.isascii() and (plain.isalnum() or plain == " "):
                a.append(chr(cp))
                b.append(plain)
        _LETTERS.append(("".join(a), "".join(b)))
    return _LETTERS[0]


def repetition(c: Column, n: int = 3) -> Column:
    """1 - distinct n-grams / n-grams of the words; 0 without any."""
    def share(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) < n, F.lit(0.0)).otherwise(let(grams, lambda g: 1 - F.size(F.array_distinct(g)) / F.size(g)))

    return let(F.filter(F.split(squeeze(F.lower(_blank(c))), " "), lambda x: x != ""), share)


def json_reply(c: Column, schema: str) -> Column:
    """The object in a model's reply: the fenced block if there is one, then from the first to the last brace; null where that is no object."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.+?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(c)
    a, z = F.instr(body, "{"), F.length(body) - F.instr(F.reverse(body), "}") + 1
    return F.from_json(F.when((a > 0) & F.contains(body, F.lit("}")) & (z > a), F.substring(body, a, z - a + 1)), schema)
