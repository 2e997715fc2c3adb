"""Repeated lines of a source, and repetition inside a document."""

import random

import pytest

from cuewright.llm import boilerplate as B
from cuewright.llm import repetition as R
from cuewright.session import ship


def test_lines(spark):
    bye = "Subscribe to our channel now!"
    rows = [("a", 1, f"one\n\n{bye}"), ("b", 1, "two"), ("b", 2, "SUBSCRIBE to our channel, NOW 7"), ("c", 1, bye + "\nthree"), ("d", 1, "thanks for listening again and again\nthree"), ("e", 1, None), ("f", 1, ""), (None, 1, bye), ("x", 1, bye), ("a", 1, f"one\n\n{bye}")]
    p = spark.createDataFrame([(*r, "k", 1) for r in rows], "video_id string, n int, text string, key string, docs int")
    rec = [(v, "show") for v in "abcdef"] + [("x", None), ("a", "show")]
    r = spark.createDataFrame(rec, "video_id string, channel string")
    got = sorted((x.video_id, x.n, x.line_no) for x in B.repeated_lines(p, r).collect())
    assert got == [("a", 1, 2), ("b", 2, 1), ("c", 1, 1)]
    cleaned = {(x.video_id, x.n): (x.text, x.removed) for x in B.without_repeated_lines(p, r).collect()}
    assert cleaned["a", 1] == ("one", 1) and cleaned["b", 2] == ("", 1) and cleaned["c", 1] == ("three", 1) and cleaned["e", 1] == (None, 0) and cleaned["d", 1][1] == 0
    assert B.repeated_lines(p.limit(0), r.limit(0)).collect() == []


def test_share_of_recordings(spark):
    line = "exactly this line is said by everybody here"
    p = spark.createDataFrame([(f"v{i}", 1, line if i < 3 else "other") for i in range(40)], "video_id string, n int, text string")
    r = spark.createDataFrame([(f"v{i}", "show") for i in range(40)], "video_id string, channel string")
    assert B.repeated_lines(p, r).count() == 0 and B.repeated_lines(p, r.where("video_id < 'v35'")).count() == 3


def test_blocks_are_components(spark):
    a, b, c = "first line of the legal notice", "second line of the legal notice", "a prompt that stands all alone"
    p = spark.createDataFrame([(f"v{i}", 1, f"{a}\n{b}\nbody {i}") for i in range(4)] + [(f"v{i}", 2, c) for i in range(4)], "video_id string, n int, text string")
    r = spark.createDataFrame([(f"v{i}", "show") for i in range(4)], "video_id string, channel string")
    got = {x.key: x.block for x in B.blocks(p, r).collect()}
    key = {k: k.replace(" ", "") for k in (a, b, c)}
    assert got[key[a]] == got[key[b]] != got[key[c]] and len(got) == 3


def test_edges_decide_on_short_lines(spark):
    """By its own support a short line would go everywhere or nowhere; it goes where it stands beside its block, and what follows it elsewhere stays."""
    legal = "no part of this recording may be used again"
    rows = [(f"v{i}", 1, f"Thanks!\n{legal}\nbody {'vwxyz'[i]}") for i in range(5)] + [(f"v{i}", 2, "Thanks!\nI mean it") for i in range(5)] + [(f"v{i}", 3, f"{legal}\nthat was it {'abcde'[i]}") for i in range(5)] + [("v0", 4, "Hm\nThanks!"), ("v1", 4, None)]
    p = spark.createDataFrame(rows, "video_id string, n int, text string")
    r = spark.createDataFrame([(f"v{i}", "show") for i in range(5)], "video_id string, channel string")
    got = {(x.video_id, x.n): (x.text, x.removed) for x in B.without_repeated_lines(p, r).collect()}
    assert got["v0", 1] == ("body v", 2) and got["v0", 2] == ("Thanks!\nI mean it", 0) and got["v0", 3] == ("that was it a", 1) and got["v0", 4] == ("Hm\nThanks!", 0) and got["v1", 4] == (None, 0)
    assert {(x.n, x.line_no, x.joined) for x in B.repeated_lines(p, r).collect()} == {(1, 1, True), (1, 2, False), (3, 1, False)}


def brute(lines):
    words = []
    for _, t in sorted(lines):
        for w in (t or "").split():
            k, z = 0, len(w)
            while k < z and not w[k].isalnum():
                k += 1
            while z > k and not w[z - 1].isalnum():
                z -= 1
            if w[k:z]:
                words.append(w[k:z].lower())
    seen, hit = set(), set()
    for i in range(len(words) - 5):
        g = tuple(words[i : i + 6])
        if g in seen:
            hit |= set(range(i, i + 6))
        seen.add(g)
    return len(words), len(hit)


@pytest.mark.parametrize("seed", range(3))
def test_repetition_against_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = {}
    for d in range(6):
        vocabulary = [f"w{i}" for i in range((2, 3, 9, 40, 4000, 4000)[d])]
        docs[f"d{d}"] = [(rng.randrange(100_000) if d % 2 else i, " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!", " --"]) for _ in range(rng.choice([0, 1, 3, 9])))) for i in range(300)]
        docs[f"d{d}"] = list(dict(docs[f"d{d}"]).items())
    rows = [(k, o, t, 1) for k, v in docs.items() for o, t in v]
    df = spark.createDataFrame(rows + rows[:50], "video_id string, seq long, text string, pos int")
    got = {r.video_id: (r.words, r.repeated) for r in R.repeated_share(df, "video_id", "seq", "text").collect()}
    assert got == {k: brute(v) for k, v in docs.items()}


def test_long_documents_are_measured_alike(spark, monkeypatch):
    """Documents no task may hold go another way to the same rows; scripts without blanks are measured by letters both ways."""
    ship(spark)
    rng = random.Random(9)
    rows = [(f"d{d}", rng.randrange(4000), " ".join(rng.choice(["so", "it", "is,", "—", "今日", "ไปไหน", "see www", "x@y.org"]) for _ in range(rng.choice([0, 1, 2, 7])))) for d in range(5) for _ in range((20, 90, 400, 700, 60)[d])]
    df = spark.createDataFrame(rows + rows[:30] + [("d3", 7, None), (None, 1, "x")], "video_id string, seq long, text string")
    for letters in (False, True):
        monkeypatch.setattr(R, "MOST_LINES", 100_000)
        want = sorted(map(tuple, R.line_rules(df, "video_id", "seq", "text", letters).collect()))
        monkeypatch.setattr(R, "MOST_LINES", 80)
        assert sorted(map(tuple, R.line_rules(df, "video_id", "seq", "text", letters).collect())) == want and any(r[3] for r in want)


def test_scripts_without_blanks(spark):
    ship(spark)
    df = spark.createDataFrame([("a", 1, "今日はいい天気ですね。"), ("a", 2, "今日はいい天気ですね。"), ("a", 3, "また明日")], "video_id string, seq long, text string")
    assert R.repeated_share(df, "video_id", "seq", "text").first()[1:3] == (3, 0)
    assert R.repeated_share(df, "video_id", "seq", "text", letters=True).first()[1:3] == (24, 10)
    assert [r.seq for r in R.clean_lines(df, "video_id", "seq", "text", letters=True).orderBy("seq").collect()] == [1, 3]


def test_repetition_of_nothing(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 1, ""), (None, 1, "x"), ("c", None, "x"), ("d", 1, "one two three four five six " * 5000)], "video_id string, seq long, text string")
    got = {r.video_id: (r.words, r.repeated, r.rejected) for r in R.judged(df, "video_id", "seq", "text").collect()}
    assert got == {"a": (0, 0, False), "b": (0, 0, False), "d": (30000, 29994, True)}
    assert R.judged(df.limit(0), "video_id", "seq", "text").collect() == []


def test_rules_of_a_line(spark):
    df = spark.createDataFrame([("a", 1, "See https://x.invalid/a"), ("a", 2, "..."), ("a", 3, "Fine."), ("a", 4, "fine"), ("a", 5, "fine!"), ("a", 6, "Other words")], "video_id string, seq long, text string")
    got = {r.seq: (r.no_words, r.navigation, r.boilerplate, r.no_end) for r in R.line_rules(df, "video_id", "seq", "text").collect()}
    assert got == {1: (False, True, False, True), 2: (True, False, False, False), 3: (False, False, True, False), 4: (False, False, True, True), 5: (False, False, True, False), 6: (False, False, False, True)}
