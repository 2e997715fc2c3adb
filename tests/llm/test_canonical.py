"""One form for texts that look the same, and passages found in spite of how they look."""

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuewright.llm import canonical as C
from cuewright.llm import leakage as L
from cuewright.session import ship


def one(*texts):
    return C.canonical_array(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize("same", [
    ("State", "Ｓｔａｔｅ", "St​ate", "Stаtе", "St\xadate﻿", "Sta⁠te"), ("fine...", "ﬁne…"), ("élan", "élan"), ("a b", "a\xa0b", "a　b", "a b"), ("co-op", "co‑op", "co‐op"),
    ("geöffnet", "geӧffnet", "geöffnet"), ("доклад", "дoклад"), ("κινηματογράφος", "κιvηματoγράφος"), ("Ｈost", "Ηοst", "Host"), ("한국", "한국"), ("ṩ", "ṩ", "ṩ"),
])
def test_equal_looks(same):
    assert len(set(one(*same))) == 1


@pytest.mark.parametrize("a,b", [("el", "él"), ("m2", "m²"), ("n.º", "n.o"), ("a b", "a  b"), ("a-b", "a–b"), ("Case", "case"), ("йод", "иод"), ("1l", "11")])
def test_other_looks_stay(a, b):
    x, y = one(a, b)
    assert x != y


def test_words_keep_their_script():
    assert one("Привет, сор и вор", "cop", "Это сор") == ["Привет, сор и вор", "cop", "Это сор"]


def test_further_look_alikes_from_a_file(spark, tmp_path):
    f = tmp_path / "confusables.txt"
    f.write_text("\ufeff# comment\n10424 ;\t0073 ;\tMA\t# a letter\n0269 ; 0069 ; MA\n2A74 ; 003A 003A 003D ; MA\n", encoding="utf-8")
    assert C.read_confusables(str(f)) == ((0x10424, 0x73), (0x269, 0x69))
    d = spark.createDataFrame([(1, "\U00010424tate"), (2, "state"), (3, "stɑte"), (4, None)], "id int, t string")
    assert [r.c for r in C.with_canonical(d, "t", "c", str(f)).orderBy("id").collect()] == ["state", "state", "state", None]
    assert [r.n for r in C.look_classes(d, "id", "t", str(f)).groupBy("look").count().withColumnRenamed("count", "n").collect()] == [3]


def test_nulls_and_empty_and_slices():
    a = pa.array(["x", None, "", "ﬀ", None, "é"])
    assert C.canonical_array(a).to_pylist() == ["x", None, "", "ff", None, "é"]
    assert C.canonical_array(a.slice(3, 2)).to_pylist() == ["ff", None]
    assert C.canonical_array(pa.array([], pa.string())).to_pylist() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=0x24F)) | st.text("aеоééﬁ　​пр "), max_size=5))
def test_idempotent_and_like_nfc(texts):
    first = one(*texts)
    assert one(*first) == first
    for t, c in zip(texts, first):
        if t.isascii():
            assert c == t.replace("\r", "")
        assert unicodedata.normalize("NFC", c) == c


def test_pairs(spark):
    ship(spark)
    rows = [(1, "the café", "x"), (2, "the café", "x"), (3, "the café", "x"), (4, "the cafe", "x"), (5, None, "x"), (None, "the café", "x"), (6, "", "x"), (7, "​", "x"), (1, "the café", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, c string")
    assert sorted(map(tuple, C.look_alikes(d, "doc_id", "text").collect())) == [(1, 2), (2, 3), (6, 7)]
    assert C.look_alikes(d.limit(0), "doc_id", "text").collect() == []
    kept = C.with_canonical(d, "text", "c")
    assert kept.columns == ["doc_id", "text", "c"] and kept.count() == len(rows)


def brute(docs, items, n=12):
    def words(t):
        return re.findall(r"[^\W_]+", one(t)[0].lower())

    out = set()
    for d, t in docs:
        if t is None:
            continue
        have = " " + " ".join(words(t)) + " "
        for i, q in items:
            w = words(q)
            if any(" " + " ".join(w[k : k + n]) + " " in have for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    vocabulary = ["sun", "moon", "river", "Stone", "café", "x-ray", "no. 7", "win", "o'clock", "über"]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(5, 40)))) for i in range(30)]
    docs = []
    for d in range(200):
        w = list(rng.choice(vocabulary, 30))
        if d % 3 == 0:
            q = items[rng.integers(30)][1].split(" ")
            k, m = rng.integers(0, max(1, len(q) - 11)), rng.integers(10, 16)
            part = " ".join(q[k : k + m])
            part = [part.upper(), part.replace("o", "о"), part.replace(" ", "\n"), "“" + part.replace(" ", "\xa0") + "”", part.replace("n", "n​")][d % 5]
            w.insert(15, part)
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "filler " * 3000 + items[3][1] + " end" * 3000), (903, items[3][1])]
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ii = spark.createDataFrame([*items, (99, None), (None, "a"), (98, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in L.leaks(dd, ii).collect()}
    assert got == brute(docs, items)
    assert L.leaks(dd, ii.limit(0)).collect() == [] and L.leaks(dd.limit(0), ii).collect() == []


def test_several_passes_find_the_same(spark, monkeypatch):
    ship(spark)
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "so " + text), (2, text[60:])], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"word{k}" for k in range(i, i + 14))) for i in range(10)], "item_id long, text string")
    whole = sorted(map(tuple, L.leaks(docs, items).collect()))
    monkeypatch.setattr(L, "PART_CHARS", 200)
    assert sorted(map(tuple, L.leaks(docs, items).collect())) == whole and len(whole) > 10


def test_wu_manber_exact():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 20000).astype(np.uint32)
    start, size = rng.integers(0, 19900, 50), rng.integers(8, 30, 50)
    pats = [text[k : k + n].copy() for k, n in zip(start, size)]
    wm = L.WuManber(text, start, size)
    rows, found = wm.search(text, np.array([0, 7000, 7000, 20000]))
    got = set(zip(rows.tolist(), wm.order[found].tolist()))
    s = "".join(map(chr, text))
    want = {(r, j) for r, (a, z) in enumerate([(0, 7000), (7000, 7000), (7000, 20000)]) for j, p in enumerate(pats) if "".join(map(chr, p)) in s[a:z]}
    assert got == want


def test_latin_passages_in_other_scripts(spark):
    """A word of look-alike letters only counts as Latin in a Cyrillic document too, and an item may be Cyrillic; ids of any type."""
    ship(spark)
    passage = "a space is so near as can be, we said: once more to the sea"
    russian = "мы все говорили об этом снова и снова но никто не верил нам тогда"
    foreign = "Доклад о том, что было вчера и что будет завтра. " * 20
    docs = spark.createDataFrame([("d1", foreign + passage + " " + foreign), ("d2", foreign + passage.upper()), ("d3", foreign), ("d4", russian.upper()), ("d5", passage.replace("a", "а").replace("o", "ο"))], "doc_id string, text string")
    items = spark.createDataFrame([("x", passage), ("y", russian)], "item_id string, text string")
    got = {(r.doc_id, r.item_id): r.windows for r in L.leaks(docs, items).collect()}
    assert got == {("d1", "x"): 4, ("d2", "x"): 4, ("d4", "y"): 3, ("d5", "x"): 4}
