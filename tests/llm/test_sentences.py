"""Sentence boundaries on held-out cases, and pieces of oversized items."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuewright.llm import sentences as S
from cuewright.llm import splitting as P
from cuewright.session import ship, table


@pytest.fixture(scope="module")
def w(spark, data):
    return S.model(table(spark, "/root/testdata/sf0.01", "paragraphs"), "text")


# Each | is the end of a sentence.
CASES = [
    "Dr. Quill met Mrs. Penn at 5 p.m. near the dock.| They paid 3.5 euros, e.g. for tea.|", "“Who is it?” asked the man.| He said, “It rains.”| (It did not.)| Fine!|", "J. R. Stone wrote no. 24.| See vol. 3 for more?!| Yes…| No... well, perhaps.|",
    "Der Ofen usw. wurde am 3. Mai z. B. von Dr. Alt gebaut.| „Wo ist er?“, fragte sie.| Er rief: „Hier!“| Danach ging er.|", "«¿Está listo?», preguntó la Sra. Paz.| ¡Qué bien!| Cuesta 7,5 euros, p. ej. aquí.|",
    "Il a dit : « C'est fini. »| « Où est-il ? » demanda M. Blanc.| Quel jour !| Ensuite, cf. p. 4, il partit.|", "「駅はどこですか。」と先生が聞きました。|新しい本です！|『赤い！』という声。|", "“老师在哪里？”学生问道。|他说：“已经好了。”|后来下雨了（见第3页）。|嗯，“谁？”他问。|",
    "डॉ. राव ने देखा।| “नाव कहाँ है?” नदी ने पूछा।| क्या यह सच है?|", "เราไปตลาดแล้ว| เขาอยู่บ้าน| ฝนตก!|", "no marks are written here at all|\nbut a line ends it|", "well >> Ann Lee: yes|".replace("well", "well|"), "One. [music]|\n>> [laughs] Two.|".replace("One.", "One."),
    "they saw i mean the dock.| then I mean they left!| why did he go?|", "One thing: the tea was cold.| nobody drank it?| they left.|", "The tea... well, it was cold.| I drank it.|",
    "[Dr. Adams] (00:01:02) Good day.| *sighs* And good night. <noise>|", "[music] [Applause]|", "A line.|\n\n  (laughter)\n>> next one|".replace("A line.|\n\n  (laughter)", "A line.\n\n  (laughter)|"), "copyright 2013 by the company. |all rights are ours.|".replace(". |", ".| "),
]


@pytest.mark.parametrize("case", CASES)
def test_held_out_sentences(w, case):
    text, want = "", []
    for c in case:
        if c == "|":
            want.append(len(text))
        else:
            text += c
    assert S.ends(text, w) == want


def test_accuracy_on_reliable_boundaries(spark, data):
    """Fitted on one half of a table, tried on the reliable boundaries of the other."""
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "paragraphs").select("text").distinct().orderBy("text").collect()]
    w = S.fit(texts[::2])
    right = total = 0
    for t in texts[1::2]:
        for a, z in S.units(t):
            for _, f, label in S.candidates(S.blanked(t, a, z)[0]):
                if label >= 0:
                    total += 1
                    right += (w[S._ids([f])].sum() > 0) == (label == 1)
    assert total > 1000 and right / total > 0.995


@pytest.mark.parametrize("text", ["ሰላም ለሁሉም።| እንዴት ነህ፧| ደህና ነኝ።|", "သူသွားခဲ့သည်။| ငါလာမည်။|", "គាត់បានទៅ។| ខ្ញុំមកហើយ។|", "Նա գնաց։| Ես եկա։|", "وہ گیا۔| میں آیا۔|"])
def test_marks_of_other_scripts(text):
    """Known before any data are seen."""
    w = S.fit([])
    plain = text.replace("|", "")
    want, k = [], 0
    for c in text:
        want += [k] if c == "|" else []
        k += c != "|"
    assert S.ends(plain, w) == want


def test_a_fit_on_nothing_still_finds_sentences():
    assert S.ends("The door was open. Dr. Alt saw it. Nobody came!", S.fit([])) == [18, 34, 47]


def test_rows(spark):
    ship(spark)
    rows = [("a", 1, "One. Two."), ("a", 1, "One. Two."), ("b", 1, None), ("c", 1, "  "), (None, 1, "x"), ("d", 1, "word " * 20000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "video_id string, n int, text string, end_pos int")
    got = sorted((r.video_id or "", r.n, r.end_pos) for r in S.sentences(df, ["video_id", "n"], "text").collect())
    assert got == [("", 1, 1), ("a", 1, 4), ("a", 1, 9), ("d", 1, 99999)]
    assert S.sentences(df.limit(0), ["video_id", "n"], "text").collect() == []


@settings(max_examples=120, deadline=None)
@given(st.text("ab. \n!", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    w = np.zeros(1 << S.BITS, np.float32)
    got = P.pieces(text, limit, overlap, w)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, z, _), (b, y, _) in zip(got, got[1:]):
        assert z - a <= limit and y - b <= limit and b == max(z - overlap, 0) and y > z
    joined = text[: got[0][1]] + "".join(text[z:y] for (_, z, _), (_, y, _) in zip(got, got[1:]))
    assert joined == text


def test_boundaries(w):
    assert P.pieces("x" * 450, 200, 20, w) == [(0, 200, "none"), (180, 380, "none"), (360, 450, "end")]
    text = "One two three. " + "Four " * 60
    a = P.pieces(text, 200, 20, w)
    assert a[0] == (0, 14, "sentence") and a[1][2] == "space"
    text = "A. B.\nC.\n\nD. " + "word " * 6 + "E. F."
    assert P.pieces(text, 20, 3, w)[0] == (0, 8, "section") and P.pieces(text[:7] + " " + "word " * 9, 20, 3, w)[0] == (0, 5, "line")
    assert P.pieces("short", 200, 20, w) == [(0, 5, "end")]
    assert P.pieces(">> " + "y" * 300, 200, 20, w)[0][2] == "space"


def test_split_rows(spark, w):
    ship(spark)
    df = spark.createDataFrame([("a", 1, "x" * 450, 0), ("a", 1, "x" * 450, 0), ("b", 1, "fits", 0), ("c", 1, None, 0), (None, 2, "y" * 201, 0)], "video_id string, n int, text string, piece int")
    got = sorted((r.video_id or "", r.piece, r.start_pos, r.end_pos, r.boundary, r.size, len(r.part)) for r in P.split(df, ["video_id", "n"], "text", 200, 20, w).collect())
    assert got == [("", 1, 0, 200, "none", 201, 200), ("", 2, 180, 201, "end", 201, 21), ("a", 1, 0, 200, "none", 450, 200), ("a", 2, 180, 380, "none", 450, 200), ("a", 3, 360, 450, "end", 450, 90)]
    assert P.split(df.limit(0), ["video_id", "n"], "text", 200, 20, w).collect() == []
    with pytest.raises(ValueError):
        P.split(df, ["video_id"], "text", 20, 20, w)
