"""What a line of a transcript holds besides speech: change markers, time marks, labels of speakers, notes of sounds, fillers."""

from __future__ import annotations

import re
from typing import NamedTuple

# Words of notes of sounds, and fillers by language.
NOTE_WORDS = set(
    "music upbeat applause laughs laughter laughing laugh chuckles inaudible crosstalk noise sighs sigh coughs cough cheering cheers silence unintelligible "
    "indistinct door slams slam footsteps phone rings ringing beep bell crying whispers whispering gasps groans sniffs clapping static theme jingle "
    "musik lachen applaus beifall rires applaudissements musique risas aplausos música 音楽 笑 拍手 音乐 笑声 掌声".split()
)
FILLERS = set(
    "um umm ummm uh uhh uhm er erm ah ahh hm hmm mm mhm mmhmm mm-hmm uh-huh uhhuh huh eh ehm äh ähm öh hem euh heu ben bah hein えーと ええと えっと あのー あの 嗯 呃 额 अं अँ เอ่อ อืม".split()
)
#: Fillers that are words of speech as well.
MAYBE_FILLERS = set("like well so also enfin este pues 那个 मतलब".split())
FILLER_PHRASES = ("you know", "i mean", "sort of", "kind of", "o sea")

TIME = re.compile(r"\[\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?\]|\(\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?\)|<\d{1,2}:\d{2}:\d{2}[.,]\d{3}>")
MARKER = re.compile(r">{2,}")
NOTE = re.compile(r"\[([^\[\]\n]{1,60})\]|\(([^()\n]{1,60})\)|（([^（）\n]{1,30})）|【([^【】\n]{1,30})】|<([^<>\n]{1,40})>|\*([^*\n]{1,40})\*|[♪♫]+(?:[^♪♫\n]{0,40}[♪♫]+)?")
_NAME = r"[^\W\d_](?:[\w.'’,-]|\([^()\n]{1,20}\)| (?=\S)(?!--|—)){0,58}?"
LABEL = re.compile(rf"\*\*([^*\n]{{1,60}})\*\*:?|\[([^\[\]\n]{{1,60}})\]:?|<v[. ]\s*([^<>\n]{{1,60}})>|({_NAME})(?::|：)(?=\s|$|[^\x00-\x7f])|({_NAME}) (?:--|—)(?=\s|$)")
NUMBERED = re.compile(r"(?i)^(?:speaker|spkr|spk|sprecher|locuteur|hablante|话者|話者)[ _#.-]*0*(\d{1,4})$")
_UNIT = re.compile(r"\r\n|[\n\r\x85  ]|(?=(?<!>)>{2,})")
#: Every span holds one of these.
_ANY = re.compile(r"[\[(（【<>*♪♫:：—]|--")
_ELONGATED = re.compile(r"^(?:u+h*m*|e+r+m*|a+h+|h+m+|m+h*m*|e+h+m*|ä+h+m*|e+u+h+|m+-h+m+|u+h-h+u+h+)$")


class Span(NamedTuple):
    start: int
    end: int
    kind: str  # marker, time, label, note, bracket
    text: str
    form: str


def is_note(inner: str) -> bool:
    words = inner.split()
    return 0 < len(words) <= 4 and any(w.strip(".,!?:;").lower() in NOTE_WORDS for w in words)


def is_filler(word: str) -> bool:
    return word in FILLERS or bool(_ELONGATED.match(word))


def units(text: str) -> list[tuple[int, int]]:
    """Spans of the lines of a text, cut before every change marker too; blank ones left out."""
    out, at = [], 0
    for m in _UNIT.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def scan(text: str, a: int, z: int) -> list[Span]:
    """The spans of a unit that are no plain words, in order: its opening (markers, times, one label), then notes and times anywhere."""
    if not _ANY.search(text, a, z):
        return []
    out, i, label = [], a, False
    while i < z:
        if text[i].isspace():
            i += 1
            continue
        m = MARKER.match(text, i, z) or TIME.match(text, i, z)
        if m:
            out.append(Span(i, m.end(), "marker" if m.group()[0] == ">" else "time", m.group(), ""))
            i = m.end()
            continue
        if label:
            break
        n = NOTE.match(text, i, z)
        if n and (not n.lastindex or is_note(n.group(n.lastindex))):
            out.append(Span(i, n.end(), "note", n.group(), ""))
            i = n.end()
            continue
        m = LABEL.match(text, i, z)
        if not m:
            break
        raw = m.group(m.lastindex).strip()
        form = ("", "bold", "square", "voice", "colon", "dash")[m.lastindex]
        if not raw or len(raw.split()) > 6 or (form in ("colon", "dash") and len(raw.split()) > 5):
            break
        out.append(Span(i, m.end(), "label", raw, form))
        i, label = m.end(), True
    while i < z:
        n = NOTE.search(text, i, z)
        if not n:
            break
        if TIME.fullmatch(n.group()):
            out.append(Span(n.start(), n.end(), "time", n.group(), ""))
        elif not n.lastindex or is_note(n.group(n.lastindex)):
            out.append(Span(n.start(), n.end(), "note", n.group(), ""))
        else:
            out.append(Span(n.start(), n.end(), "bracket", n.group(), ""))
        i = n.end()
    return out
