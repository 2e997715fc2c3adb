"""Sentence boundaries in many languages (problem 3).

Candidates are runs of end marks with the closing quotes and brackets after them; a maximum-entropy model decides on each by the tokens
around it, case, length, digits, script, and how quotes stand. It is trained on boundaries that are reliable as they stand (a lower-case
word, a comma or a known title follow: none; a capital follows a long word: one), each once as it is and once with case hidden, so that what
quotes mean carries over to scripts without case, and on a few lines in many scripts, so that it knows marks before it has seen data. Line breaks, changes of speaker and, in Thai, spaces between letters end a
sentence without being asked.

Candidates of a whole batch are rows of small numbers; their features are hashed and scored by numpy at once.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.marks import MAYBE_FILLERS, is_filler, scan, units
from cuewright.llm.rows import first_of, gathered
from cuewright.llm.sampling import fit_texts

#: Rows of text the model is fitted on, at most.
SAMPLE = 8000
BITS = 16

# Titles and abbreviations that a capital may follow, and German months after an ordinal.
TITLES = set("dr dra sr sra mr mrs ms mx st prof frau hr m mme mlle mgr rev hon gen col sgt capt lt jr डॉ श्री no nr vol fig approx vs ca bzw usw z b cf p pp ej art".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember".split())
# Code points of Unicode's Sentence_Terminal property beyond ASCII (single ones and ranges, hexadecimal), and the ellipsis.
TERMINALS = (
    "589 61D-61F 6D4 700-702 7F9 837 839 83D-83E 964-965 104A-104B 1362 1367-1368 166E 1735-1736 17D4-17D5 1803 1809 1944-1945 1AA8-1AAB 1B4E-1B4F 1B5A-1B5B 1B5E-1B5F 1B7D-1B7F 1C3B-1C3C 1C7E-1C7F 2026 203C-203D 2047-2049 2CF9-2CFB 2E2E 2E3C "
    "2E53-2E54 3002 A4FF A60E-A60F A6F3 A6F7 A876-A877 A8CE-A8CF A92F A9C8-A9C9 AA5D-AA5F AAF0-AAF1 ABEB FE12 FE15-FE16 FE52 FE56-FE57 FF01 FF0E FF1F FF61"
)
_WIDE = {chr(c) for x in TERMINALS.split() for c in range(int(x.split("-")[0], 16), int(x.split("-")[-1], 16) + 1)}
_ENDS = _WIDE | set(".!?")
_CANDIDATE = re.compile("[" + re.escape("".join(sorted(_ENDS))) + "]+")
_CLOSE = set("\"'”’»)]}」』）】》〉›")
_OPEN = set("\"'“‘«([{「『（【《〈‹„‚¿¡")
_PAIRS = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "‹": "›", '"': '"'}
_LEAD = re.compile(r"\s*[^\W\d_][^.!?:：\n]{0,40}[:：]\s")
_FIRST_PERSON = re.compile(r"\bI\b")
_THAI = re.compile("[ก-๎]")
_THAI_GAP = re.compile(r"(?<=[ก-๎])\s+(?=[ก-๎])")
_BEFORE = re.compile(r"[\w\u0300-\u036f\u0900-\u0dff\u0e00-\u0e7f'’.-]*\Z")
_AFTER = re.compile(r"[\w\u0300-\u036f\u0900-\u0dff\u0e00-\u0e7f'’-]+")


@lru_cache(1 << 14)
def _script(ch: str) -> str:
    if ch < "ɐ":
        return "latin"
    return unicodedata.name(ch, "?").split(" ")[0].split("-")[0].lower()


def _shape(ch: str) -> str:
    if ch.isupper():
        return "upper"
    if ch.islower():
        return "lower"
    if ch.isdigit():
        return "digit"
    if ch.isalpha():
        return "letter"
    return "mark"


def blanked(text: str, a: int, z: int) -> tuple[str, bool]:
    """The unit with everything but speech blanked, positions kept; whether it holds speech."""
    s = text[a:z]
    for x in reversed(scan(text, a, z)):
        alone = x.kind == "label" and not any(c.isalnum() for c in s[x.end - a :])  # what follows is blank by now
        if x.kind in ("marker", "time", "note") or (x.kind == "label" and (alone or x.form in ("bold", "square", "voice") or _named(x.text))):
            s = s[: x.start - a] + " " * (x.end - x.start) + s[x.end - a :]
    return s, any(c.isalnum() for c in s)


def _named(raw: str) -> bool:
    """A name as a label has it: capitals, numbers, initials."""
    return all(w[0] in "([" or not w[0].isalpha() or w[0].isupper() or w.lower() in ("speaker", "spkr") for w in raw.replace(",", " ").split())


_EVENT = re.compile("[" + re.escape("".join(sorted(_ENDS | set(_PAIRS) | set(_PAIRS.values())))) + "]")
_SHAPES = {x: i for i, x in enumerate(("upper", "lower", "digit", "letter", "mark", "dash"))}
_QUOTES = {"none": 0, "start": 1, "inside": 2}


@lru_cache(1 << 16)
def _code(x: str) -> int:
    return zlib.crc32(x.encode())


def _quotes(s: str) -> tuple[list[int], list[int], dict[int, bool]]:
    """(positions, depth after each, where quotes and brackets close and whether they began where a sentence began) of a unit."""
    where, depth, closed, stack, fresh = [-1], [0], {}, [], 0
    for m in _EVENT.finditer(s):
        i, c = m.start(), m.group()
        if stack and c == stack[-1][0]:
            closed[i] = stack.pop()[1]
        elif c in _PAIRS:
            lead = s[fresh:i].strip().rstrip(",，、").lower()
            stack.append((_PAIRS[c], not any(x.isalnum() for x in lead) or is_filler(lead) or lead in MAYBE_FILLERS))
        if c in _ENDS or (i in closed and s[i - 1] in _ENDS):
            fresh = i + 1
        if len(stack) != depth[-1]:
            where.append(i)
            depth.append(len(stack))
    return where, depth, closed


def candidates(s: str) -> list[tuple[int, tuple[int, ...], int]]:
    """(end, what is seen of it, reliable label: 1, 0 or -1 for unknown) of each candidate of a blanked unit that more text follows."""
    found = list(_CANDIDATE.finditer(s))
    if not found:
        return []
    # A text is of one case if only its opening before a colon, or the English I, is not.
    body = _FIRST_PERSON.sub("", s[lead.end() :] if (lead := _LEAD.match(s)) else s)
    one_case = any(c.isupper() for c in body) != any(c.islower() for c in body)
    out = []
    where, depth, closed_at = _quotes(s)
    depth_at = lambda i: depth[bisect_right(where, i) - 1]
    for m in found:
        i, j = m.start(), m.end()
        e, close = j, None
        inner = depth_at(j - 1)
        while e < len(s):
            q = e
            while q < len(s) and s[q] in "    " and q < e + 2:
                q += 1
            if q < len(s) and q in closed_at and (q == e or s[q] in "»›"):
                close = closed_at[q] if close is None else close
                e = q + 1
            elif e < len(s) and s[e] in _CLOSE and e not in closed_at and depth_at(e) <= inner:
                e += 1
            else:
                break
        n = e
        while n < len(s) and s[n].isspace():
            n += 1
        if n >= len(s):
            continue
        gap, nc = n > e, s[n]
        if not gap and s[j - 1] not in _WIDE and _script(nc) == "latin" and not (close is not None or nc in "“«„「『（("):
            continue
        p = n
        while p < len(s) and p < n + 4 and (s[p] in _OPEN or s[p].isspace()):
            p += 1
        after = _AFTER.match(s, p)
        word = after.group()[:14].lower() if after else ""
        nshape = _shape(s[p]) if p < len(s) else "mark"
        if nc not in _OPEN and not nc.isalnum():
            nshape = "dash" if nc in "-–—" else "mark"
        token = _BEFORE.search(s, max(0, i - 24), i).group().lstrip(".'’-")
        low = "<abbreviation>" if token.lower() in TITLES else token.lower()  # they share what is learnt of any of them
        mark = m.group()[-1] if len(m.group()) == 1 else ("..." if set(m.group()) == {"."} else m.group()[:2])
        quote = "none" if close is None else ("start" if close else "inside")
        inq = inner > 0 and close is None
        script = _script(next((c for c in reversed(token) if c.isalpha()), "a"))
        initial = len(token) == 1 and token.isalpha() or "." in token
        num = min(len(token), 4) if token.isdigit() else (5 if not token.isalpha() else 6)
        label = -1
        if nshape == "mark":
            label = 0
        elif one_case:
            pass
        elif mark == "." and (low == "<abbreviation>" or (initial and nshape != "digit")):
            label = 0
        elif token.isdigit() and len(token) < 3 and mark == "." and word in MONTHS:
            label = 0
        elif nshape == "lower" or (close is not None and nc == "と"):
            label = 0
        elif inq:
            pass
        elif quote == "start" and nshape == "letter" and nc not in _OPEN:
            label = 0  # a reporting clause goes on after the quote the sentence began with
        elif nshape in ("upper", "letter", "dash") and (nshape == "upper" or quote != "start"):
            label = 1
        elif nshape == "digit" and (len(token) > 3 or mark != "."):
            label = 1
        bare = nshape == "letter" and not nc.islower() and not nc.isupper()
        seen = (
            _SHAPES[nshape], _code(word), gap, _code(mark), _code(low), _SHAPES[_shape(token[-1]) if token else "mark"], min(len(token), 5), _QUOTES[quote], inq, _code(script), initial, num, nc in _OPEN, ord(nc) if bare else 0, word in MONTHS, one_case,
        )
        out.append((e, seen, label))
    return out


def _ids(rows: list[tuple[int, ...]], hidden: bool = False) -> np.ndarray:
    """Hashed features of candidates, one row each; hidden: as if the text had no case (texts of one case are read so anyway)."""
    x = np.array(rows, np.int64).reshape(-1, 16).T.astype(np.uint64)
    nx, word, gap, mark, low, tshape, size, quote, inq, script, initial, num, opening, bare, month, one_case = x
    hide = np.ones(len(nx), bool) if hidden else one_case == 1
    nx, word = np.where(hide & (nx < 2), np.uint64(_SHAPES["letter"]), nx), np.where(hide, np.uint64(_code("")), word)
    month, bare = np.where(hide, np.uint64(0), month), np.where(nx == _SHAPES["letter"], bare, np.uint64(0))
    zero = np.zeros_like(nx)
    columns = (
        (zero,), (mark,), (low, mark), (size, mark, initial), (nx, mark), (word,), (quote, nx, opening), (quote, opening), (inq, nx), (gap, script), (low, nx), (num, nx), (num, word), (tshape, nx), (initial, nx, mark), (opening, nx), (script, mark, quote), (bare, quote), (month, num),
    )
    out = np.empty((len(nx), len(columns)), np.int64)
    for k, c in enumerate(columns):
        h = np.full(len(nx), np.uint64(k + 1))
        for v in c:
            h = (h ^ (v + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, k] = (h >> np.uint64(64 - BITS)).astype(np.int64)
    return out


#: Sentences that show marks, titles and quotes in many scripts.
_SEEDS = (
    "Dr. Stone met Mrs. Hill at noon. They paid 3.5 euros, e.g. for tea. Who was there? Nobody! He said, “It rains.” “Who is it?” asked the man. Then they left... It was late.", "Der Ofen wurde am 3. Mai z. B. von Dr. Alt gebaut. „Wo ist er?“, fragte sie. Danach ging er. Er kam am Montag.",
    "Il a dit : « C'est fini. » « Où est-il ? » demanda M. Blanc. Ensuite il partit. Quel jour !", "¿Está listo? Sí, dijo la Sra. Paz. ¡Qué bien! Luego se fue.", "駅はどこですか。新しい本です！「はい。」と先生が言いました。また明日。", "老师在哪里？他说：“已经好了。”后来下雨了。", "नाव कहाँ है? डॉ. राव ने देखा। यह सच है।", "“वह कौन था?” बच्चे ने कहा। “यहाँ आओ!” माँ ने पुकारा। “क्या हुआ?” उसने पूछा। फिर वह चला गया।", "“谁来了？”他问道。“快走！”妈妈喊道。然后他们走了。", "「誰ですか？」と彼が聞いた。「行こう！」と母が言った。彼は帰った。",
    "ይህ ጥሩ ነው። ዛሬ ሄደ። ማን ነው፧ አላውቅም።", "သူသွားသည်။ ငါလာသည်။ ဘယ်သူလဲ။", "គាត់ទៅ។ ខ្ញុំមក។ អ្នកណា?", "Он ушёл. Она осталась. Кто это? Никто не знал.", "Ήρθε χθες. Πού είναι; Έφυγε.", "وصل أمس. من هو؟ لا أحد يعرف. وہ آیا۔ میں گیا۔", "Նա եկավ։ Ես գնացի։",
)


def fit(texts: list[str], rounds: int = 150, l2: float = 1e-5) -> np.ndarray:
    """Weights of the maximum-entropy model, from the reliable candidates of the texts and of some lines that show marks in many scripts."""
    seen = [(c, label) for t in [*_SEEDS, *texts] for a, z in units(t or "") for _, c, label in candidates(blanked(t, a, z)[0]) if label >= 0]
    rows, want = [c for c, _ in seen], np.array([label for _, label in seen], np.float64)
    w = np.zeros(1 << BITS, np.float64)
    x, y = np.concatenate([_ids(rows), _ids(rows, hidden=True)]), np.concatenate([want, want])
    g2 = np.full(len(w), 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
        g = np.bincount(x.ravel(), np.repeat((p - y) / len(y), x.shape[1]), minlength=len(w)) + l2 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return w.astype(np.float32)


def batch_ends(texts: list[str], w: np.ndarray) -> list[list[int]]:
    """End of each sentence of each text: code points up to it, white space after it not counted."""
    read, rows = [], []
    for i, text in enumerate(texts):
        for a, z in units(text):
            s, speech = blanked(text, a, z)
            c = candidates(s) if speech else []
            read.append((i, a, z, s, speech, [e for e, _, _ in c], len(rows)))
            rows += [x for _, x, _ in c]
    ends_here = w[_ids(rows)].sum(1) > 0 if rows else np.zeros(0, bool)
    out: list[list[int]] = [[] for _ in texts]
    for i, a, z, s, speech, at, k in read:
        text, found = texts[i], out[i]
        stop = a + len(text[a:z].rstrip())
        if not speech:
            if found:
                found[-1] = stop
            continue
        own = [e for e, yes in zip(at, ends_here[k : k + len(at)]) if yes]
        if _THAI.search(s):
            own = sorted({*own, *(m.start() for m in _THAI_GAP.finditer(s))})
        # Nothing spoken before an end: it is none; nothing spoken after the last: it reaches the unit's end.
        begin, kept = 0, []
        for e in own:
            if any(ch.isalnum() for ch in s[begin:e]):
                kept.append(e)
                begin = e
        if kept and not any(ch.isalnum() for ch in s[kept[-1] :]):
            kept.pop()
        found += [a + e for e in kept] + [stop]
    return [x if x or not t.strip() else [len(t.rstrip())] for x, t in zip(out, texts)]


def ends(text: str, w: np.ndarray) -> list[int]:
    """End of each sentence of one text."""
    return batch_ends([text], w)[0]


def model(df: DataFrame, text: str, sample: int = SAMPLE) -> np.ndarray:
    """Fit on at most `sample` texts, the same at every run."""
    return fit(fit_texts(df, text, sample))


def sentences(df: DataFrame, keys: list[str], text: str, trained_on: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """Rows (*keys, end_pos): one for each sentence of each text.

    Null and blank texts have none; text without speech is one sentence; repeated rows count once; rows stay where they are
    but for the drop of repeated ones; further columns are ignored. trained_on: other texts, in a column of the same name, to fit the model on.
    """
    w = model(df if trained_on is None else trained_on, text, sample)
    d = gathered(df.select(*keys, F.col(f"`{text}`").alias("__t")).where(F.col("__t").isNotNull()), keys, ["__t"])
    schema = T.StructType([*d.select(*keys).schema.fields, T.StructField("end_pos", T.IntegerType())])
    b = df.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for rows in first_of(batches, keys):
            texts = rows.column("__t").to_pylist()
            found = [x for lo in range(0, len(texts), 1000) for x in batch_ends(texts[lo : lo + 1000], b.value)]
            at = pa.array(np.repeat(np.arange(len(rows)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([*[rows.column(k).take(at) for k in keys], pa.array([e for f in found for e in f], pa.int32())], names=schema.names)

    return d.mapInArrow(run, schema)
