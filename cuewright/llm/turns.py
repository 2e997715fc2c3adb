"""Transcripts into clean, ordered speaker turns (problem 1).

Every line is a sequence of tokens, tagged as speaker, timestamp, annotation, filler or speech by a sequence model and decoded by Viterbi for a whole batch at once. What a
token looks like (its kind, the words in it, case, marks, length, where it stands, what stands beside it) gives a log-linear score of each tag, and steps from tag to tag are scored by how
often they follow. The model is fitted on a bounded sample: tokens of a reliable look carry their tag (times, numbered labels, listed notes and fillers, other words), each
once as it is and once with lists and words hidden, so that what surrounds a note or a filler carries over to ones no list has. What the tags say is all that decides: a
label is what is decoded as speaker, and only what is decoded as speech is kept.

An opening that could be a label is read twice, as one that means a known name and as one that means nobody; which of them holds is settled by the names the metadata of
the recording knows. Turns are runs of one speaker over the speech, in the order of time.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions.text import milliseconds
from cuewright.llm.marks import FILLER_PHRASES, MAYBE_FILLERS, NUMBERED, TIME, is_filler, scan, units
from cuewright.llm.people import deletions, fold_words, match_label, nick
from cuewright.llm.rows import first_of, gathered
from cuewright.llm.sampling import fit_texts
from cuewright.operators.scan import _join, last_value
from cuewright.session import cut

TAGS = ("speaker", "timestamp", "annotation", "filler", "speech")
SPEAKER, STAMP, NOTE, FILLER, SPEECH = range(5)
KINDS = ("marker", "time", "bold", "voice", "colon", "dash", "bracket", "word", "marks")
MARKER, TIMED, BOLD, VOICE, COLON, DASH, BRACKET, WORD, MARKS = range(9)
#: What a list says of a token: a note, a filler, maybe one, a numbered label, a label that means a known name.
NOTED, FILLED, MAYBE, NUMBER, KNOWN = range(1, 6)
_FORMS = {"bold": BOLD, "voice": VOICE, "colon": COLON, "dash": DASH, "square": BRACKET}
#: Paragraphs the model is fitted on, at most, and one in how many of their plain words.
SAMPLE, PLAIN = 3000, 8
BITS = 15
#: Time and order are cut into buckets of so many ms and paragraphs.
BUCKET_MS, BUCKET_N = 1_800_000, 512
_WORD = re.compile(r"\S+")
#: A change marker that opens a text, time marks aside.
_OPENING = re.compile(rf"(?:\s|{TIME.pattern})*>>")
_EDGE = re.compile(r"^[^\w\u0900-\u0dff\u0e00-\u0e7f]+|[^\w\u0900-\u0dff\u0e00-\u0e7f]+$")
_SOUND = re.compile(r"^([a-zà-ÿ])\1*([hmrn]?)\2*$")
_PHRASES = {tuple(p.split()) for p in FILLER_PHRASES}
_HEADS = {p[0] for p in _PHRASES}


def _case(w: str) -> int:
    if any(c.isdigit() for c in w):
        return 5
    return 0 if w.islower() else 1 if w.isupper() else 2 if w.istitle() else 3 if w.lower() == w.upper() else 4


def _tail(token: str) -> int:
    return 0 if token[-1].isalnum() else 1 if token[-1] in ",，、" else 2 if token.endswith(("...", "…", "--", "—")) else 3 if token[-1] in ".。।" else 4 if token[-1] in "?!？！" else 5


@lru_cache(1 << 16)
def _plain(token: str) -> tuple[int, int, int, int, str]:
    """(kind, flag, shape, hash, the word in it) of a plain token."""
    bare = _EDGE.sub("", token)
    low = bare.lower()
    if not bare:
        return MARKS, 0, _tail(token), 0, ""
    size = len(bare) if len(bare) < 4 else 4 if len(bare) < 7 else 5 if len(bare) < 13 else 0
    shape = ((_case(bare) * 6 + _tail(token)) * 6 + size) * 2 + bool(_SOUND.match(low))
    return WORD, FILLED if is_filler(low) else MAYBE if low in MAYBE_FILLERS else 0, shape, zlib.crc32(low.encode()), low


def _spanned(text: str) -> tuple[int, int]:
    """(shape, hash) of a label or of what stands in brackets."""
    w = text.strip("[](){}<>*♪♫（）【】 ").split()
    if not w:
        return 1, 0
    shape = ((min(len(w), 5) * 3 + (0 if w[-1][-1].isalnum() else 1 if w[-1][-1] in ".!?。！？…" else 2)) * 5 + _case(w[0])) * 8 + 4 * w[0][0].isdigit() + 2 * text.isascii() + (len(w) > 3)
    return shape, zlib.crc32(w[0].lower().encode())


class Words:
    """Numbers for tokens, and of each number: what it looks like (kind, what a list says, shape, a hash of the words in it), how it is written, whether it holds a letter or digit, the tag it carries if its look is reliable."""

    def __init__(self):
        self.number: dict[object, int] = {}
        self.look: list[tuple[int, int, int, int]] = []
        self.raw: list[str] = []
        self.said: list[bool] = []
        self.seed: list[int] = []
        self.heads: set[int] = set()  # may begin a phrase that is a filler
        self.low: list[str] = []

    def _add(self, key: object, kind: int, flag: int, shape: int, word: int, raw: str, low: str = "", seed: int = -1) -> int:
        n = self.number[key] = len(self.look)
        self.look.append((kind, flag, shape, word))
        self.raw.append(raw)
        self.said.append(any(c.isalnum() for c in raw))
        self.low.append(low)
        self.seed.append(seed)
        if low in _HEADS:
            self.heads.add(n)
        return n

    def plain(self, token: str) -> int:
        n = self.number.get(token)
        if n is None:
            kind, flag, shape, word, low = _plain(token)
            seed = SPEECH if kind == MARKS else FILLER if flag == FILLED else -1 if flag == MAYBE else SPEECH
            n = self._add(token, kind, flag, shape, word, token, low, seed)
        return n

    def phrase(self, a: int, b: int) -> int:
        n = self.number.get((a, b))
        return self._add((a, b), WORD, MAYBE, self.look[b][2], self.look[b][3], f"{self.raw[a]} {self.raw[b]}") if n is None else n

    def span(self, x, raw: str, known: bool = False) -> int:
        """known: as a label that means a known name."""
        key = (x.kind, x.form, raw, known)
        n = self.number.get(key)
        if n is None:
            if x.kind == "label":
                kind, flag = _FORMS[x.form], KNOWN if known else NUMBER if NUMBERED.match(x.text) else 0
            else:
                kind = MARKER if x.kind == "marker" else TIMED if x.kind == "time" else BRACKET
                flag = KNOWN if known else NOTED if x.kind == "note" else 0
            if kind == TIMED:
                seed = STAMP
            elif kind in (MARKER, BOLD, VOICE) or flag in (NUMBER, KNOWN):
                seed = SPEAKER
            elif kind == BRACKET:
                seed = NOTE if flag == NOTED else SPEECH if len(x.text.split()) > 4 or x.text[-2:-1] in ".!?。！？…" else -1
            else:
                seed = -1
            n = self._add(key, kind, flag, *(_spanned(x.text) if kind not in (MARKER, TIMED) else (0, 0)), raw, "", seed)
        return n


class Unit(NamedTuple):
    tokens: list[int]
    label: object  # the span that could be a label, or None
    at: int  # where it stands among the tokens
    notes: list[tuple[int, object]]  # where notes and brackets stand, for those who want to know
    start: list[int]  # where tokens begin in the text, if asked for


def read_unit(words: Words, text: str, a: int, z: int, where: bool = False) -> Unit:
    """The tokens of a unit as numbers."""
    out, start, at, label, label_at, notes = [], [], a, None, -1, []
    plain, heads, low, known = words.plain, words.heads, words.low, words.number.get
    for x in [*scan(text, a, z), None]:
        stop = x.start if x else z
        raw = text[at:stop].split()
        seg = list(map(known, raw))
        if None in seg:
            seg = list(map(plain, raw))
        pos = [m.start() for m in _WORD.finditer(text, at, stop)] if where else []
        if heads and not heads.isdisjoint(seg):
            k, merged, kept = 0, [], []
            while k < len(seg):
                n = seg[k]
                kept.append(k)
                if n in heads and k + 1 < len(seg) and (low[n], low[seg[k + 1]]) in _PHRASES:
                    k += 1
                    n = words.phrase(n, seg[k])
                merged.append(n)
                k += 1
            seg, pos = merged, [pos[k] for k in kept] if where else []
        out += seg
        start += pos
        if x:
            if x.kind == "label":
                label, label_at = x, len(out)
            elif x.kind in ("note", "bracket"):
                notes.append((len(out), x))
            out.append(words.span(x, text[x.start : x.end]))
            start.append(x.start)
            at = x.end
    return Unit(out, label, label_at, notes, start)


def as_known(words: Words, text: str, u: Unit) -> list[int]:
    """The tokens of a unit if its label means a known name."""
    return [*u.tokens[: u.at], words.span(u.label, text[u.label.start : u.label.end], True), *u.tokens[u.at + 1 :]]


_FLAGS = (1, 5, 6)  # features of what lists say
_HIDE = (*_FLAGS, 3)  # what is hidden in the second copy
_OWN, _NONE = 7, 20  # features of a token and its place; what stands beside the first and last
_SPARE = (1 << BITS) - 1


def _hashed(columns: list[np.ndarray], first: int) -> np.ndarray:
    out = np.empty((len(columns[0]), len(columns)), np.int64)
    for i, c in enumerate(columns, first):
        h = (c.astype(np.uint64) * np.uint64(24) + np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, i - first] = np.where(c < 0, _SPARE, (h >> np.uint64(64 - BITS)).astype(np.int64) % _SPARE)
    return out


def _own_ids(look: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashed features of tokens that look so (kind, flag, shape, word) and stand there (1: last, 2: first)."""
    kind, flag, shape, word = look.T
    return _hashed([kind, np.where(flag > 0, kind * 8 + flag, -1), kind * 4096 + shape, np.where(word > 0, kind + word * 16, -1), (kind * 4096 + shape) * 4 + place, np.where(flag > 0, flag, -1), np.where(flag > 0, flag * 4 + place, -1)], 0)


def _beside_ids(kind: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return _hashed([kind * 32 + before, kind * 32 + after, (before * 32 + kind) * 32 + after], _OWN)


def _then_ids(kind: np.ndarray, then: np.ndarray) -> np.ndarray:
    return _hashed([kind * 32 + then], _OWN + 3)


def _around(look: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, kind before, kind after, case of the word after) of the tokens of sequences of these sizes."""
    kind, case = look[:, 0], look[:, 2] // 72
    end = np.cumsum(size)
    first, last = np.zeros(len(kind), bool), np.zeros(len(kind), bool)
    first[end - size], last[end - 1] = True, True
    before, after, then = np.full(len(kind), _NONE), np.full(len(kind), _NONE), np.full(len(kind), _NONE)
    before[1:], after[:-1], then[:-1] = kind[:-1], kind[1:], case[1:]
    before[first], after[last], then[last] = _NONE, _NONE, _NONE
    return first * 2 + last, before, after, then


def _ids(look: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashed features of all tokens of some sequences, one row a token."""
    place, before, after, then = _around(look, size)
    return np.concatenate([_own_ids(look, place), _beside_ids(look[:, 0], before, after), _then_ids(look[:, 0], then)], 1)


class Model(NamedTuple):
    weight: np.ndarray  # features by tags; the last feature weighs nothing
    prior: np.ndarray
    first: np.ndarray
    move: np.ndarray


class Tagger:
    """A model at work: what it says of tokens and of neighbours is looked up, each look scored once."""

    def __init__(self, m: Model):
        self.m, self.words = m, Words()
        n = _NONE + 1
        grid = np.indices((n, len(KINDS), n)).reshape(3, -1)
        self.beside = m.weight[_beside_ids(grid[1], grid[0], grid[2])].sum(1).reshape(n, len(KINDS), n, -1)
        grid = np.indices((len(KINDS), n)).reshape(2, -1)
        self.then = m.weight[_then_ids(grid[0], grid[1])].sum(1).reshape(len(KINDS), n, -1)
        self.own, self.look, self.known = np.zeros((1024, 4, len(TAGS)), np.float32), np.zeros((1024, 4), np.int64), 0

    def _learn(self) -> None:
        """Scores the looks that are new."""
        n = len(self.words.look)
        if n > len(self.own):
            more = max(n, 2 * len(self.own)) - len(self.own)
            self.own, self.look = np.concatenate([self.own, np.zeros((more, 4, len(TAGS)), np.float32)]), np.concatenate([self.look, np.zeros((more, 4), np.int64)])
        new = np.array(self.words.look[self.known :], np.int64).reshape(-1, 4)
        self.look[self.known : n] = new
        for place in range(4):
            self.own[self.known : n, place] = self.m.weight[_own_ids(new, np.full(len(new), place))].sum(1)
        self.known = n

    def forget(self, most: int = 500_000) -> None:
        """Begins anew if too many tokens have been met: what a worker holds is bounded."""
        if len(self.words.look) > most:
            self.words, self.known = Words(), 0

    def scores(self, tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of each token and tag: the logarithm of how much likelier the look makes the tag."""
        if self.known < len(self.words.look):
            self._learn()
        look = self.look[tokens]
        place, before, after, then = _around(look, size)
        kind = look[:, 0]
        s = self.own[tokens, place] + self.beside[before, kind, after] + self.then[kind, then]
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True)) - self.m.prior / 2

    def decode(self, seqs: list[list[int]], cells: int = 400_000) -> list[np.ndarray]:
        """Viterbi: the tags of each sequence; all of like length in step, in chunks of a bounded number of cells."""
        m = self.m
        out: list = [np.zeros(0, np.int8)] * len(seqs)
        order = sorted((i for i in range(len(seqs)) if seqs[i]), key=lambda i: -len(seqs[i]))
        k = 0
        while k < len(order):
            part = order[k : k + max(1, min(2048, cells // len(seqs[order[k]])))]
            k += len(part)
            size = np.array([len(seqs[i]) for i in part])
            emit = self.scores(np.fromiter((t for i in part for t in seqs[i]), np.int64, int(size.sum())), size)
            begin = np.cumsum(size) - size
            longest = int(size[0])
            live = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences longer than t
            back, score = np.zeros((longest, len(part), len(TAGS)), np.int8), m.first + emit[begin]
            for t in range(1, longest):
                n = live[t]
                step = score[:n, :, None] + m.move
                best = step.argmax(1)
                back[t, :n] = best
                score[:n] = np.take_along_axis(step, best[:, None, :], 1)[:, 0] + emit[begin[:n] + t]
            path = np.zeros((longest, len(part)), np.int8)
            now = score.argmax(1)
            for t in range(longest - 1, -1, -1):
                n = live[t]
                path[t, :n] = now[:n]
                if t:
                    now[:n] = back[t, np.arange(n), now[:n]]
            for r, i in enumerate(part):
                out[i] = path[: size[r], r]
        return out


#: Lines of every kind of token, so that a model fitted on few texts knows them all.
_SEEDS = (
    "[00:00:01] >> Speaker 1: hello there everyone\nand this goes on (laughter)\nUm, yes, uh, it does.\n[music]\n♪♪\n*sighs*\n<noise>\n(The tray was never painted.)\n[We all went home after that.]\n**Speaker 2**: well\n<v Speaker 3> no\n"
    "[speaker 4] so\nSpeaker 5 -- right\nEuh...\n[applause]\nHmm.\n(laughs) Okay then\nYes.\nNo.\nOf course.\nAnd?\n>> Right.\nwe said it, and they heard it."
)


def fit(texts: list[str], rounds: int = 150, l2: float = 1e-6) -> Model:
    """Fitted on the tokens of the texts (and of a few lines that show every kind) whose look is reliable."""
    words = Words()
    read = [(t, u) for t in [_SEEDS, *texts] for a, z in units(t or "") if (u := read_unit(words, t, a, z)).tokens]
    # A label that means a known name is one, whatever it looks like: labels, and notes that open a line, are shown as such too.
    spans = [(u, u.at, words.span(u.label, t[u.label.start : u.label.end], True)) for t, u in read if u.label is not None]
    spans += [(u, 0, words.span(u.notes[0][1], t[u.notes[0][1].start : u.notes[0][1].end], True)) for t, u in read if u.notes and u.notes[0][0] == 0 and u.notes[0][1].kind == "note"]
    known = [[*u.tokens[:i], n, *u.tokens[i + 1 :]] for u, i, n in spans]
    look, seeds = np.array(words.look, np.int64), np.array(words.seed)
    flat = lambda seqs: (np.concatenate([np.array(s) for s in seqs]), np.array([len(s) for s in seqs]))
    tokens, size = flat([u.tokens for _, u in read])
    ids, want, kind = _ids(look[tokens], size), seeds[tokens], look[tokens, 0]
    keep = (want >= 0) & ((kind != WORD) | (want != SPEECH) | (np.arange(len(tokens)) % PLAIN == 0) | (size < 3).repeat(size))
    weight = np.where((kind == WORD) & (want == SPEECH), float(PLAIN), 1.0)[keep]
    hidden = ids[keep].copy()
    hidden[:, list(_HIDE)] = _SPARE
    x, y, weights = [ids[keep], hidden], [want[keep], want[keep]], [weight, weight / 2]
    if known:
        more, lengths = flat(known)
        told = _ids(look[more], lengths)[np.cumsum(lengths) - lengths + np.array([i for _, i, _ in spans])]
        bare = np.full_like(told, _SPARE)
        bare[:, _FLAGS] = told[:, _FLAGS]  # once by nothing but what is known of it
        x += [told, bare]
        y += [np.full(len(told), SPEAKER)] * 2
        weights += [np.full(len(told), 50.0)] * 2
    x, inverse = np.unique(np.column_stack([np.concatenate(x), np.concatenate(y)]), axis=0, return_inverse=True)
    c = np.bincount(inverse.ravel(), np.concatenate(weights))
    x, y = x[:, :-1], x[:, -1]
    c = np.sqrt(c) / np.sqrt(c).sum()  # frequent looks count more, but do not drown the rare
    w, g2, hot = np.zeros((1 << BITS, len(TAGS))), np.full((1 << BITS, len(TAGS)), 1e-8), np.eye(len(TAGS))[y]
    for _ in range(rounds):
        s = w[x].sum(1)
        p = np.exp(s - s.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - hot) * c[:, None]
        g = np.stack([np.bincount(x.ravel(), np.repeat(d[:, k], x.shape[1]), minlength=len(w)) for k in range(len(TAGS))], 1) + l2 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        w[-1] = 0
    prior = np.log((hot * c[:, None]).sum(0) + 1e-4)
    # Steps from tag to tag, counted on what the looks alone say.
    local = w[ids].sum(1).argmax(1)
    begins = np.zeros(len(local), bool)
    begins[np.cumsum(size) - size] = True
    first, move = np.ones(len(TAGS)), np.ones((len(TAGS), len(TAGS)))
    np.add.at(first, local[begins], 1)
    inner = np.flatnonzero(~begins)
    np.add.at(move, (local[inner - 1], local[inner]), 1)
    norm = lambda v: np.log(v / v.sum(-1, keepdims=True))
    return Model(w.astype(np.float32), prior, norm(first) / 2, norm(move) / 2)  # halved, as the looks hold some of it already


_UNIT = [("unit", pa.int32(), T.IntegerType()), ("opens", pa.bool_(), T.BooleanType()), ("label", pa.string(), T.StringType()), ("form", pa.string(), T.StringType()), ("number", pa.int64(), T.LongType()), ("speech", pa.bool_(), T.BooleanType()),
         ("clean", pa.string(), T.StringType()), ("known_label", pa.string(), T.StringType()), ("known_speech", pa.bool_(), T.BooleanType()), ("known_clean", pa.string(), T.StringType())]


def _read(words: Words, tokens: list[int], path: np.ndarray, u: Unit, known: bool, with_text: bool) -> tuple:
    """(label, form, number, speech, clean) of a unit as it is decoded; known: its label means a known name."""
    label = form = number = None
    if u.label is not None and path[u.at] == SPEAKER:
        label, form = u.label.text, u.label.form
        m = NUMBERED.match(label)
        number = int(m.group(1)) if m else None
    kept = [t for t, tag in zip(tokens, path.tolist()) if tag == SPEECH]
    said = words.said
    speech = any(said[t] for t in kept)
    if not with_text:
        return label, form, number, speech, None
    if label is not None and number is None and not known and form in ("colon", "dash"):
        kept = [t for i, (t, tag) in enumerate(zip(tokens, path.tolist())) if tag == SPEECH or i == u.at]  # it means nobody: words before a colon
    return label, form, number, speech, " ".join(words.raw[t] for t in kept)


def tagged_paragraphs(paragraphs: DataFrame, tables: Model, text: bool = True) -> DataFrame:
    """Rows (video_id, n, turn, ms, units) of the paragraphs (video_id, n, turn, ms, text): units holds what tagged_units says of each of its lines. Of rows that follow one another with one (video_id, n) the first counts."""
    with_text = text
    b = paragraphs.sparkSession.sparkContext.broadcast(tables)
    d = paragraphs.select("video_id", "n", F.col("turn").cast("long").alias("turn"), F.col("ms").cast("long").alias("ms"), "text")
    schema = T.StructType([*[d.schema[c] for c in ("video_id", "n", "turn", "ms")], T.StructField("units", T.ArrayType(T.StructType([T.StructField(n, k) for n, _, k in _UNIT])))])

    def run(batches):
        tagger = Tagger(b.value)
        for whole in first_of(batches, ["video_id", "n"]):
            for lo in range(0, len(whole), 1000):
                tagger.forget()
                words = tagger.words
                rows = whole.slice(lo, 1000)
                where, read, texts = [], [], rows.column("text").to_pylist()
                for i, t in enumerate(texts):
                    for k, (a, z) in enumerate(units(t or "") or [(0, 0)]):
                        where.append((i, k))
                        read.append(read_unit(words, t or "", a, z))
                # Openings that could be labels, numbered ones aside, are read a second time as known ones.
                twice = [(i, as_known(words, texts[where[i][0]], u)) for i, u in enumerate(read) if u.label is not None and words.look[u.tokens[u.at]][1] != NUMBER]
                paths = tagger.decode([u.tokens for u in read] + [s for _, s in twice])
                known = {i: _read(words, s, path, read[i], True, with_text) for (i, s), path in zip(twice, paths[len(read) :])}
                out, nothing = [], (None, None, None, None, None)
                for i, (p, k) in enumerate(where):
                    other = known.get(i, nothing)
                    out.append((k, k == 0 and bool(_OPENING.match(texts[p] or "")), *_read(words, read[i].tokens, paths[i], read[i], False, with_text), other[0], other[3], other[4]))
                count = np.bincount([p for p, _ in where], minlength=len(rows))
                inner = pa.StructArray.from_arrays([pa.array([x[j] for x in out], kind) for j, (_, kind, _) in enumerate(_UNIT)], names=[x[0] for x in _UNIT])
                offsets = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("video_id", "n", "turn", "ms")] + [pa.ListArray.from_arrays(offsets, inner)], names=schema.names)

    return d.mapInArrow(run, schema)


def tagged_units(paragraphs: DataFrame, tables: Model, text: bool = True) -> DataFrame:
    """Rows (video_id, n, turn, ms, unit, opens, label, form, number, speech, clean, known_label, known_speech, known_clean) of the units of each paragraph (video_id, n, turn, ms, text).

    opens: a change marker stands before any word; label: a speaker's label, if its tokens are decoded as one (decoded as speech they are words); number: its number if it is a numbered one; speech: holds a
    word of speech; clean: the words of speech, null unless `text`; known_*: the same if the label means a known name, null where there is none.
    """
    return tagged_paragraphs(paragraphs, tables, text).select("video_id", "n", "turn", "ms", F.explode("units").alias("u")).select("video_id", "n", "turn", "ms", "u.*")


def _named(labels: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (video_id, label, speaker): what each label means among the names known for its recording; labels that mean none are left out.

    Candidates come from an equi-join on the recording and a word or initials, and for labels that fit none so, a word less one letter, so typos of one letter meet; each is then scored, the best wins,
    of equal ones the least name.
    """

    def keys(column: str, slips: bool):
        @F.pandas_udf(T.ArrayType(T.StringType()))
        def of(x: pd.Series) -> pd.Series:
            def one(raw: str) -> list[str]:
                words = fold_words(raw)
                out = {nick(w) for w in words} | ({d for w in words for d in deletions(w)} if slips else set(words))
                letters = [w[0] for w in words if w]
                if len(letters) > 1:
                    out.add("=" + "".join(sorted((letters[0], letters[-1]))))
                if len(words) == 1 and len(words[0]) in (2, 3):
                    out.add("=" + "".join(sorted((words[0][0], words[0][-1]))))
                return sorted(out)

            return x.map(one)

        return of(column)

    @F.pandas_udf(T.IntegerType())
    def score(label: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([match_label(a, b) for a, b in zip(label, name)], dtype="int32")

    people = known.select("video_id", "name").where("video_id is not null and name is not null").distinct()

    def best(some: DataFrame, slips: bool) -> DataFrame:
        left = some.select("video_id", "label", F.explode(keys("label", slips)).alias("key"))
        right = people.join(some.select("video_id").distinct(), "video_id", "left_semi").select("video_id", "name", F.explode(keys("name", slips)).alias("key"))
        pairs = left.join(right, ["video_id", "key"]).select("video_id", "label", "name").distinct()
        scored = pairs.withColumn("s", score("label", "name")).where("s > 0")
        return scored.groupBy("video_id", "label").agg(F.min(F.struct((-F.col("s")).alias("s"), "name"))["name"].alias("speaker"))

    # Who shares no word or initials with a name can only be a slip of all its words, which scores less than anything that does.
    exact = cut(best(labels, False))
    return exact.unionByName(best(labels.join(exact, ["video_id", "label"], "left_anti"), True))


def model(paragraphs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` paragraphs, the same at every run."""
    return fit(fit_texts(paragraphs, "text", sample))


def speech_units(paragraphs: DataFrame, known: DataFrame, sample: int = SAMPLE, text: bool = True) -> DataFrame:
    """Rows (video_id, n, unit, t, an, speaker, run, clean): the units that are speech, in their order of time (t, an, n, unit), and the run of one speaker each lies in.

    Texts are shuffled once, to drop repeated rows; what is scanned after that holds tags and labels only.
    """
    p = paragraphs.select("video_id", "n", "start_ms", "timestamp", "turn", "text").where("video_id is not null and n is not null")
    p = gathered(p, ["video_id", "n"], ["text", "turn", "start_ms", "timestamp"])
    p = p.withColumn("ms", milliseconds(F.col("start_ms"), F.col("timestamp")))
    tagged = cut(tagged_paragraphs(p, model(paragraphs, sample), text))
    labels = tagged.select("video_id", F.explode(F.array_distinct(F.transform("units", lambda u: u["known_label"]))).alias("label")).where("label is not null").distinct()
    names = cut(_named(labels, known))

    # A paragraph whose time cannot be read follows the one before it by n.
    own = F.when(F.col("ms").isNotNull(), F.struct("ms", "n"))
    tagged = last_value(tagged.withColumn("nb", F.floor(F.col("n") / BUCKET_N)), ["video_id"], "nb", ["n"], own, "at")
    u = tagged.select("video_id", "n", "turn", F.coalesce("at.ms", F.lit(-1)).alias("t"), F.coalesce("at.n", F.lit(-1)).alias("an"), F.explode("units").alias("u"))
    u = _join(u.withColumn("label", F.col("u.known_label")), names, ["video_id", "label"])
    means = F.col("speaker").isNotNull()
    # An opening before a colon or dash that means nobody is speech; in brackets it is a note.
    nobody = F.col("u.number").isNull() & F.col("u.label").isNotNull() & F.col("u.form").isin("colon", "dash")
    u = u.select(
        "video_id", "n", "u.unit", "t", "an", F.floor(F.col("t") / BUCKET_MS).alias("b"), "turn", "u.opens", F.coalesce("speaker", F.when(F.col("u.label").isNotNull(), F.concat(F.lit("speaker "), F.col("u.number").cast("string")))).alias("who"),
        F.when(means, F.col("u.known_speech")).otherwise(F.col("u.speech") | F.coalesce(nobody, F.lit(False))).alias("speech"), F.when(means, F.col("u.known_clean")).otherwise(F.col("u.clean")).alias("clean"),
    )
    return _runs(cut(_speakers(cut(u))))


_ORDER = ("t", "an", "n", "unit")


def _speakers(u: DataFrame) -> DataFrame:
    """The units of speech, with of (what a run has in common), speaker and c (changes of it so far in the bucket): the last label so far where the recording has labels, else the turn number.

    One window within buckets of time, one over a summary row a bucket. A missing turn number is the one before, plus one where a change marker opens the paragraph:
    with steps counted so far, it is the last (number - steps) plus the steps here.
    """
    first = F.col("unit") == 0
    step = F.when(first & F.col("turn").isNull() & F.col("opens"), 1).otherwise(0)
    here = Window.partitionBy("video_id", "b").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.withColumn("steps", F.sum(step).over(here))
    u = u.withColumn("name", F.last("who", ignorenulls=True).over(here)).withColumn("base", F.last(F.when(first, F.col("turn") - F.col("steps")), ignorenulls=True).over(here))
    end = F.max(F.struct(*_ORDER, "steps", "name", "base"))
    tops = u.groupBy("video_id", "b").agg(end.alias("e")).select("video_id", "b", "e.steps", "e.name", "e.base")
    past = Window.partitionBy("video_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("before", F.coalesce(F.sum("steps").over(past), F.lit(0)))
    tops = tops.withColumn("base0", F.last(F.col("base") - F.col("before"), ignorenulls=True).over(past)).withColumn("name0", F.last("name", ignorenulls=True).over(past))
    tops = tops.withColumn("labelled", F.max(F.col("name").isNotNull()).over(Window.partitionBy("video_id")))
    u = u.join(tops.select("video_id", "b", "before", "base0", "name0", "labelled"), ["video_id", "b"])
    number = F.coalesce(F.col("base") - F.col("before"), F.col("base0"), F.lit(0)) + F.col("steps") + F.col("before")
    name = F.coalesce("name", "name0", F.lit(""))
    of = F.when(F.col("labelled"), name).otherwise(number.cast("string"))
    s = u.select("video_id", "n", "unit", "t", "an", "b", "speech", "clean", of.alias("of"), F.when(F.col("labelled"), name).otherwise(F.lit("")).alias("speaker")).where("speech").drop("speech")
    # Changes from speech to speech, counted while the bucket is in order.
    order = Window.partitionBy("video_id", "b").orderBy(*_ORDER)
    s = s.withColumn("prev", F.lag("of").over(order))
    change = F.when(F.col("prev").isNotNull() & (F.col("prev") != F.col("of")), 1).otherwise(0)
    return s.withColumn("c", F.sum(change).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("prev")


def _runs(s: DataFrame) -> DataFrame:
    """Adds run: the number of the run of one speaker each unit of speech lies in, within its recording: changes in its bucket so far, and those of the buckets before, by one summary row a bucket."""
    at = F.struct(*_ORDER, "of", "c")
    tops = s.groupBy("video_id", "b").agg(F.min(at)["of"].alias("head"), F.max(at).alias("e")).select("video_id", "b", "head", F.col("e.of").alias("tail"), F.col("e.c").alias("c"))
    by = Window.partitionBy("video_id").orderBy("b")
    before = F.lag("tail").over(by)
    tops = tops.withColumn("new", F.when(before.isNull() | (before != F.col("head")), 1).otherwise(0))
    tops = tops.withColumn("start", F.sum(F.col("new") + F.col("c")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c"))
    s = s.join(tops.select("video_id", "b", "start"), ["video_id", "b"])
    return s.select("video_id", "n", "unit", "t", "an", "speaker", (F.col("start") + F.col("c")).alias("run"), "clean")


def speaker_turns(paragraphs: DataFrame, known: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows (video_id, first_n, last_n, ord, speaker): the clean turns of each recording, as in speech_units without their text.

    Repeated rows count once; of rows that share (video_id, n) but differ the least by text, turn, start_ms, timestamp stays; null keys are left out; null and blank texts hold no
    speech; a recording without speech has no turn; an unlabelled beginning of a labelled recording has speaker ''; further columns are ignored.
    """
    s = speech_units(paragraphs, known, sample, text=False)
    at = F.struct("t", "an", "n", "unit")
    runs = s.groupBy("video_id", "run", "speaker").agg(F.min(at).alias("a"), F.max(at).alias("z"))
    in_paragraph = Window.partitionBy("video_id", "a.n").orderBy("run")
    return runs.select("video_id", F.col("a.n").alias("first_n"), F.col("z.n").alias("last_n"), F.row_number().over(in_paragraph).alias("ord"), "speaker")


def turn_text(paragraphs: DataFrame, known: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows (video_id, run, speaker, t, an, n, unit, clean): the speech of each turn without labels, time marks, notes and fillers, in pieces of a line, as a turn may be of any length; their order is (run, t, an, n, unit)."""
    return speech_units(paragraphs, known, sample).select("video_id", "run", "speaker", "t", "an", "n", "unit", "clean")
