"""Sentence units of whole texts in many languages and scripts.

Lines make the blocks: a blank line, and a line break before or after a heading or list line, end a unit. Inside a
block every end mark is a candidate. Marks inside a quotation, brackets or code that is closed in its block are no
boundaries themselves; what closes a sentence belongs to it. Every other candidate, whatever its mark, is classified
by a maximum-entropy model: over the kind of mark and what follows it (case, digits, script, punctuation), and for a
full stop, which is the most ambiguous, also over the tokens around it, their length, inner stops and digits.

The model is trained on reliable places only, of about ``TRAINING_DOCS`` texts (those with the least hashes of
their ids, twice as many at most): a mark at the end of a paragraph or list line is a boundary, a mark before a
lower-case letter or a comma is none. Tokens that are frequent and never end a paragraph give further reliable non-boundaries. A short list of
abbreviations (``NEVER_LAST``) enters as one feature, so that a small table is served as well.

Positions are 0-based half-open code points, without white space at the ends. Null and blank texts have no units; a
text without any mark is one unit per block; repeated texts give the same units for each row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_DOCS = 3000

#: Abbreviations that hardly ever end a sentence, written without their last stop.
NEVER_LAST = frozenset(
    "mr mrs ms dr prof st rev gen sen rep capt lt col no nos fig figs eq vol ch sec p pp cf e.g i.e vs approx ca dept univ jan feb mar apr jun jul aug sep sept oct nov dec "
    "hr hrn fr nr z bzw d.h u.a s bd abs geb mio mrd evtl ggf inkl zzgl "
    "m mm mme mlle p.ex ex env chap art av "
    "sr sra srta dr dra pág págs núm ej av ud uds "
    "г гг ул ок тыс млн млрд т т.е т.д т.п им д п см "
    "κ κα π.χ δηλ βλ αρ σελ डॉ श्री प्रो ዶ ዶ.ር".split()
)

END = r".!?…。！？।۔؟።።។٭;；"
CLOSERS = "\"'”’»）)」』]】›"
CANDIDATE = re.compile(r"(?:[.!?…]+|[。！？]+|[।۔؟።።។]+|;)([\"'”’»）)」』\]】›]*|[  ]»)(?=\s|$|[^\W\d_]|[“«„「『(（\"])|[」』”»][ ]*", re.UNICODE)
HEADING = re.compile(r"\s*#{1,6}(?:\s|$)")
BULLET = re.compile(r"\s*[-*+•]\s")
NUMBERED = re.compile(r"\s*\d{1,3}[.)]\s")
PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "(": ")", "（": "）", "`": "`", '"': '"'}
OPENING = re.compile(r"[“«„「『(（`\"]")
FIXED = frozenset("。！？।۔؟።።។")
TRAINED = re.compile(r"\.+(?=[\s\"'”’»)]|$)|[!?…]+|[。！？।۔؟።។]")
GLUED = re.compile(r"[^\W\d_]{2,}\.[^\W\d_]")
TOKEN_BEFORE = re.compile(r"\S+$")
THAI_GAP = re.compile(r"(?<=[฀-๿])[  \t]+(?=[฀-๿])")
ATTRIBUTION = ("と", "って", "，", "、", ",", ";", "；", "—", "–", "-")


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is a heading or list line) of the blocks of lines."""
    start, at, end_of, listed_before = -1, 0, 0, True
    for line in text.split("\n"):
        end = at + len(line)
        bare = line.strip()
        if not bare:
            if start >= 0:
                yield start, end_of, False
                start = -1
            listed_before = True
        else:
            first = bare[0]
            marked = (first == "#" and HEADING.match(line)) or (first in "-*+•" and BULLET.match(line)) or (first.isdigit() and listed_before and NUMBERED.match(line))
            if marked:
                if start >= 0:
                    yield start, end_of, False
                    start = -1
                yield at, end, True
                listed_before = True
            else:
                if start < 0:
                    start = at
                end_of, listed_before = end, False
        at = end + 1
    if start >= 0:
        yield start, end_of, False


def _protected(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost closed quotations, brackets and code of a block, in order."""
    out, at = [], start
    never: set[str] = set()  # marks that no close follows, so that each is looked for to the end only once
    while m := OPENING.search(text, at, end):
        i = m.start()
        mark = text[i]
        close = PAIRS[mark]
        stop = -1
        if mark not in never:
            stop = min((k for c in close if (k := text.find(c, i + 1, end)) >= 0), default=-1)
        if stop < 0:
            never.add(mark)
            at = i + 1
            continue
        if mark in "(（" and (inner := text.find(mark, i + 1, stop)) >= 0:  # one level of nesting
            again = text.find(close, stop + 1, end)
            stop = again if again >= 0 and inner >= 0 else stop
        out.append((i, stop))
        at = stop + 1
    return out


def _shape(c: str) -> str:
    if not c:
        return "end"
    if c.isupper():
        return "up"
    if c.islower():
        return "low"
    if c.isdigit():
        return "num"
    if c.isalpha():
        return "let"
    if c in "“«„\"'(（「『¿¡‘`":
        return "open"
    if c in ",;:)]—–-%":
        return "mid"
    return "sym"


def _script(c: str) -> str:
    o = ord(c) if c else 0
    return "L" if o < 0x250 else "G" if o < 0x400 else "C" if o < 0x530 else "A" if 0x590 <= o < 0x780 else "D" if 0x900 <= o < 0x980 else "E" if 0x1200 <= o < 0x13A0 else "O"


_DIGITS = re.compile(r"\d+")


def normal(token: str) -> str:
    return _DIGITS.sub("9", token.lower().lstrip("([{“«„\"'¿¡`*#-"))


def kind_of(mark: str) -> str:
    return "fixed" if mark in FIXED else "…" if mark in ".…" and mark != "." else "!" if mark in "!?" else mark


def features(prev2: str, prev: str, shape: str, following: str, script: str, mark: str = ".") -> list[str]:
    """Names of the features of a candidate; prev is the token before it, without the mark.

    mark is the kind of the mark: a full stop, "!" (also ?), "…" (also ...), fixed (used for nothing else), close
    (behind closing quotes or brackets), glued (no blank behind it) or ; (the Greek question mark).
    """
    if mark != ".":
        return ["bias", f"s={shape}", f"m={mark}", f"m={mark} {shape}", f"m={mark} {script}", f"m={mark} n={following}", "", "", ""]
    bare = prev.rstrip(".")
    return [
        "bias",
        f"s={shape}",
        f"p={bare}",
        f"pp={prev2} {bare}",
        f"ps={bare} {shape}",
        f"n={following}",
        f"len={min(6, len(bare))}{'.' if '.' in bare else ''}{'9' if '9' in bare else ''} {script}",
        f"len={min(6, len(bare))}{'.' if '.' in bare else ''}{'9' if '9' in bare else ''} {shape}",
        f"abbr={bare in NEVER_LAST or (len(bare) == 1 and bare.isalpha())} {'up' if shape in ('up', 'open') else shape}",
    ]


_NEXT = re.compile(r"\s*(\S+)")


def _token(text: str, start: int, at: int) -> int:
    """Where the token that ends at ``at`` starts."""
    while at > start and not text[at - 1].isspace():
        at -= 1
    return at


def _around(text: str, start: int, at: int, after: int, end: int, mark: str = ".") -> tuple[str, str, str, str, str, str]:
    """The context of the mark at ``at`` inside a block; ``after`` is the first position behind its closers."""
    prev = prev2 = ""
    if mark == ".":
        i = _token(text, start, at)
        prev, prev2 = normal(text[i:at]), "^"
        while i > start and text[i - 1].isspace():
            i -= 1
        if i > start:
            prev2 = normal(text[_token(text, start, i) : i])
    tail = _NEXT.match(text, after, end)
    word = tail[1] if tail else ""
    c = word[:1]
    if c in "“«„\"'(（「『¿¡‘`" and len(word) > 1 and c:
        c2 = word[1:2]
        shape = "open" if not c2.islower() else "low" if c in "(`'" else "open"
    else:
        shape = _shape(c)
    following = word.strip(".,;:!?\"“”„«»()[]").lower()
    last = text[at - 1] if at > start else ""
    return prev2, prev, shape, _DIGITS.sub("9", following), _script(last), mark


class Boundaries:
    """A maximum-entropy classifier of stops."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}
        self.known: dict[tuple, bool] = {}

    def ends(self, context: tuple[str, str, str, str, str]) -> bool:
        held = self.known.get(context)
        if held is None:
            w = self.weights
            held = sum(w.get(f, 0.0) for f in features(*context)) > 0
            if len(self.known) < 500_000:
                self.known[context] = held
        return held


#: What is believed before any training, as weights of the shape, abbreviation and mark features.
PRIOR = {
    "s=low": -6.0, "s=mid": -6.0, "s=up": 1.5, "s=open": 1.5, "s=num": 0.0, "s=let": 1.5, "s=end": 4.0, "s=sym": 0.5, "abbr=True up": -5.0, "abbr=True let": -5.0, "abbr=True num": -3.0, "abbr=True open": -4.0, "bias": 0.5,
    "m=!": 4.0, "m=…": 4.0, "m=fixed": 4.0, "m=fixed low": 8.0, "m=close": 4.0, "m=close mid": 7.0, "m=glued": 6.0, "m=;": 4.0, "m=; mid": 7.0, "m=! mid": 3.0,
}


def train(texts: list[str], rounds: int = 12, rate: float = 0.4, decay: float = 1e-4) -> Boundaries:
    """Fits the weights by stochastic gradient steps (step sizes by accumulated squares) from the prior."""
    seen: Counter[str] = Counter()
    last: Counter[str] = Counter()
    pairs: Counter[str] = Counter()
    last_pairs: Counter[str] = Counter()
    reliable: list[tuple[tuple, int]] = []
    open_: list[tuple] = []
    starts: list[tuple[str, str]] = []
    finals: list[tuple] = []
    for text in texts:
        for start, end, listed in blocks(text):
            stripped = len(text[start:end].rstrip()) + start
            if not listed or not HEADING.match(text[start:end]):
                first = _NEXT.match(text, start, end)
                first = _NEXT.match(text, first.end(), end) if listed and first else first
                if first:
                    starts.append((_shape(first[1][:1]), _DIGITS.sub("9", first[1].strip(".,;:!?\"“”„«»()[]").lower())))
            for m in TRAINED.finditer(text, start, end):
                at, after = m.start(), m.end()
                while after < stripped and text[after] in CLOSERS:
                    after += 1
                mark = "…" if m.end() - at > 1 and text[at] == "." else kind_of(text[at])
                context = _around(text, start, at, after, stripped, mark)
                if mark != ".":
                    if after >= stripped and starts:
                        shape, word = starts[(len(reliable) * 7919) % len(starts)]
                        reliable.append(((*context[:2], shape, word, *context[4:]), 1))
                    elif context[2] == "low" and mark in "!…":
                        reliable.append((context, 0))
                    continue
                if not context[1]:
                    continue
                bare = context[1].rstrip(".")
                seen[bare] += 1
                pairs[f"{context[0]} {bare}"] += 1
                if after >= stripped:
                    last[bare] += 1
                    last_pairs[f"{context[0]} {bare}"] += 1
                    if not HEADING.match(text[start:end]):
                        finals.append(context)
                elif context[2] in ("low", "mid"):
                    reliable.append((context, 0))
                elif text[after : after + 1].isspace():
                    open_.append(context)
    base = sum(last.values()) / max(1, sum(seen.values()))
    for i, c in enumerate(finals):  # what follows a reliable boundary is how some paragraph starts
        shape, word = starts[(i * 7919) % len(starts)] if starts else ("up", "")
        reliable.append(((c[0], c[1], shape, word, c[4], "."), 1))
    for c in open_:
        bare = c[1].rstrip(".")
        pair = f"{c[0]} {bare}"
        if (seen[bare] * base >= 4 and last[bare] <= 0.02 * seen[bare] * base) or (pairs[pair] * base >= 4 and last_pairs[pair] <= 0.02 * pairs[pair] * base):
            reliable.append((c, 0))
    if not reliable:
        return Boundaries(dict(PRIOR))
    index: dict[str, int] = {f: i for i, f in enumerate(PRIOR)}
    rows = []
    for c, _ in reliable:
        rows.append([index.setdefault(f, len(index)) for f in features(*c)])
    x = np.asarray(rows, dtype=np.int64)
    y = np.asarray([label for _, label in reliable], dtype=float)
    balance = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())) if 0 < y.mean() < 1 else np.ones(len(y))
    weights = np.zeros(len(index))
    weights[: len(PRIOR)] = list(PRIOR.values())
    prior = weights.copy()
    squares = np.full(len(index), 1.0)
    random = np.random.default_rng(11)
    for _ in range(rounds):
        for part in np.array_split(random.permutation(len(y)), max(1, len(y) // 512)):
            score = weights[x[part]].sum(axis=1)
            slope = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[part]) * balance[part]
            gradient = np.bincount(x[part].ravel(), weights=np.repeat(slope, x.shape[1]), minlength=len(index))
            gradient += decay * len(part) * (weights - prior)
            squares += gradient * gradient
            weights -= rate * gradient / np.sqrt(squares)
    return Boundaries({f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-3})


def _block_ends(text: str, start: int, end: int, model: Boundaries) -> list[int]:
    """Positions inside the block where a unit ends (its end itself not among them)."""
    out: list[int] = []
    spans = _protected(text, start, end) if OPENING.search(text, start, end) else []
    k = 0
    for m in CANDIDATE.finditer(text, start, end):
        at, after = m.start(), m.end()
        mark = text[at]
        while k < len(spans) and spans[k][1] < at:
            k += 1
        close = -1
        if k < len(spans) and spans[k][0] < at <= spans[k][1]:
            close = spans[k][1]
            if close >= after or text[spans[k][0]] == "`":
                continue  # inside a quotation that goes on
            if mark in "」』”»":
                # closes without a mark of its own here; the mark, if any, was a candidate that ended in these closers
                continue
            if close < after - 1:
                after = close + 1
                while after < m.end() and text[after] in CLOSERS:
                    after += 1
        elif mark in "」』”»":
            continue
        while after > at + 1 and text[after - 1].isspace():
            after -= 1
        if after >= end:
            continue
        nxt = text[after]
        gap = nxt.isspace()
        skip = after
        while skip < end and (text[skip].isspace() or text[skip] in "​‌‍‎‏‪‬‮﻿"):
            skip += 1
        if skip >= end:
            continue
        first = text[skip]
        if mark == ";":
            if not gap or _script(text[at - 1] if at > start else "") != "G" or first.islower():
                continue
            if model.ends(_around(text, start, at, after, end, ";")):
                out.append(after)
            continue
        if close >= 0 or (after > at + 1 and text[after - 1] in CLOSERS):
            # a sentence ends in a closing mark: the text goes on in lower case, after a comma, or with an attribution
            if first.islower() or text.startswith(ATTRIBUTION, skip):
                continue
            if not gap and not (mark in FIXED or ord(first) > 0x2E7F):
                continue
            if text[after - 1] in ")）" and mark == "." and not _whole_bracket(text, spans, k, start):
                continue
            if model.ends(_around(text, start, at, after, end, "close")):
                out.append(after)
            continue
        if mark in FIXED:
            if first in ",;:)）、，" or first in "」』”»":
                continue
            if model.ends(_around(text, start, at, after, end, "fixed")):
                out.append(after)
            continue
        if not gap:
            # no blank behind the mark: only between a word and a capitalised word
            token = text[_token(text, start, at) : at]
            rest = _NEXT.match(text, after, end)[1]
            apart = mark in ".!?" and after == at + 1 and first.isupper() and len(token) > 1 and token.isalpha() and token[-1].islower() and token[1:].islower() and rest[1:2].islower() and rest.rstrip(".,;:!?)").isalpha()
            if (apart or (mark in "!?" and ord(first) > 0x2E7F)) and model.ends(_around(text, start, at, after, end, "glued")):
                out.append(after)
            continue
        if first.islower() or first in ",;:)]–—-%»":  # no candidate, but for a dash that opens speech
            if not (first in "-–—" and text[skip + 1 : skip + 2].isspace() is False and mark in "!?"):
                continue
        kind = "." if mark == "." and after == at + 1 else "…" if mark in ".…" else kind_of(mark)
        if model.ends(_around(text, start, at, after, end, kind)):
            out.append(after)
    return out


def _whole_bracket(text: str, spans: list[tuple[int, int]], k: int, start: int) -> bool:
    """Whether the bracket began a unit of its own, as in "(All of it.)"."""
    if k >= len(spans):
        return True
    i = spans[k][0] - 1
    while i >= start and text[i].isspace():
        i -= 1
    return i < start or text[i] in END or text[i] in CLOSERS


def units(text: str | None, model: Boundaries) -> list[tuple[int, int]]:
    """Half-open code point ranges of the sentence units of a text."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    for start, end, listed in blocks(text):
        ends = [] if listed and HEADING.match(text, start, end) else _block_ends(text, start + (len(NUMBERED.match(text, start, end)[0]) if listed and NUMBERED.match(text, start, end) else 0), end, model)
        part = text[start:end]
        if not part.isascii() and THAI_GAP.search(part):
            ends = sorted({*ends, *(start + m.start() for m in THAI_GAP.finditer(part))})
        at = start
        for stop in (*ends, end):
            a, b = at, stop
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if b > a:
                out.append((a, b))
            at = stop
    return out


def fit(documents: DataFrame, limit: int = TRAINING_DOCS) -> Boundaries:
    """The classifier fitted on about ``limit`` texts with the least hashes of doc_id."""
    n = documents.count()
    share = min(1.0, limit / max(1, n))
    rows = documents.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)) < share).where("text is not null").orderBy("doc_id").select("text").limit(2 * limit).toArrow()
    return train(rows.column("text").to_pylist())


def _runner(weights: dict[str, float], with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Boundaries(weights)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [units(t, model) for t in texts]
            counts = np.fromiter((len(x) for x in found), dtype=np.int64, count=len(found))
            flat = np.asarray([p for x in found for p in x], dtype=np.int64).reshape(-1, 2)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), counts)))
            columns = [ids, pa.array(flat[:, 0]), pa.array(flat[:, 1])]
            names = ["doc_id", "start_pos", "end_pos"]
            if with_text:
                columns.append(pa.array([t[a:b] for t, x in zip(texts, found, strict=True) for a, b in x], type=pa.string()))
                names.append("sentence")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def sentences(documents: DataFrame, model: Boundaries | None = None, with_text: bool = False) -> DataFrame:
    """``(doc_id, start_pos, end_pos[, sentence])`` of every text; ``documents`` has doc_id (long) and text."""
    docs = documents.select("doc_id", "text")
    model = model or fit(docs)
    schema = "doc_id long, start_pos long, end_pos long" + (", sentence string" if with_text else "")
    return docs.where(F.col("text").isNotNull()).mapInArrow(_runner(model.weights, with_text), schema)
