"""Speech transcripts of several layouts into clean, ordered speaker turns.

A finite-state line parser knows caption files (cue times between arrows, voice tags or labels, cue numbers), lines and
running text with time marks in brackets, lines led by a bare time, labels with a time behind them, and plain labelled
lines. From every line time mark, label, sound notes and standalone hesitations are taken off; lines are put in order
of time, lines without words are dropped, and following lines of one speaker become one turn.

What stands in brackets or stars is a sound note if it stands alone on its line, is in capitals, or names a sound
(``SOUNDS``); otherwise it is speech and stays, without stars. A label must look like a name and recur in the record,
be numbered, have a name's form (two capitalised parts), or stand in a record whose lines are labelled; words that
lead remarks (``REMARKS``) are none.

Labels of one speaker are matched within a record: numbered labels by number; names by case, spacing, order around a
comma, role in brackets, initial, or first name alone where only one full name of the record agrees.

Defined results: null, blank and unparsable texts give no turns; lines before any label belong to one unnamed speaker;
a line without a time keeps its place behind the line written before it; equal times keep the written order; repeated
rows give repeated turns.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOCK = r"(?:\d{1,3}:)?\d{1,3}:\d{2}(?:[.,]\d{1,3})?"
SECONDS = r"\d+(?:[.,]\d+)?\s*s?"
CUE = re.compile(rf"^\s*({CLOCK}|{SECONDS})\s*-->\s*(?:{CLOCK}|{SECONDS}).*$")
MARK = re.compile(rf"[\[(]\s*({CLOCK}|\d+(?:\.\d+)?\s*s)(?:\s*(?:-->|->|–|-)\s*(?:{CLOCK}|{SECONDS}))?\s*[\])]\s*")
VOICE = re.compile(r"<v(?:\.[^\s>]*)?\s+([^>]*)>")
LEAD = re.compile(rf"^\s*({CLOCK})(?:\s*(?:-->|->|[-–—])\s*{CLOCK})?(?:\s*[-–—|]\s+|\s+)(?=\S)")
LABEL_TIME = re.compile(rf"^\s*([^:\[\]()<>\n]{{1,60}}?)\s*[\[(]\s*({CLOCK})\s*[\])]\s*:\s*(.*)$")
#: Markup, transcribers' double brackets and music are never speech; the rest depends on what it says.
MARKUP = re.compile(r"\(\([^()]*\)\)|<[^<>]*>|♪[^♪\n]*♪|♪+")
ASIDE = re.compile(r"\(([^()]*)\)|\[([^\[\]]*)\]|\*([^*\n]+)\*")
#: How words for sounds begin.
SOUNDS = re.compile(
    r"\b(?:applau|music|laugh|chuckl|giggl|snicker|cough|sigh|sneez|sniff|gasp|groan|moan|cheer|clap|whistl|sobb|scream|yawn|hum(?:s|ming)\b|breath|inhal|exhal|paus|silen|inaudib|unintelligib|indistinct|"
    r"cross-?talk|overlapping|nois|static\b|beep|bleep|buzz|rings?\b|ringing|knock|slam|creak|footstep|background|thunder|rustl|clears? throat|snort|mumbl|murmur|sings?\b|singing|whisper|blank_audio|"
    r"lachen|lacht|applaus|musik|husten|seufz|räusper|rires?\b|musique|toux|soupir|risas?\b|aplauso|música|suspir|смех|смеётся|аплодис|музык|кашель|вздох)|笑|掌声|音乐|音楽|拍手|咳|박수|웃음|음악",
    re.IGNORECASE,
)
REMARKS = frozenset("note notes nb ps warning update question answer example summary todo re subject agenda action actions conclusion result results reminder tip hint well so yes no and but ok okay now then oh hey look listen right sure anyway actually basically honestly frankly maybe perhaps also still also thanks sorry please".split())
#: Sounds of hesitation that stand alone as a word, with the marks that follow them.
FILLER = re.compile(r"(?<![\w'’-])(?:u+h*m+|u+h+|e+r+m*|h+m+|m+h+m+|mm+|a+h+m*|e+h+m*|[äö]+h+m*|e+u+h+|h+e+u+|э+м*|э-э|[хг]м+|嗯+|呃+|额+|え[ーえ]+と?|えっと|う[ーう]+ん|음+|어+)(?![\w'’-])(?:\.\.\.|…|[,.，、。])?", re.IGNORECASE)
NUMBERED = re.compile(r"^(?:speaker|spk|sprecher|participant|s)[\s_#-]*0*(\d{1,3})$", re.IGNORECASE)
ROLE = re.compile(r"\s*\([^()]*\)\s*$")
NAME = re.compile(r"^[^\W\d_][^\W\d_.'’-]*\.?(?:,?\s+[^\W\d_][^\W\d_'’-]*\.?){0,3}$")
LABEL = re.compile(r"^\s*([^:：<>\[\]\n]{1,60}?)\s*(:\s|：|\s[-–—]\s)\s*(?=\S)|^\s*([^:：<>\[\]\n]{1,60}?)\s*[:：]\s*$")
WORD = re.compile(r"\w")


def clock_seconds(mark: str) -> float:
    mark = mark.strip().rstrip("s").strip().replace(",", ".")
    total = 0.0
    for part in mark.split(":"):
        total = total * 60 + float(part)
    return total


def _fold(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return " ".join(plain.split())


def _label_key(label: str) -> tuple[str, ...] | None:
    """('#', n) of a numbered label, (first, last) of a name, (first,) of a first name; None if it is no label."""
    bare = " ".join(ROLE.sub("", label).split())
    if m := NUMBERED.match(bare):
        return ("#", str(int(m[1])))
    if not NAME.match(bare):
        return None
    if "," in bare:
        last, _, first = bare.partition(",")
        bare = f"{first.strip()} {last.strip()}"
    parts = [p.rstrip(".") for p in _fold(bare).split()]
    parts = [p for p in parts if p]
    if not parts:
        return None
    return (parts[0],) if len(parts) == 1 else (parts[0], parts[-1])


def _is_shouted_or_titled(label: str) -> bool:
    return all(not w[0].islower() for w in re.findall(r"[^\W\d_]+", ROLE.sub("", label)))


def parse(text: str) -> list[tuple[float | None, str | None, str]]:
    """(time, label, words as written) of each line, in written order."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    raw: list[tuple[float | None, str]] = []
    state, cue = "head", None
    for i, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            state = "gap"
            continue
        if state == "head" and bare.lstrip("﻿").startswith("WEBVTT"):
            continue
        if m := CUE.match(bare):
            state, cue = "cue", clock_seconds(m[1])
            continue
        if bare.isdigit() and i + 1 < len(lines) and CUE.match(lines[i + 1].strip()):
            continue
        if state == "cue":
            raw.append((cue, bare))
            continue
        state = "text"
        if m := LABEL_TIME.match(bare):
            raw.append((clock_seconds(m[2]), f"{m[1]}: {m[3]}"))
            continue
        if m := LEAD.match(bare):
            raw.append((clock_seconds(m[1]), bare[m.end() :]))
            continue
        marks = list(MARK.finditer(bare))
        if not marks:
            raw.append((None, bare))
            continue
        if head := bare[: marks[0].start()].strip():
            raw.append((None, head))
        for m, after in zip(marks, [*(x.start() for x in marks[1:]), len(bare)], strict=True):
            raw.append((clock_seconds(m[1]), bare[m.end() : after].strip()))
    met: Counter[tuple[str, ...]] = Counter()
    labelled = 0
    for _, line in raw:
        m = LABEL.match(line)
        label = m and (m[1] or m[3])
        key = label and _label_key(label)
        if key and key[0] not in REMARKS and _is_shouted_or_titled(label):
            met[key] += 1
            labelled += (m[2] or ":").strip() in (":", "：")
            if len(key) == 2:
                met[key[:1]] += 1
    layout = 5 * labelled >= len(raw)
    out = []
    for time, line in raw:
        label = None
        if m := VOICE.match(line):
            label, line = m[1], line[m.end() :]
        elif m := LABEL.match(line):
            found = m[1] or m[3]
            if (key := _label_key(found)) and _is_label(found, key, line[m.end() :], met, layout):
                label, line = found, line[m.end() :]
        out.append((time, label, line))
    return out


def _is_label(found: str, key: tuple[str, ...], after: str, met: Counter, layout: bool) -> bool:
    """Whether what stands before a colon or dash names a speaker."""
    if key[0] == "#":
        return True
    if key[0] in REMARKS and len(key) == 1:
        return False
    known = met[key] + (met[key[:1]] if len(key) == 2 else 0)
    titled = _is_shouted_or_titled(found)
    if titled and (len(key) == 2 or met[key] > 1 or layout):
        return True
    if not titled and known:
        return True
    goes_on = after.lstrip("\"'“")[:1].islower() and WORD.search(clean(after))
    return not titled and len(key) == 2 and len(found.split()) == 2 and not goes_on


def clean(words: str) -> str:
    """The words of a line without sound notes and standalone hesitations; empty if none are left."""
    alone = not WORD.search(FILLER.sub(" ", ASIDE.sub(" ", MARKUP.sub(" ", words))))

    def aside(m: re.Match) -> str:
        said = next(x for x in m.groups() if x is not None)
        letters = [c for c in said if c.isalpha()]
        sound = alone or not letters or (all(c.isupper() for c in letters) and len(letters) > 2) or (len(said.split()) <= 4 and SOUNDS.search(said))
        return " " if sound else said if m[3] is not None else m[0]

    bare = ASIDE.sub(aside, MARKUP.sub(" ", words))
    bare = " ".join(FILLER.sub(" ", bare).split())
    bare = re.sub(r"\s+([,.;:!?…])", r"\1", bare).lstrip(",;: ")
    return bare if WORD.search(bare) else ""


def _speakers(labels: list[str]) -> dict[str, tuple[str, ...]]:
    """The speaker's key of each label of a record."""
    keys = {x: (_label_key(x) or ("?", _fold(x))) for x in dict.fromkeys(labels)}
    full = {k for k in keys.values() if len(k) == 2 and k[0] not in "#?" and len(k[0]) > 1}
    out = {}
    for label, key in keys.items():
        if key[0] == "#" or key[0] == "?" or key in full:
            out[label] = key
        elif len(key) == 2:  # an initial and a surname
            same = [f for f in full if f[1] == key[1] and f[0][0] == key[0][0]]
            alone = [k[0] for k in keys.values() if len(k) == 1 and k[0][0] == key[0][0] and not any(f[0] == k[0] for f in full)]
            out[label] = same[0] if len(same) == 1 else (alone[0],) if not same and len(set(alone)) == 1 else key
        else:
            same = [f for f in full if f[0] == key[0]] or ([f for f in full if f[1] == key[0]] if len(key[0]) > 1 else [])
            out[label] = same[0] if len(same) == 1 else key
    return out


def turns(text: str | None) -> list[tuple[int, int, str, str]]:
    """(turn_no, speaker_no, label first used, words) of a transcript."""
    if not text or not text.strip():
        return []
    lines = parse(text)
    at, timed = float("-inf"), []
    for time, label, words in lines:
        at = time if time is not None else at
        timed.append((at, label, words))
    timed.sort(key=lambda x: x[0])
    keys = _speakers([x for _, x, _ in timed if x is not None])
    numbers: dict[tuple[str, ...], int] = {}
    first: dict[tuple[str, ...], str] = {}
    out: list[list] = []
    now: tuple[str, ...] = ("?", "")
    for _, label, words in timed:
        if label is not None:
            now = keys[label]
            first.setdefault(now, " ".join(label.split()))
        if not (said := clean(words)):
            continue
        number = numbers.setdefault(now, len(numbers) + 1)
        if out and out[-1][1] == number:
            out[-1][3] += " " + said
        else:
            out.append([len(out) + 1, number, first.get(now, ""), said])
    return [tuple(x) for x in out]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(rid, *t) for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in turns(text)]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["rid", "turn_no", "speaker_no", "label", "words"])


def speaker_turns(transcripts: DataFrame) -> DataFrame:
    """``(rid, turn_no, speaker_no, label, words)``; ``transcripts`` has rid and transcript."""
    return transcripts.select("rid", "transcript").where(F.col("rid").isNotNull()).mapInArrow(_run, "rid string, turn_no long, speaker_no long, label string, words string")


def transcripts_of(current: DataFrame) -> DataFrame:
    """The transcript of each row of bundles: transcript_text, else full_text of its contents."""
    text = F.coalesce(F.get_json_object("contents", "$.transcript_text"), F.get_json_object("contents", "$.full_text"))
    return current.select("rid", text.alias("transcript"))
