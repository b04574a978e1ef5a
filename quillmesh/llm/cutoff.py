"""Texts cut off by field limits or broken transfers.

1. Copies. Every version's search_text and the text that its contents make are signed: word shingles of five, min-hash
   bands over their prefixes of 8, 16, 32 ... shingles (a cut copy shares the prefixes of the whole one, so similarity
   is that of equal lengths, and bands of three rows find 0.8 and more). A row's own contents are one copy among the
   others. Per band the longest copy is tried first, by a max that combines on the map side, so copies of a text,
   however many, make no group of pairs. A text that ends within a sentence and isn't found so is then laid along every
   other text of its bands that holds its last four whole words, joined on their hash; no other copy can show a cut.
2. Alignment, once for each pair of different texts. A text is cut off where all of it matches (at least 0.8 of its
   shingles in the stretch, and its last words) and the copy goes on; another row's copy, which may be a longer
   edition, must go on within the sentence. An exact check follows for rows that no band has found: the text of their
   own contents and, for texts too short for a band, of their earlier versions.
3. Terminality, for rows without a longer copy. Over the words of all current texts it is counted how often each one
   closes a sentence, line or text. A text is cut off if it ends in a broken character, in a joining mark or within an
   open quotation; otherwise a classifier looks at how rarely its last word closes, and how much more frequent a word
   is that begins with it. It is trained on rows whose ends are known: those whose copies go on, and those that hold
   all that their contents make (at most ``LABELLED`` of each, those with the least hashes).

Defined results: null, empty and blank search_text is never cut off; unparsable contents give no copy; padding at the
ends is ignored; a text that merely lacks its full stop is complete; repeated rows of a rid count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.bundles import search_text
from quillmesh.runtime import durable, latest, stored

SHINGLE = 5
FIRST_LEVEL = 8
BANDS, ROWS = 5, 3
SIMILARITY = 0.8
#: Rows of each kind that the classifier of endings is fitted on at most.
LABELLED = 10_000
#: What is believed before any training: bias, weight of a more frequent longer word, weight of closing more often
#: than words do on average. It counts as much as ``PRIOR_ROWS`` rows.
PRIOR = (-2.5, 1.0, 1.0)
PRIOR_ROWS = 20.0
#: Uses of a word that its share of closing ones is smoothed by, and uses that a longer word must have to be evidence.
SMOOTHING, LEAST_USES = 10.0, 5
BROKEN = "�"
EDGES = " \t\n\r\f\v\u00a0\u2002\u2003\u2009\u202f\u3000"

_random = np.random.default_rng(20_240_601)
_A = (_random.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: A word, with the combining marks of the scripts that write vowels by them.
_W = r"[\w\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0900-\u0963\u0e31-\u0e3a\u0e47-\u0e4e\u17b4-\u17d3]"
_BEHIND = r"(?=[\"”’»）)」』\]`*]*+(?:[.!?…。！？।۔؟።។;|]|[^\S\n]*+(?:\n|\Z)))"
WORD = re.compile(rf"{_W}++(?:['’.\-]{_W}++)*+")
CLOSER = re.compile(rf"({_W}++(?:['’.\-]{_W}++)*+){_BEHIND}")
#: The same for texts of ASCII alone, which is most of the work.
PLAIN_WORD = re.compile(r"[a-z0-9_]++(?:['.\-][a-z0-9_]++)*+")
PLAIN_CLOSER = re.compile(r"([a-z0-9_]++(?:['.\-][a-z0-9_]++)*+)(?=[\")\]`*]*+(?:[.!?;|]|[ \t\r\f\v]*+(?:\n|\Z)))")
MARKS = ".!?…。！？।۔؟።។"
CLOSERS = "\"”’“»）)」』]`*_"
MARK_END = re.compile(rf"[{MARKS}][{re.escape(CLOSERS)}]*$")
MARK_START = re.compile(r"[\"”’“»）)」』\]`*_]*[.!?…。！？।۔؟።។]")
JOINING = re.compile(r"[,，、(\[{（「『«„|/\\&+=<:：–—-]$")
ENCODED = re.compile(r"(?:^|\s)[A-Za-z0-9+/=]{40,}$")
ADDRESS = re.compile(r"https?://\S+$")
TASK = re.compile(r"\s*[-*+] \[[ xX]\] ")
CLAUSES = re.compile(r"[぀-ヿ一-鿿ក-៿]")
#: Scripts without blanks, each character of which counts as a word of a shingle.
UNSPACED = r"\u3040-\u30ff\u3400-\u9fff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
PIECES = re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")
_QUOTES = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』"}


def _tokens(word: str) -> list[str]:
    """A word, or the pairs of characters of a script that writes no blanks."""
    if CLAUSES.search(word):
        return [word[i : i + 2] for i in range(len(word) - 1)] or [word]
    return [word]


def _last_token(word: str) -> str:
    return word[-2:] if CLAUSES.search(word) else word


def _rolled(split: list[list[str]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each word on, over all texts in a row; where each text starts; its size."""
    sizes = np.fromiter((len(w) for w in split), dtype=np.int64, count=len(split))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    if not sizes.sum():
        return np.empty(0, dtype=np.uint64), starts, sizes
    hashes = pd.util.hash_array(np.asarray([w for ws in split for w in ws], dtype=object), categorize=True)
    rolled = np.zeros(len(hashes), dtype=np.uint64)
    for j in range(min(width, len(hashes))):
        rolled[: len(hashes) - j] = rolled[: len(hashes) - j] * _MIX + hashes[j:]
    return rolled, starts, sizes


def _split(texts: list[str]) -> list[list[str]]:
    return [t.split() if t.isascii() else PIECES.findall(t) for t in texts]


def signatures(texts: list[str]) -> list[np.ndarray]:
    """Band keys of every prefix level of each text, least level first; none under 8 shingles.

    Characters of scripts without blanks are words of their own.
    """
    rolled, starts, sizes = _rolled(_split(texts), SHINGLE)
    out = [np.empty(0, dtype=np.int64)] * len(texts)
    counts = np.maximum(sizes - SHINGLE + 1, 0)
    which = np.flatnonzero(counts >= FIRST_LEVEL)
    if not len(which):
        return out
    levels = np.floor(np.log2(counts[which] / FIRST_LEVEL)).astype(np.int64) + 1
    most = int(levels.max())
    bounds = [np.zeros(len(which), dtype=np.int64), *(np.full(len(which), FIRST_LEVEL << k, dtype=np.int64) for k in range(most))]
    keys = np.zeros((len(which), most, BANDS), dtype=np.uint64)
    for k in range(most):
        live = np.flatnonzero(levels > k)
        begin, end = starts[which[live]] + bounds[k][live], starts[which[live]] + bounds[k + 1][live]
        lengths = end - begin
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        part = rolled[at]
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        if k == 0:
            least = np.full((BANDS * ROWS, len(which)), np.iinfo(np.uint64).max, dtype=np.uint64)
        for p in range(BANDS * ROWS):
            mixed = part * _A[p] + _B[p]
            mixed ^= mixed >> np.uint64(29)
            least[p, live] = np.minimum(least[p, live], np.minimum.reduceat(mixed, first))
        for b in range(BANDS):
            key = np.full(len(live), np.uint64(k * BANDS + b + 1), dtype=np.uint64)
            for r in range(ROWS):
                key = (key ^ least[b * ROWS + r, live]) * _MIX
                key ^= key >> np.uint64(32)
            keys[live, k, b] = key
    for i, t in enumerate(which):
        out[t] = keys[i, : levels[i]].ravel().view(np.int64)
    return out


def _lists(made: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
    flat = np.concatenate(made) if made else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int64()))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the band keys of body and made."""
    for batch in batches:
        keys = [_lists(signatures(batch.column(batch.schema.get_field_index(c)).to_pylist())) for c in ("body", "made")]
        yield pa.RecordBatch.from_arrays([*batch.columns, *keys], names=[*batch.schema.names, "keys", "made_keys"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_id, words, hash of the last four words before the last one) of texts of six words or more."""
    for batch in batches:
        rolled, starts, sizes = _rolled(_split(batch.column(1).to_pylist()), SHINGLE - 1)
        long = np.flatnonzero(sizes > SHINGLE)
        at = starts[long] + sizes[long] - SHINGLE
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(long)), pa.array(sizes[long].astype(np.int32)), pa.array(rolled[at].view(np.int64))], names=["text_id", "words", "gram"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(copy_id, at, hash of the four words from there on) of every place of the texts."""
    for batch in batches:
        rolled, starts, sizes = _rolled(_split(batch.column(1).to_pylist()), SHINGLE - 1)
        n = np.maximum(sizes - SHINGLE + 1, 0)  # a word must follow
        which = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.empty(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(at.astype(np.int32)), pa.array(rolled[starts[which] + at].view(np.int64))], names=["copy_id", "at", "gram"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain, wide = [], []
        for text in batch.column(0).to_pylist():
            (plain if text.isascii() else wide).append(text.lower())
        text = "\n".join(plain)
        met, closed = Counter(PLAIN_WORD.findall(text)), Counter(PLAIN_CLOSER.findall(text))
        text = "\n".join(wide)
        for word, n in Counter(WORD.findall(text)).items():
            for t in _tokens(word):
                met[t] += n
        for word, n in Counter(CLOSER.findall(text)).items():
            closed[_last_token(word)] += n
        words = list(met)
        yield pa.RecordBatch.from_arrays([pa.array(words, type=pa.string()), pa.array([met[w] for w in words], type=pa.int64()), pa.array([min(met[w], closed[w]) for w in words], type=pa.int64())], names=["word", "met", "closed"])


def closing(text: str) -> tuple[bool, str | None, bool]:
    """(visibly cut off, word to be judged, whether only a broken word tells) of a trimmed text.

    Addresses and task list items don't end as sentences do, so only a broken last word shows that they are cut.
    """
    if text.endswith(BROKEN):
        return True, None, False
    if text.startswith('{"'):
        return not text.endswith("}"), None, False
    if MARK_END.search(text, max(0, len(text.rstrip(CLOSERS)) - 1)) or ENCODED.search(text, max(0, text.rfind(" "))):
        return False, None, False
    tail = text.rsplit("\n", 1)[-1]
    address = bool(ADDRESS.search(tail))
    if not address:
        if JOINING.search(text[-1:]):
            return True, None, False
        for opening, closes in _QUOTES.items():
            i = tail.rfind(opening)
            if i >= 0 and not any(c in tail[i + 1 :] for c in closes) and not (opening == "“" and "„" in tail[:i]):
                return True, None, False
        if tail.count('"') % 2 and not re.search(r'\d"', tail):
            return True, None, False
    low = text.rsplit(None, 1)[-1].lower()
    words = WORD.findall(low)
    word = words[-1] if words and low.endswith(words[-1]) else None
    if word and address:
        word = re.split(r"[.\-]", word)[-1]
        word = None if not word or word.isdigit() else word
    return False, _last_token(word) if word else None, address or bool(TASK.match(tail))


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = [closing(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([s[i] for s in seen], type=k) for i, k in enumerate((pa.bool_(), pa.string(), pa.bool_())))], names=["rid", "broken", "word", "strict"])


def ends_early(text: str, copy: str, own: bool = True) -> bool:
    """Whether all of ``text`` matches a stretch of ``copy`` that goes on behind it.

    A copy that isn't the text's own source may be a longer edition of a complete text; it counts only where the text
    ends within a sentence.
    """
    bare = text.rstrip(BROKEN + EDGES)
    if not bare or len(copy) <= len(bare):
        return False
    if not own and MARK_END.search(text, max(0, len(text.rstrip(CLOSERS)) - 1)):
        return False
    if copy.startswith(bare):
        rest = copy[len(bare) :].strip(EDGES)
        return bool(rest) and (own or not MARK_START.match(rest))
    words, others = bare.split(), copy.split()
    if len(words) < SHINGLE + 1 or len(others) <= len(words) * SIMILARITY:
        return False
    tail, part = words[-SHINGLE:-1], words[-1]
    for at in range(min(len(others) - SHINGLE, int(len(words) * 1.25)), max(-1, int(len(words) * SIMILARITY) - SHINGLE - 1), -1):
        if others[at : at + SHINGLE - 1] == tail and others[at + SHINGLE - 1].startswith(part):
            behind = others[at + SHINGLE - 1][len(part) :] or others[at + SHINGLE :]
            if not behind or (not own and isinstance(behind, str) and MARK_START.match(behind)):
                return False
            mine = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE)}
            its = {tuple(others[i : i + SHINGLE]) for i in range(min(len(others) - SHINGLE + 1, at + SHINGLE))}
            return len(mine & its) >= SIMILARITY * len(mine)
    return False


_ALIGNED = "text_id long, copy_id long, any boolean"


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_id, copy_id, whether the copy tells even of another row) of (text_id, body, copy_id, copy) that align."""
    for batch in batches:
        pairs = list(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True))
        own = [ends_early(*p) for p in pairs]
        other = pa.array([o and ends_early(*p, False) for o, p in zip(own, pairs, strict=True)], type=pa.bool_())
        mask = pa.array(own, type=pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(2).filter(mask), other.filter(mask)], names=["text_id", "copy_id", "any"])


def _align_rows(own: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [ends_early(a, b, own) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, type=pa.bool_()))], names=["rid"])

    return run


def fit_endings(rows: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights (bias, longer word, closing) of a logistic classifier of rows (longer, closing, cut, weight), by Newton
    steps around ``PRIOR``."""
    prior = np.asarray(PRIOR)
    if not len(rows):
        return prior
    x = np.column_stack([np.ones(len(rows)), rows[:, 0], -rows[:, 1]])
    sign = np.where(rows[:, 2] > 0, 1.0, -1.0)

    def loss(w: np.ndarray) -> float:
        return float((np.logaddexp(0, -sign * (x @ w)) * rows[:, 3]).sum() + PRIOR_ROWS / 2 * ((w - prior) ** 2).sum())

    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ ((p - rows[:, 2]) * rows[:, 3]) + PRIOR_ROWS * (w - prior)
        bend = (x * (p * (1 - p) * rows[:, 3])[:, None]).T @ x + PRIOR_ROWS * np.eye(3)
        step, far, now = np.linalg.solve(bend, slope), 1.0, loss(w)
        while loss(w - far * step) > now and far > 1e-6:
            far /= 2
        w = w - far * step
        if np.abs(step).max() < 1e-9 or far <= 1e-6:
            break
    return np.asarray([w[0], max(0.0, w[1]), max(0.0, w[2])])


def _texts(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``(name_id, name)``: the texts of ``ids`` (text_id), each looked up once."""
    every = rows.select(F.explode(F.array(F.struct("text_id", "body"), F.struct(F.col("made_id").alias("text_id"), F.col("made").alias("body")))).alias("t")).select("t.*").where("text_id is not null")
    return every.join(ids.distinct(), "text_id", "left_semi").dropDuplicates(["text_id"]).select(F.col("text_id").alias(f"{name}_id"), F.col("body").alias(name))


def _compared(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (text_id, copy_id) of texts that align, with ``any``."""
    texts = _texts(rows, pairs.select("text_id"), "text")
    copies = _texts(rows, pairs.select(F.col("copy_id").alias("text_id")), "copy")
    return pairs.join(texts, "text_id").join(copies, "copy_id").select("text_id", "text", "copy_id", "copy").mapInArrow(_align, _ALIGNED)


def truncated(bundles: DataFrame) -> DataFrame:
    """``(rid, namespace, how)`` of the current rows whose search_text is cut off.

    how is copy (found through the bands or an earlier version), contents (by the exact check of a row's own contents)
    or ending.
    """
    bare = lambda c: F.trim(F.coalesce(c, F.lit("")), F.lit(EDGES))
    texts = bundles.where(F.col("rid").isNotNull()).select("rid", "updated_at", "namespace", bare(F.col("search_text")).alias("body"), bare(F.when(F.get_json_object("contents", "$").isNotNull(), search_text())).alias("made"))
    told = F.col("made") == F.col("body")
    last = F.right(F.rtrim("body", F.lit(CLOSERS)), F.lit(1))
    made = F.when(told, F.lit("")).otherwise(F.col("made"))
    texts = texts.select("rid", "updated_at", "namespace", "body", made.alias("made"), told.alias("told"), last.isin(*MARKS).alias("whole"), F.when(F.col("body") != "", F.xxhash64("body")).alias("text_id"), F.when(made != "", F.xxhash64(made)).alias("made_id"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields)
    rows = stored(texts.mapInArrow(_sign, f"{kinds}, keys array<long>, made_keys array<long>"))
    # a row asks with the bands of the highest level that its whole words reach
    asked = F.when(F.size("keys") > 0, F.slice("keys", -BANDS, BANDS))
    versions = rows.select("rid", "updated_at", "namespace", "body", "made", "told", "whole", "text_id", "made_id", asked.alias("ask"))
    current = stored(latest(versions, "rid", "updated_at", *versions.columns).where("body <> ''"))
    held = rows.select(F.explode(F.array(F.struct("text_id", F.length("body").alias("size"), "keys"), F.struct(F.col("made_id").alias("text_id"), F.length("made").alias("size"), F.col("made_keys").alias("keys")))).alias("t")).select("t.*")
    held = held.where(F.size("keys") > 0).select(F.col("text_id").alias("copy_id"), "size", F.explode("keys").alias("key"))
    # what ends as a sentence does can only be shown to be cut by its own contents
    longer = F.length("made") > F.length("body")
    asks = current.where(F.col("ask").isNotNull() & (~F.col("whole") | longer)).select("text_id", F.length("body").alias("n"), "ask").dropDuplicates(["text_id"])
    asks = durable(asks.select("text_id", "n", F.explode("ask").alias("key")))
    longest = held.groupBy("key").agg(F.max(F.struct("size", "copy_id")).alias("copy"))
    pairs = asks.join(longest, "key").where("copy.size > n").select("text_id", F.col("copy.copy_id").alias("copy_id")).distinct()
    pairs = durable(pairs)
    aligned = durable(_compared(rows, pairs))
    shown = aligned.where("any").select("text_id").distinct()
    mine = aligned.select("text_id", F.col("copy_id").alias("made_id")).distinct()
    by_band = durable(current.join(shown, "text_id", "left_semi").select("rid").unionByName(current.where("made_id is not null").join(mine, ["text_id", "made_id"], "left_semi").select("rid")).distinct())
    # then the exact check of own contents, for texts too short for bands or hidden behind a longer copy
    own = current.where(longer).join(by_band, "rid", "left_anti").select("rid", "body", "made")
    by_own = durable(own.mapInArrow(_align_rows(True), "rid string"))
    seen = by_band.unionByName(by_own)
    # texts that only begin alike hide each other behind the longest: the other texts of the bands that hold the end
    unsure = current.where("ask is not null and not whole").join(seen, "rid", "left_anti").select("text_id").distinct()
    open_asks = durable(asks.join(unsure, "text_id", "left_semi"))
    near = durable(held.join(open_asks.groupBy("key").agg(F.min("n").alias("n")), "key").where("size > n").groupBy("copy_id").agg(F.collect_set("key").alias("keys")))  # as many keys as a text has
    tails = _texts(rows, open_asks.select("text_id"), "text").mapInArrow(_ends, "text_id long, words int, gram long").join(open_asks, "text_id")
    grams = _texts(rows, near.select(F.col("copy_id").alias("text_id")), "copy").mapInArrow(_grams, "copy_id long, at int, gram long")
    grams = grams.join(tails.select("gram").distinct(), "gram", "left_semi").join(near, "copy_id").select("copy_id", "at", "gram", F.explode("keys").alias("key"))
    place = F.col("words") * SIMILARITY - SHINGLE - 1, F.col("words") * 1.25 + 1
    further = tails.join(grams, ["gram", "key"]).where((F.col("at") >= place[0]) & (F.col("at") <= place[1]) & (F.col("text_id") != F.col("copy_id"))).select("text_id", "copy_id").distinct()
    further = durable(further.join(pairs, ["text_id", "copy_id"], "left_anti"))
    shown = _compared(rows, further).where("any").select("text_id").distinct()
    by_other = durable(current.join(shown, "text_id", "left_semi").join(seen, "rid", "left_anti").select("rid"))
    # earlier versions of a text too short for bands
    seen = seen.unionByName(by_other)
    several = rows.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rid")
    short = current.where("ask is null and not whole").select("rid", F.col("body").alias("mine")).join(several, "rid", "left_semi").join(seen, "rid", "left_anti")
    earlier = rows.select("rid", F.explode(F.array("body", "made")).alias("copy")).join(short, "rid").where(F.length("copy") > F.length("mine"))
    by_version = earlier.select("rid", "mine", "copy").mapInArrow(_align_rows(False), "rid string").distinct()
    by_copy = by_band.unionByName(by_other).unionByName(by_version).withColumn("how", F.lit("copy")).unionByName(by_own.withColumn("how", F.lit("contents")))
    by_copy = durable(by_copy)
    hits = by_copy.unionByName(_by_ending(current, by_copy).withColumn("how", F.lit("ending")))
    return current.select("rid", "namespace").join(hits, "rid").select("rid", "namespace", "how")


def _by_ending(current: DataFrame, by_copy: DataFrame) -> DataFrame:
    """``(rid)`` of the rows without a longer copy whose endings show that they are cut off."""
    words = durable(current.select("body").mapInArrow(_count_words, "word string, met long, closed long").groupBy("word").agg(F.sum("met").alias("met"), F.sum("closed").alias("closed")))
    ends = durable(current.select("rid", "body").mapInArrow(_close, "rid string, broken boolean, word string, strict boolean"))
    asked = ends.where("word is not null").select("word").distinct()
    # how often the most frequent word is met that an asked one begins: only prefixes of asked lengths are made
    lengths = asked.agg(F.array_sort(F.collect_set(F.length("word"))).alias("lengths"), F.count(F.lit(1)).alias("asked"))  # one row; as many as words have lengths
    mean = words.agg((F.sum("closed") / F.sum("met")).alias("mean"))  # one row
    begun = words.where(F.col("met") >= LEAST_USES).crossJoin(F.broadcast(lengths.select("lengths")))
    begun = begun.select("met", F.explode(F.transform(F.filter("lengths", lambda n: n < F.length("word")), lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("word")).groupBy("word").agg(F.max("met").alias("begins"))
    judged = asked.join(words, "word", "left").join(begun, "word", "left").crossJoin(F.broadcast(mean))
    met, closed, begins = (F.coalesce(c, F.lit(0)) for c in ("met", "closed", "begins"))
    longer = F.greatest(F.lit(0.0), F.log((begins + 0.5) / (met + 0.5)))
    closes = F.log((closed + SMOOTHING * F.col("mean")) / (met + SMOOTHING) / F.col("mean"))
    judged = judged.where("mean > 0").select("word", longer.alias("longer"), closes.alias("closes"))
    closes = F.when(F.col("strict"), 0.0).otherwise(F.least(F.lit(0.0), F.col("closes")))  # a broken word closes where it is broken
    seen = ends.where("not broken and word is not null").join(judged, "word").select("rid", "longer", closes.alias("closes"))
    cut = by_copy.select("rid", F.lit(1).alias("cut"))
    known = current.select("rid", "told").join(cut, "rid", "left").select("rid", "told", F.coalesce("cut", F.lit(0)).alias("cut"))
    seen = durable(seen.join(known, "rid").select("rid", "longer", "closes", "cut", "told"))
    labelled = seen.where("cut = 1 or told")
    counts = {r.cut: r.n for r in labelled.groupBy("cut").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, LABELLED / max(1, n)) for k, n in counts.items()}
    level = F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) / float(1 << 30)
    picked = labelled.where(level < F.when(F.col("cut") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)))
    sample = picked.select("longer", "closes", F.col("cut").cast("double").alias("cut")).orderBy("longer", "closes", "cut").toPandas().to_numpy(float).reshape(-1, 3)
    weight = np.where(sample[:, 2] > 0, 1 / share.get(1, 1.0), 1 / share.get(0, 1.0))
    bias, by_longer, by_closing = fit_endings(np.column_stack([sample, weight])).tolist()
    score = bias + by_longer * F.col("longer") - by_closing * F.col("closes")
    visible = ends.where("broken").select("rid").join(by_copy, "rid", "left_anti")
    return seen.where((F.col("cut") == 0) & (score > 0)).select("rid").unionByName(visible)


def shares(bundles: DataFrame) -> DataFrame:
    """Per namespace: current rows with a text, how many are cut off, and their share."""
    told = latest(bundles, "rid", "updated_at", "rid", "updated_at", "namespace", "search_text").where(F.col("search_text").rlike(r"(?U)\S"))
    cut = truncated(bundles).select("rid", F.lit(1).alias("cut"))
    return told.join(cut, "rid", "left").groupBy("namespace").agg(F.count(F.lit(1)).alias("bundles"), F.coalesce(F.sum("cut"), F.lit(0)).alias("truncated")).withColumn("share", F.col("truncated") / F.col("bundles"))
