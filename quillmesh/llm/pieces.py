"""Cutting oversized texts into overlapping pieces at natural boundaries.

Balanced targets. The least number of pieces that can hold the text is computed, that many equal targets are laid
over it, and each is moved to the strongest boundary near it (blank line, line break, sentence end, clause mark,
blank), or to the nearest boundary within all that the limit allows if none is near; where a move would break the size
limit of a piece, one piece more is planned and all targets are laid again.

A piece has fewer code points than the size, and begins exactly ``overlap`` code points before the end of the one
before it. Texts are taken without blanks, tabs and line breaks at their ends; positions count from there.

Defined results: null and blank texts, and texts of at most the size, give no pieces (they need no cutting); a size
under 2 or null gives none; overlap is reduced to half the size where it is larger, and null counts as 0; repeated
rows give repeated pieces; a text without any boundary is cut between characters, never before a combining mark.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.runtime import latest

TRIMMED = " \t\n\r"

#: Boundaries by strength; a cut lies at the end of the match.
BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        r"\n[ \t\r]*\n+",
        r"\n",
        r"""[.!?…][)\]"'”’»]*[ \t]+|[。！？][」』”’）]*|[।۔؟។።][ ]*""",
        r"[,;:،؛，；、—][ ]*|[)\]][ ]+",
        r"[ \t 　]+",
    )
)


def overlap_chars(size: int, overlap: float | None) -> int:
    """A share of the size below 1, otherwise a number of characters; at most half the size."""
    if overlap is None or overlap != overlap or overlap <= 0:
        return 0
    return min(int(size * overlap) if overlap < 1 else int(overlap), size // 2)


def _snap(text: str, target: int, low: int, high: int) -> int:
    """The end of the strongest boundary in (low, high], of equal ones the nearest to target; -1 if there is none."""
    window = text[low:high]
    for pattern in BOUNDARIES:
        best, gap = -1, high - low + 1
        for m in pattern.finditer(window):
            at = low + m.end()
            if low < at <= high and at < len(text) and abs(at - target) < gap:
                best, gap = at, abs(at - target)
        if best >= 0:
            return best
    return -1


def _between_characters(text: str, target: int, low: int, high: int) -> int:
    at = min(max(target, low + 1), high)
    while at > low + 1 and (unicodedata.combining(text[at]) or text[at] in "‍️"):
        at -= 1
    return at


def cut(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open code point ranges of the pieces of a text longer than ``size``."""
    total, limit = len(text), size - 1
    overlap = min(overlap, limit // 2)
    step = limit - overlap
    count = max(2, math.ceil((total - overlap) / step))
    while True:
        share = (total - overlap) / count
        reach = max(1, int(min(share / 3, max(limit - overlap - share, share / 8))))
        ends, start, ok = [], 0, True
        for i in range(1, count):
            target = round(overlap + share * i)
            # what is left must still fit into the pieces that remain
            least, most = max(start + overlap, total - (count - i) * step - overlap), min(start + limit, total - 1)
            low, high = max(least, target - reach), min(most, target + reach)
            if low >= high:
                if high <= start + overlap or total - high > (count - i) * step + overlap:
                    ok = False
                    break
                low = high - 1
            end = _snap(text, target, low, high)
            if end < 0 and least < most:
                end = _snap(text, target, least, most)
            if end < 0:
                end = _between_characters(text, target, low, high)
            if end <= start + overlap:
                ok = False
                break
            ends.append(end)
            start = end - overlap
        if ok and total - start <= limit:
            starts = [0, *(e - overlap for e in ends)]
            return list(zip(starts, [*ends, total], strict=True))
        count += 1


def _cutter(configs: list[tuple[str, int, int]]):
    out = pa.schema([("rid", pa.string()), ("config_id", pa.string()), ("chunk_index", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("body", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for rid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for config, size, overlap in configs:
                    if len(body) > size:
                        for i, (a, b) in enumerate(cut(body, size, overlap)):
                            for held, value in zip(rows, (rid, config, i, a, b, body[a:b]), strict=True):
                                held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(rows, out, strict=True)], schema=out)

    return run


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def split_oversized(bundles: DataFrame, configs: DataFrame) -> DataFrame:
    """Pieces ``(rid, config_id, chunk_index, start_pos, end_pos, chunk_text)`` of every text above a configuration's size.

    ``bundles`` has versions (rid, updated_at, search_text), of which the latest counts; ``configs`` config_id,
    chunk_size and chunk_overlap. The configurations are settings (one row per embedding model), so they are brought
    to the driver and sent along with the function. Texts that no configuration cuts are left behind before the
    shuffle that picks the versions.
    """
    plans = sorted(
        (r.config_id, r.chunk_size, overlap_chars(r.chunk_size, r.chunk_overlap))
        for r in configs.select("config_id", "chunk_size", "chunk_overlap").distinct().collect()
        if r.config_id is not None and r.chunk_size is not None and r.chunk_size >= 2
    )
    least = min((p[1] for p in plans), default=1 << 30)
    body = trimmed(F.col("search_text"))
    versions = bundles.select("rid", "updated_at", F.when(F.length("search_text") > least, F.when(F.length(body) > least, body)).alias("body"))
    long = latest(versions, "rid", "updated_at", "rid", "body").where("body is not null")
    pieces = long.mapInArrow(_cutter(plans), "rid string, config_id string, chunk_index int, start_pos int, end_pos int, body string")
    return pieces.withColumnRenamed("body", "chunk_text")
