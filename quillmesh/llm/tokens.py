"""Token ids of whole texts by a public byte-level BPE vocabulary.

Forced-boundary splitting. A pair of bytes that occurs inside no token of the vocabulary can never end up in one
token, so between such two bytes every encoding has a cut. A text is cut at those places, each fragment is encoded
by itself and the ids are joined. Equal fragments of a batch are encoded once, which is most of the work in scripts
whose characters the vocabulary knows only as bytes.

A fragment must also be split into words as it is inside its text. Words are found by a pattern that looks at white
space and apostrophes across a place, so a forced cut is used only
* between two characters (never within the bytes of one),
* after a character that isn't white space (the pattern looks ahead from white space),
* before a character that isn't an apostrophe (it starts a contraction only where a word has ended).

Defined results: null and empty texts give an empty list; strings of special tokens are ordinary text; repeated rows
give repeated rows; other columns are carried along only if named in ``keep``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fragments of at most this many bytes are remembered within a batch; longer ones hardly repeat.
REMEMBERED = 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed package of public vocabularies keeps a file; any other path may be passed instead."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder and its table of byte pairs: true where some token holds the two bytes side by side."""
    import public_tokenizers
    import tiktoken

    ranks = read_ranks(path)
    inside = np.zeros(1 << 16, dtype=bool)
    joined = np.frombuffer(b"".join(ranks), dtype=np.uint8).astype(np.int32)
    ends = np.cumsum([len(t) for t in ranks])
    pairs = (joined[:-1] << 8) | joined[1:]
    across = np.zeros(len(pairs), dtype=bool)
    across[ends[:-1] - 1] = True
    inside[pairs[~across]] = True
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe, inside


_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def forced_cuts(raw: bytes, inside: np.ndarray) -> np.ndarray:
    """Byte offsets of the certain cuts of ``raw`` (valid UTF-8) that leave its split into words unchanged."""
    b = np.frombuffer(raw, dtype=np.uint8)
    if len(b) < 2:
        return np.empty(0, dtype=np.int64)
    wide = b.astype(np.int32)
    free = ~inside[(wide[:-1] << 8) | wide[1:]]
    free &= ((b[1:] & 0xC0) != 0x80) & (b[1:] != 0x27) & ~_ASCII_SPACE[b[:-1]]
    cuts = np.flatnonzero(free) + 1
    if len(cuts):
        high = b[cuts - 1] >= 0x80
        if high.any():
            keep = np.ones(len(cuts), dtype=bool)
            for i in np.flatnonzero(high):
                at = int(cuts[i])
                start = at - 1
                while raw[start] & 0xC0 == 0x80:
                    start -= 1
                if raw[start] in (0xC2, 0xE1, 0xE2, 0xE3) and raw[start:at].decode("utf-8").isspace():
                    keep[i] = False
            cuts = cuts[keep]
    return cuts


def encode(text: str | None, path: str, known: dict[bytes, np.ndarray] | None = None) -> np.ndarray:
    """The ids of one text as an array of int32."""
    bpe, inside = encoder(path)
    return _encode(text, bpe, inside, {} if known is None else known)


def _encode(text, bpe, inside, known) -> np.ndarray:
    if not text:
        return np.empty(0, dtype=np.int32)
    raw = text.encode("utf-8", errors="replace")
    parts: list[int] = []
    start = 0
    for end in (*forced_cuts(raw, inside).tolist(), len(raw)):
        piece = raw[start:end]
        start = end
        ids = known.get(piece)
        if ids is None:
            ids = bpe.encode_ordinary(piece.decode("utf-8", errors="replace"))
            if len(piece) <= REMEMBERED:
                known[piece] = ids
        parts += ids
    return np.asarray(parts, dtype=np.int32)


def _batches(path: str, text: str, keep: list[str], only_count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, inside = encoder(path)
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            if len(known) > 200_000:
                known.clear()
            ids = [_encode(x, bpe, inside, known) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            if only_count:
                made = pa.array([len(x) for x in ids], type=pa.int64())
            else:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept, made], names=[*keep, "n_tokens" if only_count else "ids"])

    return run


def token_ids(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep`` and ``ids`` (array of int) of every row of ``docs``."""
    path = path or vocabulary_path()
    fields = [docs.schema[k] for k in keep]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return docs.select(*keep, text).mapInArrow(_batches(path, text, list(keep), False), schema)


def token_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep`` and ``n_tokens`` of every row; null and empty texts count 0."""
    path = path or vocabulary_path()
    fields = [docs.schema[k] for k in keep]
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType())])
    return docs.select(*keep, text).mapInArrow(_batches(path, text, list(keep), True), schema)
