"""Full-text search on a table of postings (lexeme, rid, tf, positions), with the web query syntax.

Postings are built once per corpus and shared by all queries, kept as a table in order of their lexemes with the
frequency of each; a query reads only the row groups that hold its own words.
Scores are BM25. Words are lower-case runs of letters and digits.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmesh.functions.text import tokens
from quillmesh.runtime import kept, shuffle_partitions, stored

K1, B = 1.2, 0.75
#: Of a search for many queries: most and least texts of a block, different sets of words of a chunk.
BLOCK, LEAST_BLOCK, CHUNK = 1 << 18, 1 << 14, 1 << 16


@dataclass
class WebQuery:
    """Groups of phrases joined by OR inside and AND between; each phrase a tuple of words; excluded phrases."""

    groups: list[list[tuple[str, ...]]] = field(default_factory=list)
    excluded: list[tuple[str, ...]] = field(default_factory=list)

    @property
    def words(self) -> list[str]:
        return sorted({w for g in self.groups for p in g for w in p} | {w for p in self.excluded for w in p})


def parse_query(text: str) -> WebQuery:
    """Words are all wanted; ``or`` joins neighbours; "..." is a phrase; -word leaves out."""
    out, joined = WebQuery(), False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if not minus and word.lower() == "or":
            joined = bool(out.groups)
            continue
        words = tuple(w for w in re.split(r"[\W_]+", (phrase or word).lower()) if w)
        if not words:
            continue
        if minus:
            out.excluded.append(words)
        elif joined:
            out.groups[-1].append(words)
        else:
            out.groups.append([words])
        joined = False
    return out


def tokenised(docs: DataFrame, key: str = "rid", text: str = "search_text") -> DataFrame:
    """``(key, words)`` of the texts, written once, so that several passes over a corpus cut it into words only once."""
    return stored(docs.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("words")))


def _words(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, "words") if "words" in docs.columns else docs.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("words"))


def postings(docs: DataFrame, key: str = "rid", text: str = "search_text") -> DataFrame:
    """``(lexeme, key, tf, positions, size)`` of texts or tokenised texts; texts without words have none."""
    spread = _words(docs, key, text).select(key, F.size("words").alias("size"), F.posexplode("words").alias("_p", "lexeme"))
    return spread.groupBy("lexeme", key).agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("_p")).alias("positions"), F.first("size").alias("size"))


def stored_index(docs: DataFrame, key: str = "rid", text: str = "search_text", label: str = "namespace") -> tuple[DataFrame, DataFrame]:
    """The postings of a corpus (lexeme, key, tf, positions, size, df, label) in order of lexemes, and the one row of
    ``corpus_size``, both made once per state of the corpus (``runtime.kept``) and shared by all later queries."""

    def build() -> DataFrame:
        made = postings(docs, key, text)
        df = made.groupBy("lexeme").agg(F.count(F.lit(1)).alias("df"))
        rows = made.join(df, "lexeme").join(docs.select(key, label), key)
        return rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "lexeme", F.xxhash64(key)).sortWithinPartitions("lexeme", key)

    return kept(docs, "postings", build), kept(docs, "corpus", lambda: corpus_size(docs, text))


def frequencies(docs: DataFrame, key: str = "rid", text: str = "search_text") -> DataFrame:
    """``(lexeme, key, tf, size)``: postings without positions, which is all that ranking needs."""
    spread = _words(docs, key, text).select(key, F.size("words").alias("size"), F.explode("words").alias("lexeme"))
    return spread.groupBy("lexeme", key, "size").agg(F.count(F.lit(1)).alias("tf"))


def corpus_size(docs: DataFrame, text: str = "search_text") -> DataFrame:
    """One row: number of texts with words, mean number of words."""
    n = F.size("words") if "words" in docs.columns else F.size(tokens(F.col(text)))
    rows = docs if "words" in docs.columns else docs.where(F.col(text).isNotNull())
    return rows.select(n.alias("n")).where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))


def bm25(tf: Column, size: Column, df: Column, docs: Column, mean: Column) -> Column:
    idf = F.log(1 + (docs - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def _phrase(words: tuple[str, ...]) -> Column:
    """Whether the words stand side by side in the map lexeme -> positions."""
    first = F.coalesce(F.col("at")[words[0]], F.array().cast("array<int>"))
    if len(words) == 1:
        return F.size(first) > 0
    return F.exists(first, lambda p: _all([F.array_contains(F.coalesce(F.col("at")[w], F.array().cast("array<int>")), (p + i).cast("int")) for i, w in enumerate(words) if i]))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def search(index: DataFrame, size: DataFrame, query: str, key: str = "rid", where: Column | None = None) -> DataFrame:
    """``(key, rank)`` of the texts that match a web query. ``size`` is the one row of ``corpus_size``; ``where`` is a
    condition on further columns of a stored index, such as its namespace, and doesn't change the ranks."""
    wanted = parse_query(query)
    if not wanted.groups:
        return index.select(key, F.lit(0.0).alias("rank")).limit(0)
    hits = index.where(F.col("lexeme").isin(wanted.words))
    if "df" not in hits.columns:
        df = hits.groupBy("lexeme").agg(F.count(F.lit(1)).alias("df"))
        hits = hits.join(F.broadcast(df), "lexeme")  # as many rows as the query has words
    hits = hits if where is None else hits.where(where)
    scored = hits.crossJoin(F.broadcast(size))  # one row
    plain = sorted({w for g in wanted.groups for p in g for w in p})
    score = F.when(F.col("lexeme").isin(plain), bm25(F.col("tf"), F.col("size"), F.col("df"), F.col("docs"), F.col("mean"))).otherwise(0.0)
    by_doc = scored.groupBy(key).agg(F.sum(score).alias("rank"), F.map_from_entries(F.collect_list(F.struct("lexeme", "positions"))).alias("at"))
    match = _all([_any([_phrase(p) for p in g]) for g in wanted.groups]) & _all([~_phrase(p) for p in wanted.excluded])
    return by_doc.where(match).select(key, "rank")


def search_many(index: DataFrame, size: DataFrame, queries: DataFrame, most: int = 20, key: str = "rid") -> DataFrame:
    """``(query_id, key, rank, pos)``: the best texts with all words of each of many queries (query_id, query), in one pass.

    Of the index only the words that are asked for are kept, a row for each text. Blocks of texts meet chunks of
    different sets of words; within a block the lists of a set's words are intersected, and only its best hits leave
    it, so candidates never become rows. Queries without words, or with an unknown one, have no hits.
    """
    words = queries.select("query_id", F.array_sort(F.array_distinct(tokens(F.col("query")))).alias("w")).where(F.size("w") > 0)
    sets = stored(words.select("w").distinct())
    asked = stored(sets.select(F.explode("w").alias("lexeme")).distinct())  # its size on disk lets the optimizer broadcast it
    known = [c for c in ("df",) if c in index.columns]
    hits = index.select("lexeme", key, "tf", "size", *known).join(asked, "lexeme", "left_semi")
    texts = stored(hits.groupBy(key).agg(F.first("size").cast("long").alias("size"), F.collect_list(F.struct("lexeme", F.col("tf").cast("long").alias("tf"), *known)).alias("words")))
    df = texts.select(F.explode("words").alias("x")).groupBy("x.lexeme").agg((F.max("x.df") if known else F.count(F.lit(1))).cast("long").alias("df"))
    plan = sets.select("w", F.explode("w").alias("lexeme")).join(df, "lexeme").groupBy("w").agg(F.array_sort(F.collect_list(F.struct("df", "lexeme"))).alias("by"))  # as many words as a query has
    plan = plan.where(F.size("by") == F.size("w")).crossJoin(F.broadcast(size)).select("w", "by", F.col("docs").cast("long").alias("docs"), "mean")  # one row
    n = texts.count()
    blocks = max(-(-n // BLOCK), min(index.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_BLOCK)), 1)
    chunks = max(-(-sets.count() // CHUNK), 1)
    left = texts.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.col(key).alias("key"), "size", F.transform("words", lambda x: F.struct(x["lexeme"].alias("lexeme"), x["tf"].alias("tf"))).alias("words"))
    right = plan.select(F.pmod(F.xxhash64("w"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "w", "by", "docs", "mean")
    kind = index.schema[key].dataType.simpleString()
    found = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(_best_of_block(most), f"w array<string>, key {kind}, rank double")
    best = found.withColumn("pos", F.row_number().over(W.partitionBy("w").orderBy(F.desc("rank"), "key"))).where(F.col("pos") <= most)
    return words.join(best, "w").select("query_id", F.col("key").alias(key), "rank", "pos")


def _best_of_block(most: int):
    """A function of one block's texts (key, size, words) and one chunk's sets (w, by, docs, mean): a set's best texts."""

    def run(texts: pa.Table, sets: pa.Table) -> pa.Table:
        kinds = pa.schema([("w", pa.list_(pa.string())), ("key", texts.schema.field("key").type), ("rank", pa.float64())])
        if not texts.num_rows or not sets.num_rows:
            return kinds.empty_table()
        texts = texts.sort_by("key").combine_chunks()  # so that places are in order of keys
        held = texts["words"].combine_chunks()
        values, size = held.flatten(), texts["size"].to_numpy().astype(np.float64)
        place = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy())
        coded = values.field("lexeme").dictionary_encode()
        code, tf = coded.indices.to_numpy(), values.field("tf").to_numpy().astype(np.float64)
        order = np.argsort(code, kind="stable")
        place, tf = place[order], tf[order]
        names = coded.dictionary.to_pylist()
        ends = np.searchsorted(code[order], np.arange(len(names) + 1))
        at = {w: (place[a:b], tf[a:b]) for w, a, b in zip(names, ends, ends[1:], strict=False)}
        bits: dict[str, np.ndarray] = {}  # of words in many texts: few words can be

        def mask(w: str) -> np.ndarray:
            if w not in bits:
                whole = np.zeros(len(size), dtype=bool)
                whole[at[w][0]] = True
                bits[w] = np.packbits(whole)
            return bits[w]

        def within(words: list[str]) -> np.ndarray:
            """Places of the texts that hold all of these words."""
            words = sorted(words, key=lambda w: len(at[w][0]))
            dense = [w for w in words if len(at[w][0]) * 32 >= len(size)]
            rare = words[: len(words) - len(dense)]
            if not rare:
                both = mask(dense[0])
                for w in dense[1:]:
                    both = both & mask(w)
                some = np.flatnonzero(both)
                row, bit = np.nonzero(np.unpackbits(both[some]).reshape(-1, 8))
                return some[row] * 8 + bit
            here = at[rare[0]][0]
            for w in rare[1:]:
                other = at[w][0]
                here = here[other[np.minimum(np.searchsorted(other, here), len(other) - 1)] == here]
            for w in dense:
                here = here[(mask(w)[here >> 3] >> (7 - (here & 7))) & 1 == 1]
            return here

        docs, mean = sets["docs"][0].as_py(), sets["mean"][0].as_py()
        rows, places, ranks = [], [], []
        for n, by in enumerate(sets["by"].to_pylist()):
            here = within([x["lexeme"] for x in by]) if all(x["lexeme"] in at for x in by) else ()
            if not len(here):
                continue
            rank = np.zeros(len(here))
            for x in by:
                where, often = at[x["lexeme"]]
                t = often[np.searchsorted(where, here)]
                rank += math.log(1 + (docs - x["df"] + 0.5) / (x["df"] + 0.5)) * t * (K1 + 1) / (t + K1 * (1 - B + B * size[here] / mean))
            rank = np.floor(rank * 1e5 + 0.5) / 1e5
            top = np.argsort(-rank, kind="stable")[:most]
            rows.append(np.full(len(top), n))
            places.append(here[top])
            ranks.append(rank[top])
        if not rows:
            return kinds.empty_table()
        return pa.table([sets["w"].combine_chunks().take(pa.array(np.concatenate(rows))), texts["key"].take(pa.array(np.concatenate(places))), np.concatenate(ranks)], schema=kinds)

    return run


def headline(text: Column, words: list[str], most: int = 3, length: int = 20) -> Column:
    """Up to three fragments around the words, these between ``**``, joined by `` ... ``."""

    @F.pandas_udf("string")
    def fragments(texts: pd.Series) -> pd.Series:
        hit = re.compile(r"(?<![^\W_])(" + "|".join(map(re.escape, words)) + r")(?![^\W_])", re.IGNORECASE)

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            split = t.split()
            at = [i for i, w in enumerate(split) if hit.search(w)]
            parts, end = [], -1
            for i in at:
                if i <= end or len(parts) == most:
                    continue
                start = max(0, end + 1, i - length // 2)
                end = start + length - 1
                parts.append(hit.sub(r"**\1**", " ".join(split[start : end + 1])))
            return " ... ".join(parts) if parts else " ".join(split[:length])

        return texts.map(one)

    return fragments(text)
