"""Vector search, fusion with full-text hits, reranking; for one query or for a table of queries."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmesh.functions import vectors

#: Weight of the full-text score by route.
ALPHA = {"keyword": 1.0, "conceptual": 0.5, "temporal": 1.0, "hybrid": 0.85}
ENTITY_BONUS = 0.01
RANK_CONSTANT = 60


def usable_chunks(chunks: DataFrame, configs: DataFrame, config_id: str | None = None) -> DataFrame:
    """Rows with a vector of the configuration's dimensions that can be compared."""
    sized = configs.select("config_id", "dimensions")
    if config_id is not None:
        chunks, sized = chunks.where(F.col("config_id") == config_id), sized.where(F.col("config_id") == config_id)
    return chunks.join(sized, "config_id").where(vectors.usable(F.col("embedding"), F.col("dimensions"))).drop("dimensions")


def default_config(configs: DataFrame) -> DataFrame:
    """The one row of the default configuration: marked as such, else the oldest."""
    return configs.orderBy(F.desc("is_default"), "created_at", "config_id").limit(1)


def nearest_chunks(chunks: DataFrame, query: Column, most: int) -> DataFrame:
    """The chunks nearest to a query vector, by exact cosine; a top-k by partition, then of those."""
    scored = chunks.withColumn("similarity", F.round(vectors.cosine(F.col("embedding"), query), 6)).where("similarity is not null")
    return scored.orderBy(F.desc("similarity"), "rid", "chunk_index", "vec_id").limit(most)


def best_chunk(hits: DataFrame, key: str = "rid") -> DataFrame:
    """Per key the best chunk, combined on the map side."""
    rest = [c for c in hits.columns if c not in (key, "similarity")]
    best = F.max(F.struct(F.col("similarity"), *[F.struct((-F.col(c)).alias(c)).alias(f"_{c}") if c in ("chunk_index", "vec_id") else F.col(c) for c in rest]))
    got = hits.groupBy(key).agg(best.alias("_b"))
    return got.select(key, F.col("_b.similarity"), *[(-F.col(f"_b._{c}.{c}")).alias(c) if c in ("chunk_index", "vec_id") else F.col(f"_b.{c}") for c in rest])


def semantic_search(chunks: DataFrame, query: Column, most: int = 20, oversample: int = 5) -> DataFrame:
    """``(rid, similarity, chunk_text)`` of the nearest texts; chunks are oversampled, then one is kept per text."""
    hits = nearest_chunks(chunks, query, most * oversample).select("rid", "similarity", "chunk_index", "vec_id", "chunk_text")
    return best_chunk(hits).orderBy(F.desc("similarity"), "rid").limit(most).select("rid", "similarity", "chunk_text")


def fuse(fts: DataFrame, near: DataFrame, alpha: float | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Convex combination of min-max scaled full-text ranks and similarities; missing scores are 0.

    A single hit, or hits of one rank, scale to 1. ``by`` names the query column of a table of queries.
    """
    w = W.partitionBy(*(by or (F.lit(1),)))
    low, high = F.min("rank").over(w), F.max("rank").over(w)
    scaled = fts.withColumn("fts_score", F.when(high > low, (F.col("rank") - low) / (high - low)).otherwise(1.0))
    alpha = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    both = scaled.join(near, [*by, "rid"], "full_outer")
    score = alpha * F.coalesce("fts_score", F.lit(0.0)) + (1 - alpha) * F.coalesce("similarity", F.lit(0.0))
    return both.withColumn("score", F.round(score, 12)).select(*by, "rid", "score", "rank", "similarity", *[c for c in ("chunk_text",) if c in near.columns])


def reciprocal_rank_fusion(*runs: DataFrame, constant: int = RANK_CONSTANT) -> DataFrame:
    """``(rid, score)`` from runs of (rid, pos)."""
    out = None
    for run in runs:
        part = run.select("rid", (1.0 / (constant + F.col("pos"))).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("rid").agg(F.round(F.sum("s"), 9).alias("score"))


def with_entity_bonus(hits: DataFrame, by_entity: DataFrame) -> DataFrame:
    """Hits (rid, pos, score) and texts of a query's entities (rid, entity_pos), the latter raised by 0.01 / place; a
    hit without a score counts 1 / (60 + place), a text that is no hit has nothing but its bonus."""
    both = hits.join(by_entity, "rid", "full_outer")
    base = F.coalesce("score", F.lit(1.0) / (RANK_CONSTANT + F.col("pos")), F.lit(0.0))
    return both.select("rid", F.round(base + F.coalesce(F.lit(ENTITY_BONUS) / F.col("entity_pos"), F.lit(0.0)), 9).alias("score"))


#: Hits that are reranked, and the lengths over which a chunk or a headline stands for its text.
POOL, LEAST_CHUNK, LEAST_HEADLINE = 50, 10, 20


def passages(chunk_text: Column, headline: Column, first_chunk: Column) -> Column:
    """What a hit is reranked by: its chunk, else its headline, else the first chunk of its text."""
    return F.when(F.length(chunk_text) > LEAST_CHUNK, chunk_text).when(F.length(headline) > LEAST_HEADLINE, headline).otherwise(first_chunk)


def routed(route: str, fts: DataFrame, near: DataFrame | None, most: int = 20) -> DataFrame:
    """``(rid, score)`` of a query by its route: full text alone for keywords and where there is no vector (``near`` is
    None), else the convex combination with the weight of the route."""
    alpha = ALPHA[route]
    if near is None or alpha >= 1.0 and route == "keyword":
        return fts.select("rid", F.col("rank").alias("score")).orderBy(F.desc("score"), "rid").limit(most)
    return fuse(fts, near, alpha).select("rid", F.round("score", 8).alias("score")).orderBy(F.desc("score"), "rid").limit(most)


def sample_chunks(chunks: Column, most: int = 5) -> Column:
    """First, last and evenly spaced chunks, at most so many."""
    n = F.size(chunks)
    step = (n - 1) / (most - 1)
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * step + 0.5).cast("int")))
    return F.when(n <= most, chunks).otherwise(F.transform(picks, lambda i: F.get(chunks, i)))


def overlap_score(query: str) -> "Column":
    """The reranker that needs no model: the share of the query's words that a passage has."""
    words = sorted({w for w in re.split(r"[\W_]+", query.lower()) if w})

    def score(passage: Column) -> Column:
        has = F.array_distinct(F.split(F.lower(passage), r"[^\p{L}\p{N}]+"))
        return F.size(F.array_intersect(has, F.array(*map(F.lit, words)))) / F.lit(max(1, len(words)))

    return score


def rerank(hits: DataFrame, scorer, passage: Column, most: int = 20) -> DataFrame:
    """Hits in the order of a scorer over passages; ties by rid."""
    return hits.withColumn("rerank_score", F.round(scorer(passage), 6)).orderBy(F.desc("rerank_score"), "rid").limit(most)


def rerank_chunked(hits: DataFrame, scorer, chunks: Column, most: int = 20) -> DataFrame:
    """Each text's score is that of its best sampled chunk."""
    cut = hits.select("rid", chunks.alias("_chunks"))  # by itself, as the chunker is an Arrow function
    scored = cut.select("rid", F.explode(sample_chunks(F.col("_chunks"))).alias("passage")).select("rid", scorer(F.col("passage")).alias("s"))
    return scored.groupBy("rid").agg(F.round(F.max("s"), 6).alias("rerank_score")).orderBy(F.desc("rerank_score"), "rid").limit(most)


def hashing_embedder(dimensions: int = 64):
    """The embedder that needs no model: signed hashed counts of all words of a text, of unit length."""

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[float]:
            v = np.zeros(dimensions)
            for word in re.findall(r"[^\W_]+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % dimensions] += 1 if h >> 63 else -1
            n = math.sqrt(float(v @ v))
            return (v / n if n else v).astype("float32").tolist()

        return text.map(one)

    return embed


class Registry:
    """Named makers of embedders, rerankers and extractors."""

    def __init__(self, kind: str):
        self.kind, self._makers = kind, {}

    def register(self, name: str):
        def put(maker):
            self._makers[name] = maker
            return maker

        return put

    def create(self, name: str, *args, **kwargs):
        if name not in self._makers:
            raise ValueError(f"no {self.kind} named {name}; known: {', '.join(self.names())}")
        return self._makers[name](*args, **kwargs)

    def names(self) -> list[str]:
        return sorted(self._makers)

    def __contains__(self, name: str) -> bool:
        return name in self._makers


EMBEDDERS, RERANKERS, EXTRACTORS = Registry("embedder"), Registry("reranker"), Registry("extractor")
EMBEDDERS.register("hashing")(hashing_embedder)
RERANKERS.register("overlap")(overlap_score)
