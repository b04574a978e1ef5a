"""The queries of this package: problem N's are named pN_... and run over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import cutoff, mixing, names, pieces, sentences, threads, tokens, turns, vectors
from quillmesh.runtime import latest, table



def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, d, "chunk_embeddings"), table(spark, d, "embedding_configs"), 0.9).select("vec_id_a", "vec_id_b")


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(table(spark, d, "chunk_embeddings"), table(spark, d, "embedding_configs"), k=10, every=20)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where("chunk_index = 1").select("rid", "config_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "bundles"), table(spark, d, "embedding_configs")).select("rid", "config_id", "chunk_index", "chunk_text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_turns(spark, d).select("rid", "turn_no", "speaker_no")


def p3_turns(spark: SparkSession, d: str) -> DataFrame:
    spoken = table(spark, d, "bundles").where(F.col("namespace").endswith("-recording") | F.col("namespace").endswith("-transcript"))
    return turns.speaker_turns(turns.transcripts_of(latest(spoken, "rid", "updated_at", "rid", "updated_at", "contents")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_trees(spark, d).select("thread_id", "turn_no", "reference", "role")


def p4_trees(spark: SparkSession, d: str) -> DataFrame:
    return threads.conversations(table(spark, d, "bundles"), table(spark, d, "self_senders")).drop("content", "ts")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.entity_pairs(table(spark, d, "entities"))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entity_clusters(table(spark, d, "entities"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.truncated(table(spark, d, "bundles")).select("rid")


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.shares(table(spark, d, "bundles"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p8_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Per listed source: whether anything is drawn of it, and whether no document is drawn too often."""
    got = p8_shares(spark, d)
    return got.select("source", (F.col("documents") > 0).alias("drawn"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"), with_text=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_nearest, p2_found, p2_pieces, p3_found, p3_turns, p4_found, p4_trees, p5_found, p5_entities, p6_found, p6_shares, p7_ids, p8_mix, p8_shares, p8_bounds, p9_found, p9_sentences)
}
