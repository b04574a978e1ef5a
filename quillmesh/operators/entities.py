"""Entities in texts and their links: extraction by pattern, merging, fuzzy look-up, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import bundles as B
from quillmesh.functions import ontology
from quillmesh.functions.text import chunks, nfkc, normalise_name, set_similarity, trigrams
from quillmesh.operators.retrieval import EXTRACTORS

#: Type, supertype, confidence and pattern of what is found without a model.
PATTERNS = (
    ("Date", "temporal", 1.0, r"\b(\d{4}[-/]\d{2}[-/]\d{2})\b"),
    ("URL", "place", 1.0, r"""(https?://[^\s<>"')\]]+)"""),
    ("Path", "place", 0.9, r"(?m)(?:^|[\s(])((?:/[\w._-]+){2,}(?:/[\w._-]*)?)(?:\s|[),;:]|$)"),
    ("RID", "artifact", 1.0, r"\b(orn:[\w.-]+:[\w./_-]+)\b"),
    ("Version", "artifact", 0.9, r"\bv?(\d+\.\d+\.\d+(?:[-+][\w.]+)?)\b"),
)
TRIGRAM_THRESHOLD = 0.3
_ENTITY = "array<struct<name:string,entity_type:string,supertype:string,confidence:double>>"


def _as_entity(kind: str, supertype: str, confidence: float):
    return lambda n: F.struct(n.alias("name"), F.lit(kind).alias("entity_type"), F.lit(supertype).alias("supertype"), F.lit(confidence).alias("confidence"))


def pattern_entities(text: Column) -> Column:
    """Distinct entities of a text by pattern, as an array of structs."""
    found = []
    for kind, supertype, confidence, pattern in PATTERNS:
        names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
        if kind == "URL":
            names = F.transform(names, lambda n: F.regexp_replace(n, r"[.,;:)]+$", ""))
        if kind == "Path":
            names = F.filter(F.transform(names, lambda n: F.regexp_replace(n, r"[.,;:!?]+$", "")), lambda n: F.length(n) > 3)
        found.append(F.transform(names, _as_entity(kind, supertype, confidence)).cast(_ENTITY))
    return F.array_distinct(F.flatten(F.array(*found)))


EXTRACTORS.register("pattern")(lambda: pattern_entities)


def extract(docs: DataFrame, key: str = "rid", text: str = "search_text") -> DataFrame:
    """``(key, name, entity_type, supertype, confidence)``."""
    return docs.select(key, F.explode(pattern_entities(F.col(text))).alias("e")).select(key, "e.*")


#: Texts over so many characters are cut before extraction, and into what; entities below a confidence
#: don't count, nor more than so many of a chunk.
LONG_TEXT, CHUNK, CHUNK_OVERLAP = 3000, 3000, 200
LEAST_CONFIDENCE, MOST_PER_CHUNK = 0.3, 30
#: Pipelines by name: the extractors that run over every chunk, in order. The one of a language model needs a backend
#: of the caller (``EXTRACTORS``); names that aren't registered are left out.
PIPELINES = {"default": ("model", "pattern"), "fast": ("pattern",)}


def extractors(pipeline: str = "default") -> list:
    if pipeline not in PIPELINES:
        raise ValueError(f"no pipeline named {pipeline}; known: {', '.join(sorted(PIPELINES))}")
    return [EXTRACTORS.create(name) for name in PIPELINES[pipeline] if name in EXTRACTORS]


def run_pipeline(docs: DataFrame, pipeline: str = "default", key: str = "rid", text: str = "search_text", namespace: str | None = None) -> DataFrame:
    """Entities of texts: long texts are cut, each chunk goes through each extractor, weak and surplus ones are dropped,
    missing supertypes are filled in, types that the kind of the text doesn't allow are left out (with ``namespace``),
    and the rest is merged by normalised name and type."""
    body = F.coalesce(F.col(text), F.lit(""))
    cut = F.when(F.length(body) > LONG_TEXT, chunks(body, CHUNK, CHUNK_OVERLAP)).when(body == "", F.array().cast("array<string>")).otherwise(F.array(body))
    kept = [namespace] if namespace else []
    parts = docs.select(key, *kept, F.posexplode(cut).alias("_chunk", "_text"))
    found = []
    for i, run in enumerate(extractors(pipeline)):
        ranked = F.array_sort(F.filter(run(F.col("_text")), lambda e: e["confidence"] >= LEAST_CONFIDENCE), lambda x, y: F.when(x["confidence"] > y["confidence"], -1).when(x["confidence"] < y["confidence"], 1).otherwise(0))
        found.append(parts.select(key, *kept, (F.col("_chunk") * 100 + i).alias("_turn"), F.posexplode(F.slice(ranked, 1, MOST_PER_CHUNK)).alias("_pos", "e")))
    if not found:
        return docs.select(key, F.lit("").alias("name"), F.lit("").alias("entity_type"), F.lit("").alias("supertype"), F.lit("").alias("name_normalized"), F.lit(0.0).alias("confidence")).limit(0)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    rows = every.select(key, *kept, "_turn", "_pos", "e.*").withColumn("supertype", F.coalesce(F.nullif("supertype", F.lit("")), ontology.supertype(F.col("entity_type"))))
    if namespace:
        rows = rows.where(ontology.allowed(B.kind(namespace), F.col("entity_type")) | F.col("entity_type").isin(*(p[0] for p in PATTERNS)))
    return merge(rows.withColumn("_turn", F.col("_turn") * 1_000_000 + F.col("_pos")), key, "_turn")


def merge(found: DataFrame, key: str = "rid", order: str | None = None) -> DataFrame:
    """Per text, normalised name and type: the mention of highest confidence, of these the first by ``order`` or name."""
    named = found.withColumn("name_normalized", normalise_name(nfkc(F.col("name"))))
    first = F.col(order) if order else F.col("name")
    best = F.min_by(F.struct("name", "supertype", "confidence"), F.struct(-F.col("confidence"), first))
    got = named.groupBy(key, "name_normalized", "entity_type").agg(best.alias("b"))
    return got.select(key, F.col("b.name"), "entity_type", F.col("b.supertype"), "name_normalized", F.col("b.confidence"))


def distinct_entities(found: DataFrame, key: str = "rid") -> DataFrame:
    """Per text, name and type one entity, the first of the text."""
    return found.dropDuplicates([key, "name", "entity_type"])


def clean_triples(triples: DataFrame, key: str = "rid") -> DataFrame:
    """Triples (key, parts array<string>) of at least three parts, once for each text whatever case and blanks, as
    subject, predicate and object."""
    low = F.transform("parts", lambda x: F.lower(F.trim(x)))
    rows = triples.where(F.size("parts") >= 3).select(key, low.alias("parts")).where(~F.exists(F.slice("parts", 1, 3), lambda x: x.isNull() | (x == "")))
    return rows.select(key, F.col("parts")[0].alias("subject"), F.col("parts")[1].alias("predicate"), F.col("parts")[2].alias("object")).distinct()


def entity_table(found: DataFrame, when: str) -> DataFrame:
    """Entities over all texts: longest name, mentions, first and last seen."""
    named = found.withColumn("name_normalized", normalise_name(nfkc(F.col("name"))))
    return named.groupBy("name_normalized", "entity_type").agg(
        F.max_by("name", F.struct(F.length("name"), "name")).alias("name"),
        F.count(F.lit(1)).alias("mention_count"),
        F.min(when).alias("first_seen"),
        F.max(when).alias("last_seen"),
        F.max("confidence").alias("confidence"),
    )


def similar_names(entities: DataFrame, name: str, least: float = TRIGRAM_THRESHOLD) -> DataFrame:
    """Entities whose normalised name shares enough trigrams with ``name``, with their similarity."""
    q = normalise_name(F.lit(name))
    return entities.withColumn("similarity", F.round(set_similarity(trigrams(F.col("name_normalized")), trigrams(q)), 6)).where(F.col("similarity") >= least)


def search_entities(entities: DataFrame, name: str, entity_type: str | None = None, supertype: str | None = None, most: int = 20) -> DataFrame:
    rows = similar_names(entities, name)
    rows = rows.where(F.col("entity_type") == entity_type) if entity_type else rows
    rows = rows.where(F.col("supertype") == supertype) if supertype else rows
    return rows.orderBy(F.desc("similarity"), F.desc("mention_count"), "entity_id").limit(most)


def bundles_of_entity(entities: DataFrame, links: DataFrame, bundles: DataFrame, name: str, entity_type: str | None = None, most: int = 20) -> DataFrame:
    """Texts that mention a similar name, best similarity first, then confidence."""
    hits = similar_names(entities, name)
    hits = hits.where(F.col("entity_type") == entity_type) if entity_type else hits
    rows = links.join(hits.select("entity_id", "name", "entity_type", "similarity"), "entity_id").join(bundles.select("rid", "namespace"), "rid")
    return rows.select("rid", "namespace", "entity_id", "name", "similarity", "confidence").orderBy(F.desc("similarity"), F.desc("confidence"), "rid", "entity_id").limit(most)


def cooccurring(entities: DataFrame, links: DataFrame, name: str, most: int = 20) -> DataFrame:
    """Entities that share texts with the entities of a similar name: number of shared texts.

    Only the links of the named entities are joined with all links, so no pairs of other entities are made.
    """
    seeds = similar_names(entities, name).select("entity_id")
    own = links.join(seeds, "entity_id", "left_semi").select("rid").distinct()
    other = links.join(own, "rid", "left_semi").join(seeds, "entity_id", "left_anti")
    shared = other.groupBy("entity_id").agg(F.count_distinct("rid").alias("shared"))
    return shared.join(entities.select("entity_id", "name", "entity_type", "mention_count"), "entity_id").orderBy(F.desc("shared"), F.desc("mention_count"), "entity_id").limit(most)
