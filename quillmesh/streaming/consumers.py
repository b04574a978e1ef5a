"""What happens to a changed bundle: it is cut and embedded, and its entities are extracted and merged.

Each consumer is a function of a micro-batch; its table is split by a hash of the rid, and a batch rewrites only the
parts it touches, so a batch that is run again after a failure gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import bundles as B
from quillmesh.functions import text as T
from quillmesh.operators import entities, ingest
from quillmesh.operators.retrieval import EMBEDDERS
from quillmesh.runtime import durable
from quillmesh.sources.sinks import replace_parts

#: Messages under these lengths are neither embedded nor searched for entities.
LEAST_TO_EMBED, LEAST_TO_EXTRACT = 20, 30


#: Folders that a consumer's table is split in by a hash of the key; a batch rewrites only those it touches.
PARTS = 64


def _part(key: str = "rid"):
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _merge_parts(batch: DataFrame, path: str, make) -> None:
    """Rewrites the parts of the table that hold keys of the batch: ``make`` gives their rows from the old ones."""
    spark = batch.sparkSession
    touched = sorted(r.part for r in batch.select(_part().alias("part")).distinct().collect())  # at most PARTS
    if not touched:
        return
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    old = spark.read.parquet(path).where(F.col("part").isin(*touched)).drop("part") if there else None
    new = durable(make(old).withColumn("part", _part()))
    replace_parts(new, path, "part")
    for part in set(touched) - {r.part for r in new.select("part").distinct().collect()}:  # nothing is left of these
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def long_enough(bundles: DataFrame, least: int) -> DataFrame:
    floor = F.when(B.kind() == "message", least).otherwise(1)
    return bundles.where(F.length(F.trim("search_text")) >= floor)


def chunk_and_embed(bundles: DataFrame, config_id: str, embedder: str = "hashing", dimensions: int = 64, context: bool = False) -> DataFrame:
    """``(config_id, rid, chunk_index, chunk_text, embedding)``; with ``context`` the preamble is embedded with each chunk."""
    rows = long_enough(bundles, LEAST_TO_EMBED)
    lead = B.preamble() if context else F.lit("")
    cut = rows.select("rid", lead.alias("lead"), F.posexplode(T.chunks(F.col("search_text"))).alias("chunk_index", "chunk_text"))
    embed = EMBEDDERS.create(embedder, dimensions)
    return cut.select(F.lit(config_id).alias("config_id"), "rid", "chunk_index", "chunk_text", embed(B.with_preamble(F.col("lead"), F.col("chunk_text"))).alias("embedding"))


def embed_consumer(path: str, config_id: str, **options):
    """Replaces all chunks of the bundles of a batch."""

    def handle(batch: DataFrame, number: int) -> None:
        new = chunk_and_embed(batch, config_id, **options)
        _merge_parts(batch, path, lambda old: new if old is None else ingest.without(old, batch, "rid").unionByName(new))

    return handle


def extract_consumer(path: str, pipeline: str = "default"):
    """Replaces the entities of the bundles of a batch."""

    def handle(batch: DataFrame, number: int) -> None:
        new = entities.run_pipeline(long_enough(batch, LEAST_TO_EXTRACT), pipeline)
        _merge_parts(batch, path, lambda old: new if old is None else ingest.without(old, batch, "rid").unionByName(new))

    return handle


def merge_consumer(path: str, keys: tuple[str, ...] = ("rid",), kept: tuple[str, ...] = ingest.BUNDLE_KEPT, changed: str = "sha256_hash"):
    """Upserts a batch of bundles into a table, the last version of each in the batch."""

    def handle(batch: DataFrame, number: int) -> None:
        new = ingest.last_of_batch(batch, list(keys), ["updated_at"])
        _merge_parts(batch, path, lambda old: new if old is None else ingest.upsert(old, new, list(keys), kept, changed).select(*new.columns))

    return handle
