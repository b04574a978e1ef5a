"""Upserts, deletions, renames and change feeds, shown on the tables' own versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import rids
from quillmesh.functions.bundles import kind
from quillmesh.operators import entities, graph, ingest
from quillmesh.plans.registry import query
from quillmesh.plans.relational import current
from quillmesh.runtime import latest, table


def _first(spark, d):
    """The earliest version of each rid."""
    b = table(spark, d, "bundles")
    rest = ["namespace", "reference", "sha256_hash", "created_at"]
    return b.groupBy("rid").agg(F.min(F.struct("updated_at", *rest)).alias("r")).select("rid", *[F.col(f"r.{c}").alias(c) for c in rest], F.col("r.updated_at").alias("updated_at"))


def _last(spark, d):
    return current(spark, d, "namespace", "reference", "sha256_hash", "created_at").select("rid", "namespace", "reference", "sha256_hash", "created_at", "updated_at")


FIRST = "fst AS (SELECT * EXCLUDE (_n) FROM (SELECT rid, namespace, reference, sha256_hash, created_at, updated_at, row_number() OVER (PARTITION BY rid ORDER BY updated_at, namespace, reference, sha256_hash) AS _n FROM bundles) WHERE _n = 1)"


@query("snk01_upsert", f"WITH {FIRST}, {{CUR}} SELECT c.rid, c.sha256_hash, f.created_at, c.updated_at FROM cur c JOIN fst f USING (rid)")
def snk01(spark, d):
    return ingest.upsert(_first(spark, d), _last(spark, d), ["rid"], ingest.BUNDLE_KEPT).select("rid", "sha256_hash", "created_at", "updated_at")


@query("snk02_batch_last_writer", "SELECT namespace, arg_max(rid, (updated_at, rid)) AS rid, max(updated_at) AS updated_at FROM bundles GROUP BY namespace")
def snk02(spark, d):
    return ingest.last_of_batch(table(spark, d, "bundles").select("namespace", "updated_at", "rid"), ["namespace"], ["updated_at", "rid"])


@query(
    "snk03_conditional_upsert",
    f"WITH {FIRST}, {{CUR}} SELECT f.rid, c.sha256_hash, CASE WHEN c.sha256_hash IS DISTINCT FROM f.sha256_hash THEN c.updated_at ELSE f.updated_at END AS updated_at FROM fst f JOIN cur c USING (rid)",
)
def snk03(spark, d):
    return ingest.upsert(_first(spark, d), _last(spark, d), ["rid"], ingest.BUNDLE_KEPT, changed="sha256_hash").select("rid", "sha256_hash", "updated_at")


@query("snk05_chunk_upsert", "SELECT coalesce(f.rid, e.rid) AS rid, coalesce(f.chunk_index, e.chunk_index) AS chunk_index, CASE WHEN f.rid IS NOT NULL THEN f.t ELSE e.t END AS chunk_text FROM (SELECT rid, chunk_index, max(chunk_text) AS t FROM chunk_embeddings GROUP BY ALL) e FULL JOIN (SELECT rid, chunk_index, max(chunk_text) AS t FROM chunk_fix GROUP BY ALL) f ON e.rid = f.rid AND e.chunk_index = f.chunk_index")
def snk05(spark, d):
    one = lambda name: table(spark, d, name).groupBy("rid", "chunk_index").agg(F.max("chunk_text").alias("chunk_text"))
    return ingest.upsert(one("chunk_embeddings"), one("chunk_fix"), ["rid", "chunk_index"])


@query("snk06_delete_chunks", "SELECT vec_id FROM chunk_embeddings WHERE rid NOT IN (SELECT rid FROM chunk_fix WHERE rid IS NOT NULL)")
def snk06(spark, d):
    return ingest.without(table(spark, d, "chunk_embeddings"), table(spark, d, "chunk_fix").where("rid is not null"), "rid").select("vec_id")


@query("snk07_stale_chunks", "SELECT e.vec_id FROM chunk_embeddings e LEFT JOIN (SELECT rid, count(DISTINCT chunk_index) AS n FROM chunk_fix GROUP BY rid) c USING (rid) WHERE c.n IS NULL OR e.chunk_index < c.n")
def snk07(spark, d):
    counts = table(spark, d, "chunk_fix").groupBy("rid").agg(F.count_distinct("chunk_index").alias("n"))
    return ingest.without_stale_chunks(table(spark, d, "chunk_embeddings"), counts).select("vec_id")


@query(
    "snk08_entity_upsert",
    r"""SELECT lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS name_normalized, entity_type, arg_max(name, (length(name), name)) AS name, count(*) AS mention_count, min(l.created_at) AS first_seen, max(l.created_at) AS last_seen, max(confidence) AS confidence
    FROM bundle_entities l JOIN entities e USING (entity_id) GROUP BY 1, 2""",
)
def snk08(spark, d):
    found = table(spark, d, "bundle_entities").select("entity_id", "confidence", "created_at").join(table(spark, d, "entities").select("entity_id", "name", "entity_type"), "entity_id")
    return entities.entity_table(found, "created_at").select("name_normalized", "entity_type", "name", "mention_count", "first_seen", "last_seen", "confidence")


@query("snk09_links_do_nothing", "SELECT rid, entity_id, CASE WHEN s = 0 THEN confidence ELSE 0.9 END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY rid, entity_id ORDER BY s) AS n FROM (SELECT rid, entity_id, max(confidence) AS confidence, 0 AS s FROM bundle_entities GROUP BY ALL UNION ALL SELECT DISTINCT rid, 1 AS entity_id, 0.9, 1 FROM bundle_entities)) WHERE n = 1")
def snk09(spark, d):
    known = table(spark, d, "bundle_entities").groupBy("rid", "entity_id").agg(F.max("confidence").alias("confidence"))
    new = known.select("rid", F.lit(1).cast("long").alias("entity_id"), F.lit(0.9).alias("confidence")).distinct()
    return known.unionByName(ingest.without(new, known, "rid", "entity_id"))


@query("snk10_purge_cascade", "SELECT 'chunks' AS part, count(*) AS n FROM chunk_embeddings WHERE rid NOT IN (SELECT rid FROM bundles WHERE namespace LIKE '%-message') UNION ALL SELECT 'links', count(*) FROM bundle_entities WHERE rid NOT IN (SELECT rid FROM bundles WHERE namespace LIKE '%-message')")
def snk10(spark, d):
    gone = table(spark, d, "bundles").where(F.col("namespace").endswith("-message"))
    left = ingest.cascade({"chunks": table(spark, d, "chunk_embeddings"), "links": table(spark, d, "bundle_entities")}, gone)
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, t in left.items()]
    return parts[0].unionByName(parts[1])


@query("snk12_fill_json_field", "WITH {CUR}, m AS (SELECT rid, contents, json_valid(contents) AS ok FROM cur WHERE namespace LIKE '%-message') SELECT rid, CASE WHEN ok THEN coalesce(json_extract_string(contents, '$.reply_to'), 'none') END AS reply_to, CASE WHEN ok THEN json_extract_string(contents, '$.content') END AS content, CASE WHEN ok THEN coalesce(json_extract_string(contents, '$.note'), 'a \"b\"') END AS note FROM m")
def snk12(spark, d):
    """Two fields put into the JSON of every message that lacks them, and read again."""
    m = latest(table(spark, d, "bundles").where(F.col("namespace").endswith("-message")), "rid", "updated_at", "rid", "contents")
    new = m.select("rid", ingest.set_field(ingest.set_field(F.col("contents"), "reply_to", F.lit("none")), "note", F.lit('a "b"')).alias("c"))
    return new.select("rid", *[F.get_json_object("c", f"$.{f}").alias(f) for f in ("reply_to", "content", "note")])


@query(
    "snk13_restore_chunk_text",
    "WITH f AS (SELECT rid, chunk_index, max(chunk_text) AS t FROM chunk_fix GROUP BY ALL) SELECT e.vec_id, CASE WHEN (e.chunk_text IS NULL OR length(e.chunk_text) <= 200) AND f.t IS NOT NULL THEN f.t ELSE e.chunk_text END AS chunk_text FROM chunk_embeddings e LEFT JOIN f ON e.rid = f.rid AND e.chunk_index = f.chunk_index",
)
def snk13(spark, d):
    fix = table(spark, d, "chunk_fix").groupBy("rid", "chunk_index").agg(F.max("chunk_text").alias("chunk_text"))
    short = F.col("chunk_text").isNull() | (F.length("chunk_text") <= 200)
    return ingest.fill_from(table(spark, d, "chunk_embeddings"), fix, ["rid", "chunk_index"], "chunk_text", short).select("vec_id", "chunk_text")


@query("snk14_rename_namespace", "WITH {CUR} SELECT regexp_replace(rid, '^(orn:[^:]*)-plan:', '\\1-outline:') AS rid, regexp_replace(namespace, '-plan$', '-outline') AS namespace FROM cur")
def snk14(spark, d):
    c = current(spark, d, "namespace").select("rid", "namespace")
    names = {r.namespace: r.namespace.removesuffix("-plan") + "-outline" for r in c.where(F.col("namespace").endswith("-plan")).select("namespace").distinct().collect()}
    return ingest.rename_namespaces(c, names or {"": ""})


@query(
    "snk15_merge_triples",
    "SELECT e.supertype AS src, e.entity_type AS type, split_part(l.rid, ':', 2) AS dst, round(1.0 + 0.1 * (count(*) - 1), 6) AS weight, arg_min(l.rid, (l.created_at, l.rid)) AS source, max(l.created_at) AS last_accessed FROM bundle_entities l JOIN entities e USING (entity_id) GROUP BY 1, 2, 3",
)
def snk15(spark, d):
    t = table(spark, d, "bundle_entities").join(table(spark, d, "entities").select("entity_id", "supertype", "entity_type"), "entity_id")
    return graph.merge_triples(t.select(F.col("supertype").alias("src"), F.col("entity_type").alias("type"), F.split("rid", ":")[1].alias("dst"), F.col("rid").alias("source"), F.col("created_at").alias("at")))


@query("snk16_rids_per_entity", "SELECT entity_id, count(DISTINCT rid) AS n, min(rid) AS first_rid FROM bundle_entities GROUP BY entity_id")
def snk16(spark, d):
    return table(spark, d, "bundle_entities").groupBy("entity_id").agg(F.count_distinct("rid").alias("n"), F.min("rid").alias("first_rid"))


@query("stm01_change_feed", f"WITH {FIRST}, {{CUR}} SELECT c.rid, 'bundle.updated' AS event FROM cur c JOIN fst f USING (rid) WHERE c.sha256_hash IS DISTINCT FROM f.sha256_hash")
def stm01(spark, d):
    return ingest.change_feed(_first(spark, d), _last(spark, d))


@query("stm08_change_detection", f"WITH {FIRST}, {{CUR}} SELECT CASE WHEN f.rid IS NULL THEN 'new' WHEN f.sha256_hash <> c.sha256_hash THEN 'update' ELSE 'same' END AS change, count(*) AS n FROM cur c LEFT JOIN (SELECT * FROM fst WHERE namespace NOT LIKE '%-task') f USING (rid) GROUP BY 1")
def stm08(spark, d):
    state = _first(spark, d).where(~F.col("namespace").endswith("-task")).select("rid", F.col("sha256_hash").alias("hash"))
    return ingest.changes(state, _last(spark, d).select("rid", F.col("sha256_hash").alias("hash"))).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("stm09_since_high_water", "SELECT vec_id FROM (SELECT vec_id FROM chunk_embeddings WHERE vec_id > 100 ORDER BY vec_id LIMIT 1000)")
def stm09(spark, d):
    """A poll takes at most so many rows behind its mark; the batch size is the feature."""
    return ingest.since(table(spark, d, "chunk_embeddings").select("vec_id"), "vec_id", 100, 1000)


@query(
    "rid_codecs",
    r"""WITH {CUR}, k AS (SELECT rid, regexp_replace(namespace, '^[^-]*-', '') AS kind, reference FROM cur),
    p AS (SELECT rid, kind, reference, strpos(reference, '/') AS slash FROM k)
    SELECT rid, split_part(rid, ':', 2) AS namespace, CASE WHEN kind IN ('browser-history', 'journal', 'recording', 'youtube') THEN CASE WHEN slash > 0 AND (kind = 'youtube' OR (slash > 1 AND slash < length(reference))) THEN substr(reference, 1, slash - 1) END ELSE nullif(reference, '') END AS part1,
      CASE WHEN kind IN ('browser-history', 'journal', 'recording', 'youtube') AND slash > 0 AND (kind = 'youtube' OR (slash > 1 AND slash < length(reference))) THEN substr(reference, slash + 1) END AS part2 FROM p""",
)
def rid_codecs(spark, d):
    c = current(spark, d, "namespace", "reference")
    p = rids.parts(kind(), F.col("reference"))
    return c.select("rid", rids.parse(F.col("rid"))["namespace"].alias("namespace"), p[0].alias("part1"), F.get(p, F.lit(1)).alias("part2"))


@query("rid_round_trip", "WITH {CUR} SELECT count(*) AS n FROM cur WHERE rid = 'orn:' || namespace || ':' || reference")
def rid_round_trip(spark, d):
    c = current(spark, d, "namespace", "reference")
    return c.where(F.col("rid") == rids.make(F.col("namespace"), F.col("reference"))).agg(F.count(F.lit(1)).alias("n"))
