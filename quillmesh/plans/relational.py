"""Counts, joins, listings and set operations over the knowledge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmesh.functions import text as T
from quillmesh.operators import evaluation, ingest
from quillmesh.operators.retrieval import default_config
from quillmesh.plans.registry import query
from quillmesh.runtime import latest, table


def current(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, "bundles"), "rid", "updated_at", "rid", "updated_at", *columns)


@query("agg01_count_by_namespace", "WITH {CUR} SELECT namespace, count(*) AS bundles FROM cur GROUP BY namespace")
def agg01(spark, d):
    return current(spark, d, "namespace").groupBy("namespace").agg(F.count(F.lit(1)).alias("bundles"))


@query(
    "agg02_embedding_coverage",
    """WITH {CUR} SELECT e.config_id, c.namespace, count(DISTINCT e.rid) AS embedded, count(*) AS chunk_rows
    FROM chunk_embeddings e JOIN cur c USING (rid) GROUP BY 1, 2""",
)
def agg02(spark, d):
    b = current(spark, d, "namespace").select("rid", "namespace")
    e = table(spark, d, "chunk_embeddings").groupBy("config_id", "rid").agg(F.count(F.lit(1)).alias("n"))
    return e.join(b, "rid").groupBy("config_id", "namespace").agg(F.count(F.lit(1)).alias("embedded"), F.sum("n").alias("chunk_rows"))


@query(
    "agg04_entity_stats",
    """SELECT 'total' AS section, '' AS key, count(*) AS n FROM entities
    UNION ALL SELECT 'type', entity_type, count(*) FROM entities GROUP BY entity_type
    UNION ALL SELECT 'supertype', coalesce(supertype, ''), count(*) FROM entities GROUP BY coalesce(supertype, '')
    UNION ALL SELECT 'linked bundles', '', count(DISTINCT rid) FROM bundle_entities""",
)
def agg04(spark, d):
    e = table(spark, d, "entities")
    n = F.count(F.lit(1)).alias("n")
    return (
        e.agg(n).select(F.lit("total").alias("section"), F.lit("").alias("key"), "n")
        .unionByName(e.groupBy("entity_type").agg(n).select(F.lit("type").alias("section"), F.col("entity_type").alias("key"), "n"))
        .unionByName(e.groupBy(F.coalesce("supertype", F.lit("")).alias("key")).agg(n).select(F.lit("supertype").alias("section"), "key", "n"))
        .unionByName(table(spark, d, "bundle_entities").agg(F.count_distinct("rid").alias("n")).select(F.lit("linked bundles").alias("section"), F.lit("").alias("key"), "n"))
    )


@query("agg04_top_entities", "SELECT entity_id, name, mention_count FROM entities ORDER BY mention_count DESC, entity_id LIMIT 20")
def agg04_top(spark, d):
    return table(spark, d, "entities").select("entity_id", "name", "mention_count").orderBy(F.desc("mention_count"), "entity_id").limit(20)


@query(
    "agg09_thread_stats",
    r"""WITH {CUR}, m AS (SELECT regexp_extract(reference, '^[^:]+:(.+):[0-9]+$', 1) AS id, json_extract_string(CASE WHEN json_valid(contents) THEN contents END, '$.sender_id') AS sender FROM cur WHERE namespace LIKE '%-message')
    SELECT t.id, count(m.id) AS messages, coalesce(sum(CASE WHEN sender IN (SELECT sender_id FROM self_senders) THEN 1 ELSE 0 END), 0) AS own
    FROM threads t LEFT JOIN m USING (id) GROUP BY t.id""",
)
def agg09(spark, d):
    """Messages are counted per thread and sender first, so the hot thread reaches the join as a few rows."""
    m = latest(table(spark, d, "bundles").where(F.col("namespace").endswith("-message")), "rid", "updated_at", "rid", "reference", "contents")
    m = m.select(F.regexp_extract("reference", r"^[^:]+:(.+):[0-9]+$", 1).alias("id"), F.get_json_object("contents", "$.sender_id").alias("sender_id"))
    per = m.groupBy("id", "sender_id").agg(F.count(F.lit(1)).alias("n"))
    own = table(spark, d, "self_senders").select("sender_id", F.lit(True).alias("own")).distinct()
    stats = per.join(own, "sender_id", "left").groupBy("id").agg(F.sum("n").alias("messages"), F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("own"))
    return table(spark, d, "threads").select("id").join(stats, "id", "left").na.fill(0, ["messages", "own"])


VISITS = "events"


@query("agg10_visit_sums", "SELECT user_id, count(*) AS visits, min(ts) AS first_visit, max(ts) AS last_visit FROM events GROUP BY user_id")
def agg10(spark, d):
    return ingest.visits_rollup(table(spark, d, VISITS), "user_id", "ts", "event_type").select("user_id", "visits", "first_visit", "last_visit")


@query("agg10_visit_histogram", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def agg10_kinds(spark, d):
    r = ingest.visits_rollup(table(spark, d, VISITS), "user_id", "ts", "event_type")
    return r.select("user_id", F.explode("kinds").alias("event_type", "n"))


@query(
    "win09_recent_visits",
    "SELECT user_id, ts AS at, event_type AS kind FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) <= 100",
)
def win09(spark, d):
    r = ingest.visits_rollup(table(spark, d, VISITS), "user_id", "ts", "event_type")
    return r.select("user_id", F.explode("recent").alias("v")).select("user_id", "v.at", "v.kind")


@query("agg11_high_water", "SELECT max(updated_at) AS high_water FROM bundles")
def agg11(spark, d):
    return ingest.high_water(table(spark, d, "bundles"), "updated_at")


@query(
    "agg12_snapshot_merge",
    """WITH s AS (SELECT rid, updated_at, length(search_text) AS visit_count, length(contents) AS frecency, CASE WHEN json_valid(contents) THEN json_extract_string(contents, '$.title') END AS title,
      strftime(updated_at, '%Y-%m-%d') AS day, sha256_hash AS engagement FROM bundles WHERE namespace LIKE '%-browser-history')
    SELECT rid, max(visit_count) AS visit_count, max(frecency) AS frecency, arg_max(title, updated_at) FILTER (title IS NOT NULL) AS title,
      array_to_string(list_sort(list_distinct(list(day))), ',') AS days, arg_max(engagement, updated_at) AS engagement FROM s GROUP BY rid""",
)
def agg12(spark, d):
    s = table(spark, d, "bundles").where(F.col("namespace").endswith("-browser-history"))
    s = s.select("rid", "updated_at", F.length("search_text").alias("visit_count"), F.length("contents").alias("frecency"), F.get_json_object("contents", "$.title").alias("title"), F.array(F.date_format("updated_at", "yyyy-MM-dd")).alias("visits"), F.col("sha256_hash").alias("engagement"))
    return ingest.merge_snapshots(s, "rid", "updated_at").select("rid", "visit_count", "frecency", "title", F.array_join("visits", ",").alias("days"), "engagement")


@query("agg13_newest_version", "WITH {CUR} SELECT rid, sha256_hash, updated_at FROM cur")
def agg13(spark, d):
    return ingest.newest(table(spark, d, "bundles").select("rid", "updated_at", "sha256_hash"), "rid", "updated_at")




@query(
    "agg15_quantile_elements",
    """WITH o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
    SELECT max(CASE WHEN i = floor(n * 0.5) THEN value END) AS p50, max(CASE WHEN i = floor(n * 0.95) THEN value END) AS p95 FROM o""",
)
def agg15_elements(spark, d):
    return evaluation.quantile_elements(table(spark, d, "events"), "value")


@query("agg24_mean_chunks", "SELECT config_id, round(avg(n), 6) AS mean_chunks, count(*) AS bundles FROM (SELECT config_id, rid, count(*) AS n FROM chunk_embeddings GROUP BY ALL) GROUP BY config_id")
def agg24(spark, d):
    per = table(spark, d, "chunk_embeddings").groupBy("config_id", "rid").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("config_id").agg(F.round(F.avg("n"), 6).alias("mean_chunks"), F.count(F.lit(1)).alias("bundles"))


@query(
    "agg25_recent_rate",
    "WITH {CUR} SELECT namespace, round(count(*) / 7.0, 6) AS per_day FROM cur WHERE created_at > (SELECT max(created_at) FROM cur) - INTERVAL 7 DAYS GROUP BY namespace",
)
def agg25(spark, d):
    c = current(spark, d, "namespace", "created_at")
    top = c.agg(F.max("created_at").alias("now"))
    return c.crossJoin(F.broadcast(top)).where(F.col("created_at") > F.col("now") - F.expr("INTERVAL 7 DAYS")).groupBy("namespace").agg(F.round(F.count(F.lit(1)) / 7.0, 6).alias("per_day"))


@query("agg26_title_words", "SELECT w AS word, count(*) AS threads FROM (SELECT unnest(string_split('plan,graph,privacy,news,drift', ',')) AS w) JOIN threads ON contains(lower(title), w) GROUP BY w")
def agg26(spark, d):
    words = ["plan", "graph", "privacy", "news", "drift"]
    hit = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("title"), w))
    return table(spark, d, "threads").where("title is not null").select(F.explode(hit).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("threads"))


@query(
    "join02_links_by_type",
    "WITH {CUR} SELECT c.namespace, e.entity_type, count(*) AS links, sum(l.mention_count) AS mentions, round(avg(l.confidence), 6) AS confidence FROM bundle_entities l JOIN entities e USING (entity_id) JOIN cur c USING (rid) GROUP BY 1, 2",
)
def join02(spark, d):
    links = table(spark, d, "bundle_entities").join(table(spark, d, "entities").select("entity_id", "entity_type"), "entity_id").join(current(spark, d, "namespace").select("rid", "namespace"), "rid")
    return links.groupBy("namespace", "entity_type").agg(F.count(F.lit(1)).alias("links"), F.sum("mention_count").alias("mentions"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(
    "join06_unembedded",
    """WITH {CUR}, d AS (SELECT config_id FROM embedding_configs ORDER BY is_default DESC, created_at, config_id LIMIT 1)
    SELECT namespace, count(*) AS pending FROM cur WHERE search_text IS NOT NULL AND trim(search_text) <> '' AND NOT EXISTS (SELECT 1 FROM chunk_embeddings e WHERE e.rid = cur.rid AND e.config_id IN (SELECT config_id FROM d)) GROUP BY namespace""",
)
def join06(spark, d):
    done = table(spark, d, "chunk_embeddings").join(default_config(table(spark, d, "embedding_configs")).select("config_id"), "config_id", "left_semi")
    c = current(spark, d, "namespace", "search_text").where("search_text is not null and trim(search_text) <> ''")
    return ingest.without(c, done, "rid").groupBy("namespace").agg(F.count(F.lit(1)).alias("pending"))


@query("join06_unextracted", "WITH {CUR} SELECT namespace, count(*) AS pending FROM cur WHERE rid NOT IN (SELECT rid FROM bundle_entities) GROUP BY namespace")
def join06_entities(spark, d):
    return ingest.without(current(spark, d, "namespace"), table(spark, d, "bundle_entities"), "rid").groupBy("namespace").agg(F.count(F.lit(1)).alias("pending"))


@query("join07_links_per_bundle", "WITH {CUR} SELECT namespace, count(DISTINCT cur.rid) AS bundles, count(l.entity_id) AS links FROM cur LEFT JOIN bundle_entities l USING (rid) GROUP BY namespace")
def join07(spark, d):
    n = table(spark, d, "bundle_entities").where("entity_id is not null").groupBy("rid").agg(F.count(F.lit(1)).alias("n"))
    return current(spark, d, "namespace").join(n, "rid", "left").groupBy("namespace").agg(F.count(F.lit(1)).alias("bundles"), F.coalesce(F.sum("n"), F.lit(0)).alias("links"))


@query(
    "join10_recordings_transcripts",
    """WITH {CUR} SELECT r.rid, t.rid AS transcript FROM cur r LEFT JOIN cur t ON t.namespace LIKE '%-transcript' AND regexp_extract(t.reference, '([0-9a-f]+)$', 1) = regexp_extract(r.reference, '([0-9a-f]+)$', 1)
    WHERE r.namespace LIKE '%-recording'""",
)
def join10(spark, d):
    c = current(spark, d, "namespace", "reference").withColumn("tail", F.regexp_extract("reference", "([0-9a-f]+)$", 1))
    t = c.where(F.col("namespace").endswith("-transcript")).select("tail", F.col("rid").alias("transcript"))
    return c.where(F.col("namespace").endswith("-recording")).join(t, "tail", "left").select("rid", "transcript")


@query("join16_orphans", "SELECT 'chunks' AS child, count(*) AS n FROM chunk_embeddings WHERE rid NOT IN (SELECT rid FROM bundles) UNION ALL SELECT 'links', count(*) FROM bundle_entities WHERE rid NOT IN (SELECT rid FROM bundles)")
def join16(spark, d):
    b = table(spark, d, "bundles")
    n = F.count(F.lit(1)).alias("n")
    return ingest.orphans(table(spark, d, "chunk_embeddings"), b).agg(n).select(F.lit("chunks").alias("child"), "n").unionByName(ingest.orphans(table(spark, d, "bundle_entities"), b).agg(n).select(F.lit("links").alias("child"), "n"))


@query("flt01_namespace", "WITH {CUR} SELECT rid, created_at FROM cur WHERE namespace LIKE '%-plan'")
def flt01(spark, d):
    return latest(table(spark, d, "bundles").where(F.col("namespace").endswith("-plan")), "rid", "updated_at", "rid", "created_at")


@query("flt02_thread_messages", "WITH {CUR} SELECT rid FROM cur WHERE json_valid(contents) AND json_extract_string(contents, '$.thread_id') = '-100770001'")
def flt02(spark, d):
    return current(spark, d, "contents").where(F.get_json_object("contents", "$.thread_id") == "-100770001").select("rid")


@query(
    "flt04_junk",
    """WITH {CUR} SELECT namespace, count(*) AS junk FROM cur WHERE search_text IS NULL OR regexp_full_match(search_text, '\\s*') OR starts_with(search_text, '--00000000') OR starts_with(search_text, '<!doctype') OR starts_with(search_text, '<!DOCTYPE')
    OR regexp_matches(substr(search_text, 1, 100), '[A-Za-z0-9+/=]{60,}') GROUP BY namespace""".replace("\\\\", "\\"),
)
def flt04(spark, d):
    return current(spark, d, "namespace", "search_text").where(T.is_junk(F.col("search_text"))).groupBy("namespace").agg(F.count(F.lit(1)).alias("junk"))


@query("flt05_quality_gate", "WITH {CUR} SELECT namespace, count(*) AS passed FROM cur WHERE length(search_text) >= CASE WHEN namespace LIKE '%-message' THEN 20 ELSE 0 END GROUP BY namespace")
def flt05(spark, d):
    floor = F.when(F.col("namespace").endswith("-message"), 20).otherwise(0)
    return current(spark, d, "namespace", "search_text").where(F.length("search_text") >= floor).groupBy("namespace").agg(F.count(F.lit(1)).alias("passed"))


@query("flt09_confident_links", "SELECT rid, entity_id, confidence FROM bundle_entities WHERE confidence >= 0.3 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY confidence DESC, entity_id) <= 30")
def flt09(spark, d):
    w = W.partitionBy("rid").orderBy(F.desc("confidence"), "entity_id")
    return table(spark, d, "bundle_entities").where("confidence >= 0.3").withColumn("n", F.row_number().over(w)).where("n <= 30").select("rid", "entity_id", "confidence")


@query("flt15_sample", "WITH {CUR} SELECT namespace, rid FROM cur QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY sha256(rid || '42'), rid) <= 5")
def flt15(spark, d):
    """A sample by hash, ranked within salts before it is ranked within the namespace."""
    c = current(spark, d, "namespace").select("namespace", "rid", F.sha2(F.concat("rid", F.lit("42")), 256).alias("h"), F.pmod(F.xxhash64("rid"), F.lit(16)).alias("salt"))
    part = c.withColumn("n", F.row_number().over(W.partitionBy("namespace", "salt").orderBy("h", "rid"))).where("n <= 5")
    return part.withColumn("n", F.row_number().over(W.partitionBy("namespace").orderBy("h", "rid"))).where("n <= 5").select("namespace", "rid")


@query("top03_latest", "WITH {CUR} SELECT rid, created_at FROM cur ORDER BY created_at DESC, rid LIMIT 50")
def top03(spark, d):
    return current(spark, d, "created_at").select("rid", "created_at").orderBy(F.desc("created_at"), "rid").limit(50)


@query(
    "top04_thread_view",
    "WITH {CUR} SELECT rid, created_at FROM cur WHERE namespace LIKE '%-message' AND json_valid(contents) AND json_extract_string(contents, '$.thread_id') = '-100770001' ORDER BY created_at, rid LIMIT 50",
)
def top04(spark, d):
    c = latest(table(spark, d, "bundles").where(F.col("namespace").endswith("-message")), "rid", "updated_at", "rid", "created_at", "contents")
    return c.where(F.get_json_object("contents", "$.thread_id") == "-100770001").select("rid", "created_at").orderBy("created_at", "rid").limit(50)


@query("top07_page", "SELECT entity_id, name FROM entities ORDER BY entity_id LIMIT 25 OFFSET 50")
def top07(spark, d):
    return table(spark, d, "entities").select("entity_id", "name").orderBy("entity_id").offset(50).limit(25)


@query("set01_union_of_rids", "SELECT rid FROM chunk_embeddings WHERE rid IS NOT NULL UNION SELECT rid FROM bundle_entities")
def set01(spark, d):
    return table(spark, d, "chunk_embeddings").select("rid").where("rid is not null").union(table(spark, d, "bundle_entities").select("rid")).distinct()


@query("set02_intersection", "SELECT count(*) AS n FROM (SELECT rid FROM chunk_embeddings INTERSECT SELECT rid FROM bundle_entities)")
def set02(spark, d):
    return table(spark, d, "chunk_embeddings").select("rid").intersect(table(spark, d, "bundle_entities").select("rid")).agg(F.count(F.lit(1)).alias("n"))


@query("set03_difference", "SELECT rid FROM chunk_embeddings EXCEPT SELECT rid FROM bundle_entities")
def set03(spark, d):
    return table(spark, d, "chunk_embeddings").select("rid").subtract(table(spark, d, "bundle_entities").select("rid"))


@query(
    "win06_is_latest",
    "SELECT rid, updated_at, sha256_hash, row_number() OVER (PARTITION BY rid ORDER BY updated_at DESC) = 1 AS is_latest FROM (SELECT DISTINCT rid, updated_at, sha256_hash FROM bundles)",
)
def win06(spark, d):
    v = table(spark, d, "bundles").select("rid", "updated_at", "sha256_hash").distinct()
    return v.withColumn("is_latest", F.row_number().over(W.partitionBy("rid").orderBy(F.desc("updated_at"))) == 1)


@query("win07_first_and_last", "SELECT rid, arg_min(search_text, updated_at) FILTER (search_text IS NOT NULL) AS first_text, max(updated_at) AS last_at FROM (SELECT DISTINCT rid, updated_at, search_text FROM bundles) GROUP BY rid")
def win07(spark, d):
    b = table(spark, d, "bundles")
    return b.groupBy("rid").agg(F.min_by("search_text", F.when(F.col("search_text").isNotNull(), F.col("updated_at"))).alias("first_text"), F.max("updated_at").alias("last_at"))
