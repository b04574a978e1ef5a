"""More of the operators over the whole tables: projections, joins, windows, scalars, retrieval steps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmesh.functions import bundles as B
from quillmesh.functions import ontology
from quillmesh.functions import text as T
from quillmesh.functions import urls as U
from quillmesh.functions import vectors as V
from quillmesh.operators import entities, graph, ingest, retrieval
from quillmesh.plans import textual  # noqa: F401  (its SQL is used below)
from quillmesh.plans.registry import ORACLE, query
from quillmesh.plans.relational import current
from quillmesh.plans.retrieval import _SIM, NAME, NATION_EDGES, QUERY, nation_edges, ret03
from quillmesh.runtime import latest, table

_J = "CASE WHEN json_valid(contents) THEN contents END"


def kind_rows(spark, d, suffix: str, *columns: str):
    return latest(table(spark, d, "bundles").where(F.col("namespace").endswith(suffix)), "rid", "updated_at", "rid", "updated_at", *columns)


@query("prj05_rid_table", "WITH {CUR} SELECT rid, rpad(rid, 60, ' ') || rpad(namespace, 32, ' ') || strftime(created_at, '%Y-%m-%d') AS line FROM cur")
def prj05(spark, d):
    c = current(spark, d, "namespace", "created_at")
    return c.select("rid", F.concat(F.rpad("rid", 60, " "), F.rpad("namespace", 32, " "), F.date_format("created_at", "yyyy-MM-dd")).alias("line"))


@query("prj07_transcript_view", f"WITH {{CUR}} SELECT rid, coalesce(json_extract_string({_J}, '$.title'), '') || chr(10) || coalesce(json_extract_string({_J}, '$.full_text'), '') AS view FROM cur WHERE namespace LIKE '%-transcript'")
def prj07(spark, d):
    return kind_rows(spark, d, "-transcript", "contents").select("rid", F.concat_ws("\n", B.field("title"), B.field("full_text")).alias("view"))


@query(
    "prj08_missing_fields",
    f"WITH {{CUR}} SELECT rid, array_to_string(list_filter(['title', 'goal', 'body'], lambda f: coalesce(json_extract_string({_J}, '$.' || f), '') = ''), ',') AS missing FROM cur WHERE namespace LIKE '%-plan'",
)
def prj08(spark, d):
    gone = [F.when(B.field(f) == "", F.lit(f)) for f in ("title", "goal", "body")]
    return kind_rows(spark, d, "-plan", "contents").select("rid", F.array_join(F.array_compact(F.array(*gone)), ",").alias("missing"))


@query("flt03_term_match", r"WITH {CUR} SELECT rid FROM cur WHERE search_text IS NOT NULL AND list_contains(regexp_split_to_array(lower(search_text), '[^\p{L}\p{N}]+'), 'watermark')")
def flt03(spark, d):
    return current(spark, d, "search_text").where(F.array_contains(T.tokens(F.col("search_text")), "watermark")).select("rid")


@query("flt07_suppressed_domains", f"WITH {{CUR}} SELECT rid FROM cur WHERE namespace LIKE '%-browser-history' AND regexp_matches(lower(regexp_extract(json_extract_string({_J}, '$.url'), '^[a-zA-Z]+://([^/?#]*)', 1)), '^(z.*\\.example|b[a-e].*)$')")
def flt07(spark, d):
    u = F.get_json_object("contents", "$.url")
    return kind_rows(spark, d, "-browser-history", "contents").where(U.suppressed(u, ["z*.example", "b[a-e]*"])).select("rid")


@query("flt08_skipped_namespaces", "WITH {CUR} SELECT namespace, count(*) AS n FROM cur WHERE namespace NOT LIKE '%-browser-history' AND namespace NOT LIKE '%-code' GROUP BY namespace")
def flt08(spark, d):
    return current(spark, d, "namespace").where(~B.kind().isin("browser-history", "code")).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@query("flt12_visit_types", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def flt12(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "view")).select("event_id")


@query("flt14_least_length", "WITH {CUR} SELECT CASE WHEN length(search_text) >= 100 THEN 'long' WHEN length(search_text) >= 50 THEN 'middle' ELSE 'short' END AS size, count(*) AS n FROM cur WHERE search_text IS NOT NULL GROUP BY 1")
def flt14(spark, d):
    n = F.length("search_text")
    return current(spark, d, "search_text").where("search_text is not null").groupBy(F.when(n >= 100, "long").when(n >= 50, "middle").otherwise("short").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("join01_chunks_of_bundles", "WITH {CUR} SELECT c.namespace, count(*) AS chunks FROM chunk_embeddings e JOIN cur c USING (rid) GROUP BY c.namespace")
def join01(spark, d):
    n = table(spark, d, "chunk_embeddings").groupBy("rid").agg(F.count(F.lit(1)).alias("n"))
    return n.join(current(spark, d, "namespace").select("rid", "namespace"), "rid").groupBy("namespace").agg(F.sum("n").alias("chunks"))


@query("join04_visits_of_places", "SELECT p.p_brand AS place, count(*) AS visits FROM events e JOIN part p ON p.p_partkey = e.event_id % 200 GROUP BY 1")
def join04(spark, d):
    v = table(spark, d, "events").groupBy((F.col("event_id") % 200).alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return v.join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("place")), "p_partkey").groupBy("place").agg(F.sum("n").alias("visits"))


@query("join05_bookmarks_and_tags", f"WITH {{CUR}}, b AS (SELECT rid, json_extract_string({_J}, '$.folder_path') AS folder, CAST(json_extract({_J}, '$.tags') AS VARCHAR[]) AS tags FROM cur WHERE namespace LIKE '%-browser-history' AND json_extract_string({_J}, '$.type') = 'bookmark') SELECT rid, folder, unnest(CASE WHEN len(tags) > 0 THEN tags ELSE [NULL] END) AS tag FROM b")
def join05(spark, d):
    b = kind_rows(spark, d, "-browser-history", "contents").where(F.get_json_object("contents", "$.type") == "bookmark")
    return b.select("rid", F.get_json_object("contents", "$.folder_path").alias("folder"), F.explode_outer(F.from_json(F.get_json_object("contents", "$.tags"), "array<string>")).alias("tag"))


@query(
    "join08_threads_with_statistics",
    rf"""WITH {{CUR}}, m AS (SELECT regexp_extract(reference, '^[^:]+:(.+):[0-9]+$', 1) AS id, coalesce(length(json_extract_string({_J}, '$.content')), 0) AS n, CASE WHEN json_extract_string({_J}, '$.reply_to') IS NOT NULL THEN 1 ELSE 0 END AS r FROM cur WHERE namespace LIKE '%-message')
    SELECT t.id, count(m.id) AS messages, coalesce(sum(n), 0) AS characters, coalesce(sum(r), 0) AS replies FROM threads t LEFT JOIN m USING (id) GROUP BY t.id""",
)
def join08(spark, d):
    """Every thread with the numbers of its messages; summed per thread before the join, as one thread holds very many."""
    m = kind_rows(spark, d, "-message", "reference", "contents").select(F.regexp_extract("reference", r"^[^:]+:(.+):[0-9]+$", 1).alias("id"), F.coalesce(F.length(F.get_json_object("contents", "$.content")), F.lit(0)).alias("n"), F.get_json_object("contents", "$.reply_to").isNotNull().cast("int").alias("r"))
    sums = m.groupBy("id").agg(F.count(F.lit(1)).alias("messages"), F.sum("n").alias("characters"), F.sum("r").alias("replies"))
    return table(spark, d, "threads").groupBy("id").agg(F.count(F.lit(1)).alias("_rows")).join(sums, "id", "left").select("id", *[F.coalesce(F.col(c) * F.col("_rows"), F.lit(0)).alias(c) for c in ("messages", "characters", "replies")])


@query("join17_judged_hits", "WITH {CUR} SELECT c.rid, coalesce(max(l.mention_count), 0) AS grade FROM cur c LEFT JOIN bundle_entities l ON l.rid = c.rid AND l.confidence > 0.9 WHERE c.namespace LIKE '%-plan' GROUP BY c.rid")
def join17(spark, d):
    g = table(spark, d, "bundle_entities").where("confidence > 0.9").groupBy("rid").agg(F.max("mention_count").alias("grade"))
    return kind_rows(spark, d, "-plan").select("rid").join(g, "rid", "left").na.fill(0, ["grade"])


@query("join18_not_yet_processed", "WITH {CUR} SELECT rid FROM cur WHERE rid NOT IN (SELECT rid FROM chunk_fix WHERE rid IS NOT NULL) AND namespace LIKE '%-recording'")
def join18(spark, d):
    return ingest.without(kind_rows(spark, d, "-recording").select("rid"), table(spark, d, "chunk_fix").where("rid is not null"), "rid")


@query("agg05_longest_chunk", "SELECT rid, max(length(chunk_text)) AS n FROM chunk_embeddings WHERE chunk_text IS NOT NULL GROUP BY rid")
def agg05(spark, d):
    return table(spark, d, "chunk_embeddings").where("chunk_text is not null").groupBy("rid").agg(F.max(F.length("chunk_text")).alias("n"))


@query("agg08_distinct_mentions", "SELECT name_normalized, count(DISTINCT entity_type) AS types FROM entities GROUP BY name_normalized HAVING count(DISTINCT entity_type) > 1")
def agg08(spark, d):
    e = table(spark, d, "entities").select("name_normalized", "entity_type").distinct()
    return e.groupBy("name_normalized").agg(F.count(F.lit(1)).alias("types")).where("types > 1")


@query("agg17_out_weights", f"WITH {NATION_EDGES} SELECT src, round(sum(w), 2) AS total, count(*) AS targets FROM e GROUP BY src")
def agg17(spark, d):
    return nation_edges(spark, d).groupBy("src").agg(F.round(F.sum("weight"), 2).alias("total"), F.count(F.lit(1)).alias("targets"))


@query("agg18_best_entity_score", "SELECT l.rid, max(e.mention_count) AS score FROM bundle_entities l JOIN (SELECT * FROM entities ORDER BY mention_count DESC, entity_id LIMIT 50) e USING (entity_id) GROUP BY l.rid")
def agg18(spark, d):
    """Only the fifty best nodes count; that is the feature."""
    best = table(spark, d, "entities").select("entity_id", "mention_count").orderBy(F.desc("mention_count"), "entity_id").limit(50)
    return table(spark, d, "bundle_entities").select("rid", "entity_id").join(F.broadcast(best), "entity_id").groupBy("rid").agg(F.max("mention_count").alias("score"))


@query("agg20_label_histogram", f"WITH {{CUR}} SELECT json_extract_string({_J}, '$.content_type') AS kind, count(*) AS n FROM cur WHERE namespace LIKE '%-message' GROUP BY 1")
def agg20(spark, d):
    return kind_rows(spark, d, "-message", "contents").groupBy(F.get_json_object("contents", "$.content_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("agg23_source_prefixes", "SELECT split_part(rid, ':', 2) AS prefix, count(*) AS links, count(DISTINCT entity_id) AS entities FROM bundle_entities GROUP BY 1")
def agg23(spark, d):
    l = table(spark, d, "bundle_entities").select(F.split("rid", ":")[1].alias("prefix"), "entity_id")
    per = l.groupBy("prefix", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("prefix").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("entities"))


@query("win02_rank_positions", "SELECT rid, entity_id, row_number() OVER (PARTITION BY rid ORDER BY confidence DESC, entity_id) AS pos FROM bundle_entities")
def win02(spark, d):
    return table(spark, d, "bundle_entities").select("rid", "entity_id", F.row_number().over(W.partitionBy("rid").orderBy(F.desc("confidence"), "entity_id")).alias("pos"))


@query("win03_scaled_scores", "SELECT rid, entity_id, round(CASE WHEN max(confidence) OVER w > min(confidence) OVER w THEN (confidence - min(confidence) OVER w) / (max(confidence) OVER w - min(confidence) OVER w) ELSE 1.0 END, 6) AS scaled FROM bundle_entities WINDOW w AS (PARTITION BY rid)")
def win03(spark, d):
    w = W.partitionBy("rid")
    low, high = F.min("confidence").over(w), F.max("confidence").over(w)
    return table(spark, d, "bundle_entities").select("rid", "entity_id", F.round(F.when(high > low, (F.col("confidence") - low) / (high - low)).otherwise(1.0), 6).alias("scaled"))


@query("win04_running_hits", "SELECT rid, entity_id, sum(CASE WHEN mention_count > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY confidence DESC, entity_id) AS hits FROM bundle_entities")
def win04(spark, d):
    w = W.partitionBy("rid").orderBy(F.desc("confidence"), "entity_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return table(spark, d, "bundle_entities").select("rid", "entity_id", F.sum(F.when(F.col("mention_count") > 2, 1).otherwise(0)).over(w).alias("hits"))


@query("win05_ideal_gain", "SELECT rid, round(sum(mention_count / log2(n + 1)), 6) AS idcg FROM (SELECT rid, mention_count, row_number() OVER (PARTITION BY rid ORDER BY mention_count DESC, entity_id) AS n FROM bundle_entities) WHERE n <= 10 GROUP BY rid")
def win05(spark, d):
    w = W.partitionBy("rid").orderBy(F.desc("mention_count"), "entity_id")
    r = table(spark, d, "bundle_entities").select("rid", "mention_count", F.row_number().over(w).alias("n")).where("n <= 10")
    return r.groupBy("rid").agg(F.round(F.sum(F.col("mention_count") / F.log2(F.col("n") + 1)), 6).alias("idcg"))


@query("win08_numbered_messages", f"WITH {{CUR}}, m AS (SELECT rid, json_extract({_J}, '$.chat_messages') AS m FROM cur WHERE namespace LIKE '%-web.conversation'), x AS (SELECT rid, unnest(range(json_array_length(m)::BIGINT)) AS pos, m FROM m WHERE m IS NOT NULL) SELECT rid, pos, json_extract_string(m, '$[' || pos || '].sender') AS sender FROM x")
def win08(spark, d):
    rows = F.from_json(F.get_json_object("contents", "$.chat_messages"), "array<struct<sender:string,text:string>>")
    return kind_rows(spark, d, "-web.conversation", "contents").select("rid", F.posexplode(rows).alias("pos", "m")).select("rid", "pos", "m.sender")


@query("win10_difference_to_first", "SELECT event_type, m, round(s - first_value(s) OVER (PARTITION BY event_type ORDER BY m), 2) AS change FROM (SELECT event_type, date_trunc('week', ts) AS m, max(value) AS s FROM events GROUP BY 1, 2)")
def win10(spark, d):
    s = table(spark, d, "events").groupBy("event_type", F.date_trunc("week", "ts").alias("m")).agg(F.max("value").alias("s"))
    first = F.first("s").over(W.partitionBy("event_type").orderBy("m").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return s.select("event_type", F.col("m").cast("timestamp_ntz").alias("m"), F.round(F.col("s") - first, 2).alias("change"))


@query("top05_two_keys", "SELECT entity_id FROM entities ORDER BY mention_count DESC, last_seen DESC, entity_id LIMIT 30")
def top05(spark, d):
    return table(spark, d, "entities").orderBy(F.desc("mention_count"), F.desc("last_seen"), "entity_id").limit(30).select("entity_id")


@query("top08_sampled_chunks", "WITH c AS (SELECT rid, list(vec_id ORDER BY vec_id) AS v FROM chunk_embeddings WHERE rid IS NOT NULL GROUP BY rid) SELECT rid, array_to_string(CASE WHEN len(v) <= 5 THEN v ELSE list_transform(list_sort(list_distinct(list_transform(range(5), lambda i: CAST(floor(i * (len(v) - 1) / 4.0 + 0.5) AS BIGINT)))), lambda i: v[i + 1]) END, ',') AS x, len(v) AS n FROM c")
def top08(spark, d):
    """First, last and evenly spaced chunks of each text."""
    c = table(spark, d, "chunk_embeddings").where("rid is not null").groupBy("rid").agg(F.array_sort(F.collect_list("vec_id")).alias("v"))
    return c.select("rid", F.array_join(retrieval.sample_chunks(F.col("v")), ",").alias("x"), F.size("v").cast("long").alias("n"))


@query("set04_union_of_sets", "SELECT rid, array_to_string(list_sort(list_distinct(list(day))), ',') AS days FROM (SELECT rid, strftime(created_at, '%Y-%m-%d') AS day FROM bundles UNION ALL SELECT rid, strftime(updated_at, '%Y-%m-%d') FROM bundles) GROUP BY rid")
def set04(spark, d):
    b = table(spark, d, "bundles").groupBy("rid").agg(F.collect_set(F.date_format("created_at", "yyyy-MM-dd")).alias("a"), F.collect_set(F.date_format("updated_at", "yyyy-MM-dd")).alias("b"))
    return b.select("rid", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("days"))


@query("set05_both_directions", f"WITH {NATION_EDGES} SELECT node, count(*) AS edges FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node")
def set05(spark, d):
    e = nation_edges(spark, d)
    return e.select(F.col("src").alias("node")).unionAll(e.select("dst")).groupBy("node").agg(F.count(F.lit(1)).alias("edges"))


@query("str08_without_time_marks", rf"WITH {{CUR}} SELECT rid, md5(array_to_string(list_filter(list_transform(string_split(coalesce(json_extract_string({_J}, '$.transcript_text'), ''), chr(10)), lambda l: trim(regexp_replace(l, '^\s*\[[\d:.]+s?(?:\s*->\s*[\d:.]+s?)?\]\s*', ''))), lambda l: l <> ''), chr(10))) AS digest FROM cur WHERE namespace LIKE '%-recording'")
def str08(spark, d):
    """Transcripts without the time marks that lead their lines."""
    return kind_rows(spark, d, "-recording", "contents").select("rid", F.md5(T.strip_time_marks(B.field("transcript_text"))).alias("digest"))


@query("str09_front_matter", r"WITH x AS (SELECT doc_id, text, starts_with(trim(text), '---') AND len(string_split(text, '---')) >= 3 AS has FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN has THEN string_split(text, '---')[2] END AS head, md5(CASE WHEN has THEN regexp_replace(array_to_string(string_split(text, '---')[3:], '---'), '^\s+|\s+$', '', 'g') ELSE text END) AS body FROM x")
def str09(spark, d):
    parts = T.front_matter(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", parts["head"].alias("head"), F.md5(parts["body"]).alias("body"))


@query("str15_search_terms", r"SELECT id, array_to_string(list_filter(regexp_extract_all(lower(title), '\b([a-z][\w-]*)\b', 1), lambda w: length(w) > 1 AND w NOT IN ('what','how','why','when','where','who','is','are','was','were','do','does','did','the','a','an','in','on','at','to','for','of','with','by','from','about','i','my','me','know','tell','show','find','get','related','all')), ' ') AS terms FROM threads WHERE title IS NOT NULL")
def str15(spark, d):
    return table(spark, d, "threads").where("title is not null").select("id", F.array_join(T.terms(F.col("title")), " ").alias("terms"))


@query("str19_fuzzy_names")
def str19(spark, d):
    """Indel ratio of each name and its normalised form; SQL has no such measure, tests compare known values."""
    return table(spark, d, "entities").select("entity_id", F.round(T.fuzzy_ratio(F.col("name"), F.col("name_normalized")), 6).alias("ratio"))


@query("str22_repaired_json", r"SELECT rid, updated_at, md5(regexp_replace(contents, ',\s*([}\]])', '\1', 'g')) AS digest FROM bundles WHERE json_valid(contents) AND rid IS NOT NULL")
def str22(spark, d):
    """A fence and a trailing comma put around valid contents are taken away again."""
    b = table(spark, d, "bundles").where(F.get_json_object("contents", "$").isNotNull() & F.col("rid").isNotNull())
    dirty = F.concat(F.lit("```json\n"), F.regexp_replace("contents", r"\}$", ",}"), F.lit("\n```"))
    return b.select("rid", F.col("updated_at"), F.md5(T.repair_json(dirty)).alias("digest"))


@query("str23_wildcards", "SELECT source, count(*) AS n FROM documents WHERE regexp_matches(lower(source), '^.*\\.harbor-.$') GROUP BY source")
def str23(spark, d):
    return table(spark, d, "documents").where(F.lower("source").rlike(T.glob_pattern("*.harbor-?"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("url04_hashes", f"""WITH {{CUR}}, u AS (SELECT rid, json_extract_string({_J}, '$.url') AS u FROM cur WHERE namespace LIKE '%-browser-history' AND json_valid(contents)),
    s AS (SELECT rid, regexp_extract(u, '^[^?#]*') || '?' || array_to_string(list_filter(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&'), lambda p: NOT starts_with(p, 'ref=')), '&') AS c FROM u) SELECT rid, substr(sha256(c), 1, 12) AS h FROM s""")
def url04(spark, d):
    c = kind_rows(spark, d, "-browser-history", "contents").where(F.get_json_object("contents", "$").isNotNull())
    return c.select("rid", U.url_hash(F.get_json_object("contents", "$.url")).alias("h"))


@query("url02_stripped_parameters", f"""WITH {{CUR}}, u AS (SELECT rid, json_extract_string({_J}, '$.url') AS u FROM cur WHERE namespace LIKE '%-browser-history' AND json_valid(contents)),
    s AS (SELECT rid, list_filter(list_transform(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&'), lambda p: regexp_extract(p, '^[^=]*')), lambda p: regexp_matches(lower(p), '^(ref|si|utm_[a-z]+|fbclid|gclid)$')) AS gone FROM u) SELECT rid, array_to_string(gone, ',') AS gone, CASE WHEN len(gone) > 0 THEN 'default' ELSE 'default' END AS policy FROM s""")
def url02(spark, d):
    c = kind_rows(spark, d, "-browser-history", "contents").where(F.get_json_object("contents", "$").isNotNull())
    u = F.get_json_object("contents", "$.url")
    return c.select("rid", F.array_join(U.stripped(u), ",").alias("gone"), U.with_policy(u, {})["policy"].alias("policy"))


@query("hsh02_record_hash")
def hsh02(spark, d):
    """A hash over chosen fields in a fixed order, for change detection; engine-internal, so without SQL."""
    return current(spark, d, "namespace", "search_text").select("rid", ingest.record_hash("namespace", "search_text").alias("hash"))


@query("dat01_epoch_times", "SELECT event_id, strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def dat01(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("dat02_lenient_times", f"WITH {{CUR}} SELECT rid, CAST(coalesce(try_cast(json_extract_string({_J}, '$.date_recorded') AS DATE), DATE '2000-01-01') AS VARCHAR) AS day FROM cur WHERE namespace LIKE '%-recording'")
def dat02(spark, d):
    """Days that don't parse take a fallback, here a fixed one in place of the present day."""
    day = F.coalesce(F.get_json_object("contents", "$.date_recorded").try_cast("date"), F.lit("2000-01-01").cast("date"))
    return kind_rows(spark, d, "-recording", "contents").select("rid", day.cast("string").alias("day"))


@query("vec03_literals", "SELECT vec_id, md5('[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',') || ']') AS digest FROM embeddings")
def vec03(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.md5(V.literal(F.col("embedding"))).alias("digest"))


@query("vec04_cut_before_embedding", "WITH {CUR} SELECT rid, md5(substr(search_text, 1, 2000)) AS digest FROM cur")
def vec04(spark, d):
    return current(spark, d, "search_text").select("rid", F.md5(F.substring("search_text", 1, 2000)).alias("digest"))


@query("mth03_discounted_gain", "SELECT rid, round(sum(mention_count / log2(pos + 1)), 6) AS dcg FROM (SELECT rid, mention_count, row_number() OVER (PARTITION BY rid ORDER BY confidence DESC, entity_id) AS pos FROM bundle_entities) GROUP BY rid")
def mth03(spark, d):
    r = table(spark, d, "bundle_entities").select("rid", "mention_count", F.row_number().over(W.partitionBy("rid").orderBy(F.desc("confidence"), "entity_id")).alias("pos"))
    return r.groupBy("rid").agg(F.round(F.sum(F.col("mention_count") / F.log2(F.col("pos") + 1)), 6).alias("dcg"))


@query("arr02_flattened_texts", f"WITH {{CUR}}, m AS (SELECT rid, json_extract({_J}, '$.chat_messages') AS m FROM cur WHERE namespace LIKE '%-web.conversation' AND json_valid(contents)) SELECT rid, md5(array_to_string(list_filter(list_transform(range(coalesce(json_array_length(m), 0)::BIGINT), lambda i: json_extract_string(m, '$[' || i || '].text')), lambda t: coalesce(t, '') <> ''), '|')) AS digest FROM m")
def arr02(spark, d):
    c = kind_rows(spark, d, "-web.conversation", "contents").where(F.get_json_object("contents", "$").isNotNull())
    return c.select("rid", F.md5(F.array_join(B.texts_of("chat_messages", "text"), "|")).alias("digest"))


@query("map02_supertypes", "SELECT entity_id, CASE entity_type WHEN 'Person' THEN 'agent' WHEN 'Speaker' THEN 'agent' WHEN 'Organization' THEN 'agent' WHEN 'Tool' THEN 'artifact' WHEN 'Project' THEN 'artifact' WHEN 'Concept' THEN 'concept' WHEN 'Topic' THEN 'concept' END AS supertype FROM entities")
def map02(spark, d):
    return table(spark, d, "entities").select("entity_id", ontology.supertype(F.col("entity_type")).alias("supertype"))


@query("jsn02_event_json", "WITH {CUR} SELECT rid, json_extract_string(json_object('rid', rid, 'namespace', namespace), '$.namespace') AS ns FROM cur")
def jsn02(spark, d):
    return current(spark, d, "namespace").select("rid", F.get_json_object(F.to_json(F.struct("rid", "namespace")), "$.namespace").alias("ns"))


@query("ret05_routed_queries", f"WITH r AS ({ORACLE['str17_routes']}) SELECT id, CASE route WHEN 'conceptual' THEN 0.5 WHEN 'hybrid' THEN 0.85 ELSE 1.0 END AS alpha FROM r")
def ret05(spark, d):
    """The weight of the full-text score by each query's route."""
    weights = F.create_map(*[F.lit(x) for kv in retrieval.ALPHA.items() for x in kv])
    return table(spark, d, "threads").select("id", weights[T.route(F.col("title"))].alias("alpha"))


@query("ret09_chunked_rerank")
def ret09(spark, d):
    hits = ret03(spark, d).join(current(spark, d, "search_text").select("rid", "search_text"), "rid")
    return retrieval.rerank_chunked(hits, retrieval.RERANKERS.create("overlap", QUERY), T.chunks(F.col("search_text")), 10)


@query("ent01_extraction_pipeline", r"WITH {CUR} SELECT rid, count(DISTINCT regexp_replace(u, '[.,;:)]+$', '')) AS urls FROM (SELECT rid, unnest(regexp_extract_all(search_text, '(https?://[^\s<>\x22\x27)\]]+)', 1)) AS u FROM cur) GROUP BY rid")
def ent01(spark, d):
    """Extraction and merging over all texts, shown for addresses (which have no letter case here)."""
    c = current(spark, d, "search_text")
    return entities.merge(entities.extract(c)).where("entity_type = 'URL'").groupBy("rid").agg(F.count(F.lit(1)).alias("urls"))


_TYPES = ", ".join(f"('{k}', '{t}')" for kinds, types in ontology.DOMAINS.values() for k in kinds for t in types)


@query(
    "ent02_types_of_namespaces",
    f"""WITH {{CUR}}, o AS (SELECT * FROM (VALUES {_TYPES}) AS v(kind, entity_type)), l AS (SELECT c.namespace, regexp_replace(c.namespace, '^[^-]*-', '') AS kind, e.entity_type FROM bundle_entities b JOIN entities e USING (entity_id) JOIN cur c USING (rid))
    SELECT namespace, count(*) AS allowed FROM l WHERE EXISTS (SELECT 1 FROM o WHERE o.entity_type = l.entity_type AND (o.kind = l.kind OR l.kind NOT IN (SELECT kind FROM o))) GROUP BY 1""",
)
def ent02(spark, d):
    """Links whose entity has a type that belongs to the text's kind."""
    links = table(spark, d, "bundle_entities").join(table(spark, d, "entities").select("entity_id", "entity_type"), "entity_id").join(current(spark, d, "namespace").select("rid", "namespace"), "rid")
    return links.where(ontology.allowed(B.kind(), F.col("entity_type"))).groupBy("namespace").agg(F.count(F.lit(1)).alias("allowed"))


@query(
    "ent09_neighbourhood",
    f"""WITH {{CUR}}, {_SIM}, a AS (SELECT 'similar' AS section, CAST(entity_id AS VARCHAR) AS key, similarity AS score FROM seed ORDER BY similarity DESC, mention_count DESC, entity_id LIMIT 10),
    b AS (SELECT 'bundle', l.rid, confidence FROM bundle_entities l JOIN seed USING (entity_id) JOIN cur USING (rid) ORDER BY similarity DESC, confidence DESC, l.rid, l.entity_id LIMIT 10),
    r AS (SELECT DISTINCT rid FROM bundle_entities WHERE entity_id IN (SELECT entity_id FROM seed)), o AS (SELECT entity_id, count(DISTINCT rid) AS shared FROM bundle_entities WHERE rid IN (SELECT rid FROM r) AND entity_id NOT IN (SELECT entity_id FROM seed) GROUP BY entity_id),
    c AS (SELECT 'shared', CAST(entity_id AS VARCHAR), CAST(shared AS DOUBLE) FROM o JOIN entities USING (entity_id) ORDER BY shared DESC, mention_count DESC, entity_id LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
)
def ent09(spark, d):
    """Similar entities, their texts and the entities that share texts, as sections of one table."""
    e, l = table(spark, d, "entities"), table(spark, d, "bundle_entities")
    a = entities.search_entities(e, NAME, most=10).select(F.lit("similar").alias("section"), F.col("entity_id").cast("string").alias("key"), F.col("similarity").alias("score"))
    b = entities.bundles_of_entity(e, l, current(spark, d, "namespace"), NAME, most=10).select(F.lit("bundle").alias("section"), F.col("rid").alias("key"), F.col("confidence").alias("score"))
    c = entities.cooccurring(e, l, NAME, most=10).select(F.lit("shared").alias("section"), F.col("entity_id").cast("string").alias("key"), F.col("shared").cast("double").alias("score"))
    return a.unionByName(b).unionByName(c)


@query("grf01_seed_entities", "SELECT entity_id AS node FROM entities WHERE lower(name) IN ('graph', 'memory') UNION SELECT entity_id FROM (SELECT entity_id, t, row_number() OVER (PARTITION BY t ORDER BY entity_id) AS n FROM entities, (SELECT unnest(['graph', 'memory']) AS t) WHERE contains(lower(name), t) AND t NOT IN (SELECT lower(name) FROM entities)) WHERE n <= 10")
def grf01(spark, d):
    """At most ten nodes for a term without an exact one; that is the feature."""
    return graph.find_seeds(table(spark, d, "entities").select(F.col("entity_id").alias("node"), "name"), ["graph", "memory"])


@query("grf02_sources_of_entity", "WITH e AS (SELECT entity_id FROM bundle_entities GROUP BY entity_id ORDER BY count(*) DESC, entity_id LIMIT 1) SELECT DISTINCT rid FROM bundle_entities JOIN e USING (entity_id)")
def grf02(spark, d):
    l = table(spark, d, "bundle_entities")
    top = l.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity_id").limit(1).select("entity_id")
    return l.join(F.broadcast(top), "entity_id", "left_semi").select("rid").distinct()


@query("orc10_missing_judged", "SELECT count(*) AS missing FROM (SELECT DISTINCT rid FROM bundle_entities) WHERE rid NOT IN (SELECT rid FROM bundles)")
def orc10(spark, d):
    return ingest.orphans(table(spark, d, "bundle_entities").select("rid").distinct(), table(spark, d, "bundles").select("rid").distinct()).agg(F.count(F.lit(1)).alias("missing"))


@query("orc04_stored_text_fallback", "WITH {CUR} SELECT rid, length(coalesce(nullif(trim(search_text), ''), contents)) AS n FROM cur WHERE length(coalesce(nullif(trim(search_text), ''), contents)) >= 50")
def orc04(spark, d):
    text = F.coalesce(F.nullif(F.trim("search_text"), F.lit("")), F.col("contents"))
    return current(spark, d, "search_text", "contents").select("rid", F.length(text).alias("n")).where("n >= 50")
