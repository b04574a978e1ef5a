"""Text, address, hash and vector functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import bundles as B
from quillmesh.functions import text as T
from quillmesh.functions import urls as U
from quillmesh.functions import vectors as V
from quillmesh.operators import entities
from quillmesh.operators.retrieval import usable_chunks
from quillmesh.plans.registry import query
from quillmesh.plans.relational import current
from quillmesh.runtime import latest, table

_J = "CASE WHEN json_valid(contents) THEN contents END"


def _f(path: str) -> str:
    return f"coalesce(json_extract_string(j, '$.{path}'), '')"


def _l(path: str) -> str:
    return f"coalesce(array_to_string(CAST(json_extract(j, '$.{path}') AS VARCHAR[]), ' '), '')"


_CHAT = "nullif(array_to_string(list_filter(list_transform(range(coalesce(json_array_length(json_extract(j, '$.chat_messages')), 0)::BIGINT), lambda i: json_extract_string(j, '$.chat_messages[' || i || '].text')), lambda t: coalesce(t, '') <> ''), chr(10)), '')"


@query(
    "prj01_search_text",
    f"""WITH {{CUR}}, k AS (SELECT rid, contents, regexp_replace(namespace, '^[^-]*-', '') AS kind, {_J} AS j FROM cur)
    SELECT rid, md5(CASE kind WHEN 'journal' THEN {_f('frontmatter.title')} || ' ' || {_f('body')}
      WHEN 'research' THEN {_f('frontmatter.title')} || ' ' || {_l('frontmatter.tags')} || ' ' || {_f('frontmatter.prompted_by')} || ' ' || {_f('body')}
      WHEN 'plan' THEN {_f('title')} || ' ' || {_f('goal')} || ' ' || {_f('body')}
      WHEN 'task' THEN {_f('frontmatter.title')} || ' ' || {_f('frontmatter.status')} || ' ' || {_f('frontmatter.milestone')} || ' ' || {_f('body')}
      WHEN 'recording' THEN {_f('filename')} || ' ' || {_f('source')} || ' ' || {_f('title')} || ' ' || {_f('notes')} || ' ' || {_f('date_recorded')} || ' ' || {_f('transcript_text')}
      WHEN 'code' THEN concat_ws(chr(10), nullif({_f('cwd')}, ''), nullif({_f('summary')}, ''))
      WHEN 'message' THEN {_f('content')}
      WHEN 'youtube' THEN concat_ws(chr(10), nullif({_f('title')}, ''), nullif({_f('channel_handle')}, ''), nullif({_l('tags')}, ''), nullif(substr({_f('description')}, 1, 1000), ''))
      WHEN 'web.conversation' THEN concat_ws(chr(10), nullif({_f('name')}, ''), nullif({_f('summary')}, ''), {_CHAT})
      WHEN 'browser-history' THEN {_f('title')} || ' ' || {_f('domain')} || ' ' || {_f('url')} || ' ' || {_l('tags')} || ' ' || {_f('folder_path')} || ' ' || {_f('type')}
      ELSE contents END) AS digest
    FROM k WHERE j IS NOT NULL""",
)
def prj01(spark, d):
    """The search text of every row whose contents parse."""
    c = current(spark, d, "namespace", "contents").where(F.get_json_object("contents", "$").isNotNull())
    return c.select("rid", F.md5(B.search_text()).alias("digest"))


def _line(lead: str, *parts: tuple[str, str]) -> str:
    texts = ", ".join(f"'{label}: ' || nullif({value}, '')" for label, value in parts)
    return f"CASE WHEN {lead} = '' THEN '' ELSE concat_ws('. ', {texts}) || '.' END"


_TITLE, _FRONT = _f("title"), _f("frontmatter.title")
_NAMED = f"coalesce(nullif({_TITLE}, ''), {_f('filename')})"


@query(
    "prj02_preamble",
    f"""WITH {{CUR}}, k AS (SELECT rid, namespace, regexp_replace(namespace, '^[^-]*-', '') AS kind, {_J} AS j FROM cur)
    SELECT rid, CASE kind
      WHEN 'journal' THEN {_line(_FRONT, ('Journal', _FRONT), ('Date', _f('frontmatter.created')))}
      WHEN 'recording' THEN {_line(_NAMED, ('Recording', _NAMED), ('Source', _f('source')), ('Date', _f('date_recorded')))}
      WHEN 'web.conversation' THEN {_line(_f('name'), ('Conversation', _f('name')))}
      WHEN 'code' THEN {_line(_f('cwd'), ('Code session', _f('cwd')), ('Date', _f('date')))}
      WHEN 'message' THEN {_line(_f('chat_title'), ('Message', _f('chat_title')))}
      WHEN 'research' THEN {_line(_FRONT, ('Research', _FRONT), ('Date', _f('frontmatter.created')), ('Status', _f('frontmatter.status')))}
      WHEN 'youtube' THEN {_line(_TITLE, ('YouTube', _TITLE), ('Channel', _f('channel_handle')), ('Date', _f('upload_date')))}
      WHEN 'plan' THEN CASE WHEN {_TITLE} = '' THEN '' ELSE 'Plan: ' || {_TITLE} || '. Type: ' || coalesce(nullif({_f('plan_type')}, ''), 'auto') || '.' END
      WHEN 'task' THEN {_line(_FRONT, ('Task', _FRONT), ('Status', _f('frontmatter.status')))}
      ELSE 'Document from ' || namespace || '.' END AS preamble
    FROM k""",
)
def prj02(spark, d):
    return current(spark, d, "namespace", "contents").select("rid", B.preamble().alias("preamble"))


@query("prj03_with_preamble", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN chunk_text ELSE 'Chunk.' || chr(10) || '---' || chr(10) || chunk_text END AS embedded FROM chunk_embeddings")
def prj03(spark, d):
    lead = F.when(F.col("vec_id") % 2 == 0, "").otherwise("Chunk.")
    return table(spark, d, "chunk_embeddings").select("vec_id", B.with_preamble(lead, F.col("chunk_text")).alias("embedded"))


@query(
    "prj04_summaries",
    f"""WITH {{CUR}}, k AS (SELECT rid, search_text, regexp_replace(namespace, '^[^-]*-', '') AS kind, {_J} AS j FROM cur),
    l AS (SELECT rid, CASE kind WHEN 'message' THEN '[' || {_f('sender_id')} || '] ' || substr({_f('platform_ts')}, 1, 10) || ': ' || substr({_f('content')}, 1, 150)
      WHEN 'journal' THEN coalesce(nullif({_f('frontmatter.title')}, ''), {_f('frontmatter.description')}) WHEN 'recording' THEN coalesce(nullif({_f('title')}, ''), {_f('filename')}) ELSE substr(coalesce(search_text, ''), 1, 200) END AS line FROM k)
    SELECT rid, CASE WHEN length(line) > 200 THEN substr(line, 1, 200) || '...' ELSE line END AS summary FROM l""",
)
def prj04_summaries(spark, d):
    return current(spark, d, "namespace", "contents", "search_text").select("rid", B.summary().alias("summary"))


@query("prj04_preview", "WITH {CUR} SELECT rid, CASE WHEN length(search_text) > 200 THEN substr(search_text, 1, 200) || '...' ELSE search_text END AS preview FROM cur")
def prj04(spark, d):
    return current(spark, d, "search_text").select("rid", T.preview(F.col("search_text")).alias("preview"))


@query("prj06_point_lookup", "WITH {CUR} SELECT rid, namespace, sha256_hash FROM cur WHERE rid = (SELECT min(rid) FROM bundles)")
def prj06(spark, d):
    first = table(spark, d, "bundles").agg(F.min("rid").alias("rid"))
    return current(spark, d, "namespace", "sha256_hash").join(F.broadcast(first), "rid").select("rid", "namespace", "sha256_hash")


@query("str04_normalised_names", r"SELECT entity_id, lower(trim(regexp_replace(nfc_normalize(name), '\s+', ' ', 'g'))) AS name FROM entities")
def str04(spark, d):
    return table(spark, d, "entities").select("entity_id", T.normalise_name(T.nfkc(F.col("name"))).alias("name"))


@query(
    "str06_slugs",
    r"""SELECT id, CASE WHEN coalesce(s, '') = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[\s_]+', '-', 'g'), '[^\p{L}\p{N}\-.]', '', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS s FROM threads)""",
)
def str06(spark, d):
    return table(spark, d, "threads").select("id", T.slug(F.col("title")).alias("slug"))


@query(
    "str07_dated_slugs",
    r"""SELECT id, CASE WHEN coalesce(s, '') = '' THEN id ELSE substr(created_at, 1, 10) || '-' || s END AS slug FROM (SELECT id, created_at, substr(regexp_replace(trim(regexp_replace(lower(title), '[^\p{L}\p{N}\s_-]', '', 'g')), '\s+', '-', 'g'), 1, 80) AS s FROM threads)""",
)
def str07(spark, d):
    return table(spark, d, "threads").select("id", T.dated_slug(F.substring("created_at", 1, 10), F.col("title"), F.col("id")).alias("slug"))


@query(
    "str10_plan_kinds",
    r"""WITH {CUR} SELECT reference, CASE WHEN regexp_full_match(reference, '.*-agent-a[0-9a-f]{8,}') THEN 'subagent' WHEN regexp_matches(reference, '^\d{4}-\d{2}-\d{2}') THEN 'dated' ELSE 'auto' END AS kind FROM cur WHERE namespace LIKE '%-plan' OR namespace LIKE '%-journal'""",
)
def str10(spark, d):
    c = current(spark, d, "namespace", "reference").where(F.col("namespace").endswith("-plan") | F.col("namespace").endswith("-journal"))
    return c.select("reference", T.plan_kind(F.col("reference"))["kind"].alias("kind"))


@query("str11_first_heading", r"SELECT doc_id, list_filter(list_transform(list_slice(string_split(text, chr(10)), 1, 50), lambda l: regexp_extract(trim(regexp_replace(l, '\r$', '')), '^# (.+)$', 1)), lambda h: h <> '')[1] AS heading FROM documents")
def str11(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_heading(F.col("text")).alias("heading"))


@query(
    "str13_changelog_sections",
    r"""WITH d AS (SELECT doc_id, text, list_filter(string_split(chr(10) || text, chr(10) || '## '), lambda s: regexp_matches(s, '^\d')) AS s FROM documents WHERE source LIKE 'changelog%' AND text IS NOT NULL)
    SELECT doc_id, array_to_string(list_transform(s, lambda x: regexp_extract(x, '^(\S+)', 1)), ',') AS versions, md5(array_to_string(list_transform(s, lambda x: trim(regexp_replace(x, '^\S+[^\n]*', ''))), '|')) AS bodies,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*[-*] Added '))) AS added FROM d""",
)
def str13(spark, d):
    c = table(spark, d, "documents").where(F.col("source").startswith("changelog") & F.col("text").isNotNull())
    of = lambda f: F.transform(T.changelog_sections(F.col("text")), lambda x: x[f])
    return c.select("doc_id", F.array_join(of("version"), ",").alias("versions"), F.md5(F.array_join(of("body"), "|")).alias("bodies"), F.size(T.bullets(F.col("text"), "Added")).cast("long").alias("added"))


@query(
    "str16_pattern_entities",
    r"""WITH t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, 'Date' AS entity_type, 'temporal' AS supertype, CAST(1.0 AS DOUBLE) AS confidence, unnest(list_distinct(regexp_extract_all(text, '\b(\d{4}[-/]\d{2}[-/]\d{2})\b', 1))) AS name FROM t
    UNION ALL SELECT doc_id, 'URL', 'place', 1.0, unnest(list_distinct(list_transform(regexp_extract_all(text, '(https?://[^\s<>"'')\]]+)', 1), lambda x: regexp_replace(x, '[.,;:)]+$', '')))) FROM t
    UNION ALL SELECT doc_id, 'Path', 'place', 0.9, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(text, '(?m)(?:^|[\s(])((?:/[\w._-]+){2,}(?:/[\w._-]*)?)(?:\s|[),;:]|$)', 1), lambda x: regexp_replace(x, '[.,;:!?]+$', '')), lambda x: length(x) > 3))) FROM t
    UNION ALL SELECT doc_id, 'RID', 'artifact', 1.0, unnest(list_distinct(regexp_extract_all(text, '\b(orn:[\w.-]+:[\w./_-]+)\b', 1))) FROM t
    UNION ALL SELECT doc_id, 'Version', 'artifact', 0.9, unnest(list_distinct(regexp_extract_all(text, '\bv?(\d+\.\d+\.\d+(?:[-+][\w.]+)?)\b', 1))) FROM t""",
)
def str16(spark, d):
    """Distinct entities by pattern of every document."""
    return entities.extract(table(spark, d, "documents").where("text is not null"), "doc_id", "text").select("doc_id", "entity_type", "supertype", F.col("confidence").cast("double").alias("confidence"), "name")


@query(
    "str17_routes",
    r"""WITH q AS (SELECT id, trim(coalesce(title, '')) AS t FROM threads), w AS (SELECT id, t, len(regexp_split_to_array(t, '\s+')) AS n FROM q)
    SELECT id, CASE WHEN t = '' THEN 'hybrid' WHEN regexp_matches(t, '"[^"]+"|''[^'']+''') OR n <= 2 THEN 'keyword' WHEN regexp_matches(t, '(?i)\b(yesterday|today|last\s+week|this\s+week|last\s+month|this\s+month|last\s+\d+\s+days?|recent|lately|since\s+\w+|202\d[-/]\d{2}([-/]\d{2})?)\b') THEN 'temporal'
      WHEN regexp_matches(t, '(?i)^\s*(how|what|why|when|where|who|which|explain|describe|tell\s+me)\b') OR n > 6 THEN 'conceptual' ELSE 'hybrid' END AS route FROM w""",
)
def str17(spark, d):
    return table(spark, d, "threads").select("id", T.route(F.col("title")).alias("route"))


@query(
    "str20_trigram_similarity",
    r"""WITH q AS (SELECT min(name_normalized) AS q FROM entities WHERE entity_type = 'Topic'),
    g AS (SELECT entity_id, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(name_normalized), '[^\p{L}\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM entities),
    h AS (SELECT list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(q), '[^\p{L}\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS h FROM q)
    SELECT entity_id, round(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))), 6) AS similarity FROM g, h""",
)
def str20(spark, d):
    e = table(spark, d, "entities")
    q = e.where("entity_type = 'Topic'").agg(F.min("name_normalized").alias("q"))
    rows = e.crossJoin(F.broadcast(q))  # one row
    return rows.select("entity_id", F.round(T.trigram_similarity(F.col("name_normalized"), F.col("q")), 6).alias("similarity"))


@query("url01_sanitised", """WITH {CUR}, u AS (SELECT rid, json_extract_string(contents, '$.url') AS u FROM cur WHERE namespace LIKE '%-browser-history' AND json_valid(contents)),
    s AS (SELECT rid, u, regexp_extract(u, '^[^?#]*') AS base, list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+') AND NOT regexp_matches(lower(p), '^(ref|si|utm_[a-z]+|fbclid|gclid)=')) AS q FROM u)
    SELECT rid, lower(regexp_extract(base, '^[a-zA-Z]+://[^/]*')) || regexp_replace(regexp_replace(base, '^[a-zA-Z]+://[^/]*', ''), '(.)/+$', '\\1') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM s""")
def url01(spark, d):
    c = latest(table(spark, d, "bundles").where(F.col("namespace").endswith("-browser-history")), "rid", "updated_at", "rid", "contents")
    u = F.get_json_object("contents", "$.url")
    return c.where(F.get_json_object("contents", "$").isNotNull()).select("rid", U.sanitise(u).alias("url"))


@query("url05_domains", "WITH {CUR} SELECT lower(regexp_extract(json_extract_string(contents, '$.url'), '^[a-zA-Z]+://([^/?#]*)', 1)) AS domain, count(*) AS n FROM cur WHERE namespace LIKE '%-browser-history' AND json_valid(contents) GROUP BY 1")
def url05(spark, d):
    c = latest(table(spark, d, "bundles").where(F.col("namespace").endswith("-browser-history")), "rid", "updated_at", "rid", "contents")
    c = c.where(F.get_json_object("contents", "$").isNotNull())
    return c.groupBy(U.domain(F.get_json_object("contents", "$.url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("hsh01_content_hash", "WITH {CUR} SELECT rid, sha256(search_text) AS hash FROM cur")
def hsh01(spark, d):
    return current(spark, d, "search_text").select("rid", F.sha2("search_text", 256).alias("hash"))


@query("dat04_durations", "WITH {CUR}, s AS (SELECT rid, CAST(json_extract_string(contents, '$.duration_seconds') AS BIGINT) AS s FROM cur WHERE namespace LIKE '%-recording' AND json_valid(contents)) SELECT rid, CASE WHEN s >= 3600 THEN printf('%dh%02dm%02ds', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%dm%02ds', s // 60, s % 60) END AS duration FROM s")
def dat04(spark, d):
    c = latest(table(spark, d, "bundles").where(F.col("namespace").endswith("-recording")), "rid", "updated_at", "rid", "contents")
    return c.where(F.get_json_object("contents", "$").isNotNull()).select("rid", T.duration(F.get_json_object("contents", "$.duration_seconds")).alias("duration"))


@query("dat03_day_slices", "SELECT id, substr(created_at, 1, 10) AS day, replace(substr(created_at, 12, 8), ':', '-') AS clock FROM threads")
def dat03(spark, d):
    return table(spark, d, "threads").select("id", F.substring("created_at", 1, 10).alias("day"), F.translate(F.substring("created_at", 12, 8), ":", "-").alias("clock"))


_USABLE = "c.embedding IS NOT NULL AND len(c.embedding) = g.dimensions AND len(list_filter(c.embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(c.embedding, lambda x: x <> 0)) > 0"


@query("vec01_norms", f"SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS norm FROM chunk_embeddings c JOIN embedding_configs g USING (config_id) WHERE {_USABLE}")
def vec01(spark, d):
    return usable_chunks(table(spark, d, "chunk_embeddings"), table(spark, d, "embedding_configs")).select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"))


@query("vec02_cosine", f"WITH v AS (SELECT c.* FROM chunk_embeddings c JOIN embedding_configs g USING (config_id) WHERE {_USABLE} AND g.is_default), q AS (SELECT embedding AS q FROM v ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 5) AS cosine FROM v, q")
def vec02(spark, d):
    cfg = table(spark, d, "embedding_configs").where("is_default")
    v = usable_chunks(table(spark, d, "chunk_embeddings"), cfg)
    q = v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return v.crossJoin(F.broadcast(q)).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 5).alias("cosine"))


@query("jsn01_fields", "WITH {CUR} SELECT rid, json_extract_string(contents, '$.platform') AS platform, json_extract_string(contents, '$.thread_id') AS thread_id FROM cur WHERE namespace LIKE '%-message' AND json_valid(contents)")
def jsn01(spark, d):
    c = latest(table(spark, d, "bundles").where(F.col("namespace").endswith("-message")), "rid", "updated_at", "rid", "contents")
    return c.where(F.get_json_object("contents", "$").isNotNull()).select("rid", F.get_json_object("contents", "$.platform").alias("platform"), F.get_json_object("contents", "$.thread_id").alias("thread_id"))


@query("arr01_tags", "WITH {CUR} SELECT unnest(CAST(json_extract(contents, '$.tags') AS VARCHAR[])) AS tag, count(*) AS n FROM cur WHERE json_valid(contents) AND namespace LIKE '%-youtube' GROUP BY 1")
def arr01(spark, d):
    c = latest(table(spark, d, "bundles").where(F.col("namespace").endswith("-youtube")), "rid", "updated_at", "rid", "contents")
    return c.select(F.explode(F.from_json(F.get_json_object("contents", "$.tags"), "array<string>")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("str01_chunks")
def str01(spark, d):
    """The greedy chunker over all texts; SQL has no counterpart, tests compare it on small texts."""
    c = current(spark, d, "search_text").where("search_text is not null")
    return c.select("rid", F.posexplode(T.chunks(F.col("search_text"))).alias("chunk_index", "chunk_text"))
