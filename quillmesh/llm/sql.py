"""SQL of the queries of this package that SQL can express, run by the correctness check on the same tables."""

CURRENT = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY updated_at DESC) AS _n FROM bundles) WHERE _n = 1)"

ORACLE: dict[str, str] = {
    "p1_found": """
WITH v AS (
  SELECT vec_id, c.config_id, CAST(embedding AS DOUBLE[]) AS e
  FROM chunk_embeddings c JOIN embedding_configs g ON c.config_id = g.config_id AND len(c.embedding) = g.dimensions
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b
FROM v a JOIN v b ON a.config_id = b.config_id AND a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.e, b.e) >= 0.9""",
    "p2_found": f"""
WITH {CURRENT}
SELECT rid, config_id FROM cur, embedding_configs
WHERE length(trim(search_text, E' \\t\\n\\r')) > chunk_size""",
    "p8_bounds": """
WITH t AS (SELECT source, max(coalesce(target_share, 0)) AS share, max(coalesce(max_repeats, 0)) AS cap FROM mix_targets WHERE source IS NOT NULL GROUP BY source)
SELECT source, share > 0 AND cap > 0 AND source IN (SELECT source FROM documents WHERE length(text) > 0 AND source IS NOT NULL) AS drawn, true AS within_cap FROM t""",
    "p4_found": f"""
WITH {CURRENT},
m AS (
  SELECT reference, regexp_extract(reference, '^([^:]+):(.+):([0-9]+)$', 2) AS thread_id,
    CAST(regexp_extract(reference, '^([^:]+):(.+):([0-9]+)$', 3) AS HUGEINT) AS num,
    json_valid(contents) AS ok, CASE WHEN json_valid(contents) THEN contents END AS j
  FROM cur WHERE namespace LIKE '%-message' AND regexp_full_match(reference, '[^:]+:.+:[0-9]+')),
f AS (
  SELECT reference, thread_id, num, coalesce(ok, false) AS ok, json_extract_string(j, '$.content') AS content,
    json_extract_string(j, '$.content_type') AS ctype, json_extract_string(j, '$.sender_id') AS sender,
    nullif(trim(json_extract_string(j, '$.reply_to')), '') AS reply_to, trim(json_extract_string(j, '$.platform_ts')) AS t FROM m),
g AS (
  SELECT *, regexp_full_match(coalesce(content, ''), '\\s*') AS blank,
    CASE WHEN regexp_full_match(t, '[+-]?[0-9]{{1,17}}')
      THEN CASE WHEN abs(CAST(t AS BIGINT)) >= 100000000000 THEN CAST(floor(CAST(t AS BIGINT) / 1000.0) AS BIGINT) ELSE CAST(t AS BIGINT) END
      ELSE CAST(floor(epoch(try_cast(CASE WHEN regexp_matches(t, '([Zz]|[+-][0-9]{{2}}:?[0-9]{{2}})$') AND regexp_matches(t, ':') THEN t ELSE t || 'Z' END AS TIMESTAMPTZ))) AS BIGINT) END AS ts,
    CASE WHEN ctype = 'service' THEN 'system' WHEN sender IN (SELECT sender_id FROM self_senders) THEN 'self' ELSE 'other' END AS role
  FROM f),
bad AS (
  SELECT thread_id FROM g WHERE NOT ok OR (NOT blank AND ts IS NULL)
  UNION SELECT a.thread_id FROM g a WHERE reply_to IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g b WHERE b.thread_id = a.thread_id AND b.reference = a.reply_to)),
kept AS (
  SELECT thread_id FROM g WHERE NOT blank GROUP BY thread_id
  HAVING bool_or(role = 'self') AND bool_or(role = 'other'))
SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY ts, num, reference) AS turn_no, reference, role
FROM g WHERE NOT blank AND thread_id IN (SELECT thread_id FROM kept) AND thread_id NOT IN (SELECT thread_id FROM bad)""",
}
