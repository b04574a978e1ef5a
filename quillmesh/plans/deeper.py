"""Breakdowns of measures, event groups, configurations, paragraphs and triples over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions import vectors as V
from quillmesh.operators import entities, evaluation, ingest
from quillmesh.plans.measures import _RUN, _qrels, _run
from quillmesh.plans.registry import ORACLE, query
from quillmesh.plans.relational import current
from quillmesh.plans.retrieval import _VEC
from quillmesh.plans.textual import _USABLE, usable_chunks
from quillmesh.runtime import table
from quillmesh.sources import sinks
from quillmesh.streaming import events as S


@query("agg05_best_chunk", f"WITH {_VEC.format(n=1, m=1)} SELECT rid, round(max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[]))), 6) AS similarity FROM v, q0 GROUP BY rid")
def agg05_best(spark, d):
    """Per text the similarity of its best chunk to the first vector of the default configuration."""
    v = usable_chunks(table(spark, d, "chunk_embeddings"), table(spark, d, "embedding_configs").where("is_default"))
    q = v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("qv"))
    return v.crossJoin(F.broadcast(q)).groupBy("rid").agg(F.round(F.max(V.cosine(F.col("embedding"), F.col("qv"))), 6).alias("similarity"))  # one row


@query("agg08_distinct_entities", f"SELECT entity_type, count(*) AS n, count(DISTINCT doc_id) AS texts FROM (SELECT DISTINCT doc_id, entity_type, name FROM ({ORACLE['str16_pattern_entities']})) GROUP BY entity_type")
def agg08_distinct(spark, d):
    found = entities.distinct_entities(entities.extract(table(spark, d, "documents").where("text is not null"), "doc_id", "text"), "doc_id")
    per = found.groupBy("entity_type", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("entity_type").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))


_CATEGORY = "CASE WHEN query_id LIKE '%-message' OR query_id LIKE '%-recording' OR query_id LIKE '%-transcript' THEN 'talk' ELSE 'text' END"


@query("agg14_metrics_by_category", f"WITH {_RUN} SELECT {_CATEGORY} AS category, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(ap), 4) AS ap, count(*) AS queries FROM m GROUP BY 1")
def agg14_by_category(spark, d):
    m = evaluation.retrieval_metrics(_run(spark, d), _qrels(spark, d)).withColumn("category", F.expr(_CATEGORY))
    means = evaluation.mean_metrics(m, "category")
    return means.select("category", *[F.round(c, 4).alias(c) for c in ("recall", "mrr", "ndcg", "ap")], "queries")


@query("agg16_extraction_by_namespace", f"WITH {{CUR}}, x AS ({ORACLE['evl07_extraction_scores']}) SELECT namespace, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1, count(*) AS texts FROM x JOIN cur USING (rid) GROUP BY namespace")
def agg16_by_namespace(spark, d):
    e = table(spark, d, "entities").select("entity_id", "name_normalized", "entity_type")
    links = table(spark, d, "bundle_entities").join(e, "entity_id").select("rid", "name_normalized", "entity_type", "confidence")
    scores = evaluation.extraction_scores(links.where("confidence > 0.4").drop("confidence").distinct(), links.where("confidence > 0.6").drop("confidence").distinct())
    m = evaluation.mean_extraction(scores.join(current(spark, d, "namespace").select("rid", "namespace"), "rid"), "namespace")
    return m.select("namespace", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "texts")


@query("join09_scores_of_identities", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > (SELECT min(o_orderdate) FROM orders)")
def join09(spark, d):
    """Scores behind a high-water mark with the identities they belong to."""
    o = table(spark, d, "orders")
    low = o.agg(F.min("o_orderdate").alias("low"))
    fresh = o.crossJoin(F.broadcast(low)).where("o_orderdate > low")  # one row
    return fresh.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("o_orderkey", "c_name", "o_totalprice")


@query("join14_fuzzy_matches")
def join14(spark, d):
    """Names as written against normalised names of the same text and type, one to one; SQL has no such ratio, tests
    compare with a plain program."""
    e = table(spark, d, "entities").select("entity_id", "name", "name_normalized", "entity_type")
    links = table(spark, d, "bundle_entities").select("rid", "entity_id").join(e, "entity_id")
    return evaluation.matched_entities(links.select("rid", "entity_type", "name"), links.select("rid", "entity_type", F.col("name_normalized").alias("name")))


@query("flt05_extraction_gate", "WITH {CUR} SELECT namespace, count(*) AS passed FROM cur WHERE length(trim(search_text)) >= CASE WHEN namespace LIKE '%-message' THEN 30 ELSE 1 END GROUP BY namespace")
def flt05_extract(spark, d):
    from quillmesh.streaming import consumers

    return consumers.long_enough(current(spark, d, "namespace", "search_text"), consumers.LEAST_TO_EXTRACT).groupBy("namespace").agg(F.count(F.lit(1)).alias("passed"))


@query(
    "str03_paragraph_chunks",
    r"""WITH p AS (SELECT doc_id, text, chr(10) || chr(10) AS sep FROM documents WHERE text IS NOT NULL),
    f AS (SELECT doc_id, CASE WHEN length(text) <= 2000 THEN [text] ELSE list_transform(string_split(list_reduce(string_split(text, sep), lambda acc, x:
      CASE WHEN length(split_part(acc, chr(1), -1)) > 0 AND length(split_part(acc, chr(1), -1)) + length(x) + 2 > 2000 THEN acc || chr(1) || right(split_part(acc, chr(1), -1), 400) || sep || x
        WHEN split_part(acc, chr(1), -1) = '' THEN acc || x ELSE acc || sep || x END), chr(1)), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')) END AS c FROM p)
    SELECT doc_id, len(c) AS n, md5(array_to_string(c, '|')) AS digest FROM f""",
)
def str03(spark, d):
    c = table(spark, d, "documents").where("text is not null").select("doc_id", T.paragraph_chunks(F.col("text")).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("digest"))


_PENDING = "e AS (SELECT event_id AS id, epoch(ts) AS moment, event_type FROM events), p AS (SELECT event_id AS id, 1 + event_id % 4 AS tries, epoch(ts) AS given, event_id % 3 = 0 AS acked FROM events WHERE event_id % 2 = 0), k AS (SELECT max(moment) AS now FROM e)"


def _group(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_type")
    pending = e.where("id % 2 = 0").select("id", (1 + F.col("id") % 4).alias("tries"), F.col("at").alias("given"), (F.col("id") % 3 == 0).alias("acked"))
    return e, pending, float(e.agg(F.max("at")).first()[0])


@query(
    "stm03_next_events",
    f"""WITH {_PENDING} SELECT id, tries FROM (SELECT e.id, p.tries + 1 AS tries, 0 AS turn, e.moment FROM p JOIN e USING (id), k WHERE NOT acked AND now - given >= 5 AND p.tries < 3
    UNION ALL SELECT id, 1, 1, moment FROM e WHERE id NOT IN (SELECT id FROM p)) ORDER BY turn, moment, id LIMIT 10""",
)
def stm03(spark, d):
    """What a consumer of a group gets next: what was given out and not acknowledged before what is new."""
    return S.pull(*_group(spark, d)).select("id", "tries")


@query("stm04_dead_letters", f"WITH {_PENDING} SELECT id, tries FROM p, k WHERE NOT acked AND tries >= 3 AND now - given >= 5")
def stm04_dead(spark, d):
    _, pending, now = _group(spark, d)
    return S.dead_letters(pending, now)


@query("stm10_group_lag", f"WITH {_PENDING} SELECT event_type, count(*) AS length, count(*) FILTER (WHERE NOT acked) AS pending, count(*) FILTER (WHERE acked IS NULL) AS undelivered FROM e LEFT JOIN p USING (id) GROUP BY event_type")
def stm10(spark, d):
    e, pending, _ = _group(spark, d)
    return S.group_lag(e, pending, "event_type")


@query("orc11_judged_candidates", f"WITH {_RUN} SELECT r.query_id, r.rid, q.grade FROM run r JOIN qrels q ON q.query_id = r.query_id AND q.rid = r.rid")
def orc11(spark, d):
    """Fresh candidates that have been judged before."""
    return _run(spark, d).join(_qrels(spark, d), ["query_id", "rid"]).select("query_id", "rid", "grade")


@query("orc12_remaining_work", "WITH {CUR} SELECT namespace, count(*) AS total, count(*) FILTER (WHERE rid NOT IN (SELECT rid FROM chunk_embeddings WHERE rid IS NOT NULL)) AS remaining FROM cur GROUP BY namespace")
def orc12(spark, d):
    """A run that is taken up again: what is left per namespace beside the processed set."""
    c = current(spark, d, "namespace").select("rid", "namespace")
    left = ingest.without(c, table(spark, d, "chunk_embeddings").where("rid is not null"), "rid").groupBy("namespace").agg(F.count(F.lit(1)).alias("remaining"))
    return c.groupBy("namespace").agg(F.count(F.lit(1)).alias("total")).join(left, "namespace", "left").na.fill(0, ["remaining"])


@query("snk04_registered_config", "WITH c AS (SELECT config_id, dimensions FROM embedding_configs), x AS (SELECT min(config_id) AS config_id FROM c) SELECT c.config_id, CASE WHEN c.config_id = x.config_id THEN 96 ELSE dimensions END AS dimensions, CASE WHEN c.config_id = x.config_id THEN 0 ELSE (SELECT count(*) FROM chunk_embeddings e WHERE e.config_id = c.config_id) END AS chunks FROM c, x")
def snk04(spark, d):
    """A known configuration registered with other dimensions: its chunks go."""
    configs, chunks = table(spark, d, "embedding_configs"), table(spark, d, "chunk_embeddings")
    first = configs.orderBy("config_id").first().asDict() | {"dimensions": 96}
    new, left = sinks.register_config(configs, chunks, first)
    n = left.groupBy("config_id").agg(F.count(F.lit(1)).alias("chunks"))
    return new.select("config_id", "dimensions").join(n, "config_id", "left").na.fill(0, ["chunks"])


@query("ent10_clean_triples", "SELECT DISTINCT l.rid, lower(trim(e.name)) AS subject, 'is a' AS predicate, lower(trim(e.entity_type)) AS object FROM bundle_entities l JOIN entities e USING (entity_id) WHERE trim(e.name) <> '' AND trim(e.entity_type) <> ''")
def ent10(spark, d):
    """Triples of every text, written in several cases and with a blank, once each; those of two parts are left out."""
    e = table(spark, d, "entities").select("entity_id", "name", "entity_type")
    rows = table(spark, d, "bundle_entities").select("rid", "entity_id").join(e, "entity_id")
    forms = F.array(F.array("name", F.lit("is a"), "entity_type"), F.array(F.upper("name"), F.lit(" Is A "), "entity_type"), F.array("name", "entity_type"))
    return entities.clean_triples(rows.select("rid", F.explode(forms).alias("parts")))


ORACLE["vec_similarity_by_config"] = f"""WITH v AS (SELECT vec_id, c.config_id, CAST(embedding AS DOUBLE[]) AS e FROM chunk_embeddings c JOIN embedding_configs g USING (config_id) WHERE {_USABLE}),
    u AS (SELECT vec_id, config_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v), x AS (SELECT config_id, unnest(u) AS col, unnest(range(len(u))) AS pos FROM u),
    m AS (SELECT config_id, pos, avg(col) AS m FROM x GROUP BY 1, 2), c AS (SELECT config_id, list(m ORDER BY pos) AS c FROM m GROUP BY 1) SELECT config_id, round(avg(list_cosine_similarity(u, c)), 6) AS mean_cosine, count(*) AS vectors FROM u JOIN c USING (config_id) GROUP BY 1"""
