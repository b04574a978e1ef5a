"""Measures of retrieval and extraction on runs made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmesh.operators import evaluation
from quillmesh.plans.registry import query
from quillmesh.plans.relational import current
from quillmesh.runtime import table

_RUN = """{CUR}, run AS (SELECT namespace AS query_id, rid, pos FROM (SELECT namespace, rid, row_number() OVER (PARTITION BY namespace ORDER BY coalesce(length(search_text), 0) DESC, rid) AS pos FROM cur) WHERE pos <= 50),
    qrels AS (SELECT c.namespace AS query_id, l.rid, max(CASE WHEN l.mention_count > 3 THEN 2 ELSE 1 END) AS grade FROM bundle_entities l JOIN cur c USING (rid) WHERE l.confidence > 0.8 GROUP BY 1, 2),
    hits AS (SELECT r.query_id, r.rid, r.pos, q.grade, row_number() OVER (PARTITION BY r.query_id ORDER BY r.pos) AS nth FROM run r JOIN qrels q ON r.query_id = q.query_id AND r.rid = q.rid),
    ideal AS (SELECT query_id, count(*) AS n, sum(CASE WHEN nth <= 10 THEN grade / log2(nth + 1) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rid) AS nth FROM qrels) GROUP BY 1),
    found AS (SELECT query_id, sum(CASE WHEN pos <= 10 THEN 1 ELSE 0 END) AS found, 1.0 / min(pos) AS rr, sum(CASE WHEN pos <= 10 THEN grade / log2(pos + 1) ELSE 0 END) AS dcg, sum(CASE WHEN pos <= 10 THEN nth / pos ELSE 0 END) AS ap FROM hits GROUP BY 1),
    m AS (SELECT q.query_id, round(coalesce(found / n, 0), 6) AS recall, round(coalesce(rr, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(ap / n, 0), 6) AS ap FROM (SELECT DISTINCT query_id FROM run) q LEFT JOIN ideal USING (query_id) LEFT JOIN found USING (query_id))"""


def _run(spark, d):
    """The fifty longest texts of each namespace; ranked within salts first, a namespace may hold most rows."""
    c = current(spark, d, "namespace", "search_text").select(F.col("namespace").alias("query_id"), "rid", F.coalesce(F.length("search_text"), F.lit(0)).alias("n"), F.pmod(F.xxhash64("rid"), F.lit(16)).alias("salt"))
    part = c.withColumn("pos", F.row_number().over(W.partitionBy("query_id", "salt").orderBy(F.desc("n"), "rid"))).where("pos <= 50")
    return part.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("n"), "rid"))).where("pos <= 50").select("query_id", "rid", "pos")


def _qrels(spark, d):
    links = table(spark, d, "bundle_entities").where("confidence > 0.8").groupBy("rid").agg(F.max(F.when(F.col("mention_count") > 3, 2).otherwise(1)).alias("grade"))
    return links.join(current(spark, d, "namespace").select("rid", F.col("namespace").alias("query_id")), "rid").select("query_id", "rid", "grade")


@query("evl01_retrieval_metrics", f"WITH {_RUN} SELECT * FROM m")
def evl01(spark, d):
    return evaluation.retrieval_metrics(_run(spark, d), _qrels(spark, d))


@query("agg14_mean_metrics", f"WITH {_RUN} SELECT round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(ap), 4) AS ap, count(*) AS queries FROM m")
def agg14(spark, d):
    m = evaluation.mean_metrics(evaluation.retrieval_metrics(_run(spark, d), _qrels(spark, d)))
    return m.select(*[F.round(c, 4).alias(c) for c in ("recall", "mrr", "ndcg", "ap")], "queries")


@query(
    "ret14_alpha_grid",
    f"""WITH {_RUN}, fts AS (SELECT query_id, rid, 1.0 / pos AS rank FROM run), near AS (SELECT run.query_id, rid, similarity FROM (SELECT rid, max(confidence) AS similarity FROM bundle_entities GROUP BY rid) JOIN run USING (rid)),
    b AS (SELECT query_id, min(rank) AS lo, max(rank) AS hi FROM fts GROUP BY 1), sc AS (SELECT query_id, rid, CASE WHEN hi > lo THEN (rank - lo) / (hi - lo) ELSE 1.0 END AS fs FROM fts JOIN b USING (query_id)),
    bo AS (SELECT coalesce(sc.query_id, near.query_id) AS query_id, coalesce(sc.rid, near.rid) AS rid, fs, similarity FROM sc FULL JOIN near ON sc.query_id = near.query_id AND sc.rid = near.rid), gr AS (SELECT *, round(step / 20.0, 4) AS alpha FROM bo, (SELECT unnest(range(21)) AS step)),
    po AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY round(alpha * coalesce(fs, 0) + (1 - alpha) * coalesce(similarity, 0), 9) DESC, rid) AS pos FROM gr), re AS (SELECT DISTINCT query_id, rid FROM qrels WHERE grade > 0), nn AS (SELECT query_id, count(*) AS n FROM re GROUP BY 1),
    hi2 AS (SELECT alpha, query_id, sum(CASE WHEN pos <= 10 THEN 1 ELSE 0 END) AS found, 1.0 / min(pos) AS rr FROM po JOIN re USING (query_id, rid) GROUP BY 1, 2), ev AS (SELECT DISTINCT alpha, query_id FROM po)
    SELECT CAST(alpha AS DOUBLE) AS alpha, round(avg(coalesce(found / n, 0)), 6) AS recall, round(avg(coalesce(rr, 0)), 6) AS mrr FROM ev LEFT JOIN hi2 USING (alpha, query_id) LEFT JOIN nn USING (query_id) GROUP BY alpha""",
)
def ret14(spark, d):
    """Recall and reciprocal rank of each weight; scores are text length and link confidence. """
    run = _run(spark, d).select("query_id", "rid", (1.0 / F.col("pos")).alias("rank"))
    near = table(spark, d, "bundle_entities").groupBy("rid").agg(F.max("confidence").alias("similarity")).join(run.select("query_id", "rid"), "rid")
    return evaluation.alpha_grid(run, near.select("query_id", "rid", "similarity"), _qrels(spark, d))


@query(
    "evl07_extraction_scores",
    """WITH p AS (SELECT DISTINCT rid, name_normalized, entity_type FROM bundle_entities JOIN entities USING (entity_id) WHERE confidence > 0.4),
    g AS (SELECT DISTINCT rid, name_normalized, entity_type FROM bundle_entities JOIN entities USING (entity_id) WHERE confidence > 0.6),
    c AS (SELECT rid, sum(p) AS p, sum(g) AS g, sum(p * g) AS hit FROM (SELECT coalesce(p.rid, g.rid) AS rid, CASE WHEN p.rid IS NULL THEN 0 ELSE 1 END AS p, CASE WHEN g.rid IS NULL THEN 0 ELSE 1 END AS g FROM p FULL JOIN g ON p.rid = g.rid AND p.name_normalized = g.name_normalized AND p.entity_type = g.entity_type) GROUP BY rid),
    s AS (SELECT rid, CASE WHEN g = 0 THEN 0.0 ELSE hit / p END AS precision, CASE WHEN g > 0 THEN hit / g ELSE 1.0 END AS recall FROM c)
    SELECT rid, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM s""",
)
def evl07(spark, d):
    """Links above one confidence against those above another, as predicted and gold."""
    e = table(spark, d, "entities").select("entity_id", "name_normalized", "entity_type")
    links = table(spark, d, "bundle_entities").join(e, "entity_id").select("rid", "name_normalized", "entity_type", "confidence")
    return evaluation.extraction_scores(links.where("confidence > 0.4").drop("confidence").distinct(), links.where("confidence > 0.6").drop("confidence").distinct())


@query("agg21_judgement_stats", f"WITH {_RUN} SELECT query_id, grade, count(*) AS n FROM qrels GROUP BY ALL")
def agg21(spark, d):
    return _qrels(spark, d).groupBy("query_id", "grade").agg(F.count(F.lit(1)).alias("n"))


@query("agg22_best_score", "SELECT rid, max(s) AS score FROM (SELECT rid, confidence AS s FROM bundle_entities UNION ALL SELECT rid, 0.5 FROM chunk_embeddings WHERE rid IS NOT NULL) GROUP BY rid")
def agg22(spark, d):
    a = table(spark, d, "bundle_entities").select("rid", F.col("confidence").alias("s"))
    b = table(spark, d, "chunk_embeddings").where("rid is not null").select("rid", F.lit(0.5).alias("s"))
    return a.unionByName(b).groupBy("rid").agg(F.max("s").alias("score"))


@query("obs04_quality_ratios", "WITH {CUR} SELECT (SELECT least(count(DISTINCT entity_type) / 10.0, 1.0) FROM entities) AS types, round((SELECT count(DISTINCT rid) FROM bundle_entities WHERE rid IN (SELECT rid FROM cur)) / count(*), 6) AS extracted, round((SELECT count(DISTINCT rid) FROM chunk_embeddings WHERE rid IN (SELECT rid FROM cur)) / count(*), 6) AS embedded FROM cur")
def obs04(spark, d):
    c = current(spark, d).select("rid")
    n = c.agg(F.count(F.lit(1)).alias("n"))
    types = table(spark, d, "entities").agg(F.least(F.count_distinct("entity_type") / F.lit(10.0), F.lit(1.0)).alias("types"))
    x = c.join(table(spark, d, "bundle_entities").select("rid").distinct(), "rid", "left_semi").agg(F.count(F.lit(1)).alias("x"))
    e = c.join(table(spark, d, "chunk_embeddings").select("rid").distinct(), "rid", "left_semi").agg(F.count(F.lit(1)).alias("e"))
    return n.crossJoin(types).crossJoin(x).crossJoin(e).select("types", F.round(F.col("x") / F.col("n"), 6).alias("extracted"), F.round(F.col("e") / F.col("n"), 6).alias("embedded"))
