"""Measures of retrieval and extraction over tables of runs and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmesh.functions.text import fuzzy_ratio


def retrieval_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Per query: recall, reciprocal rank, NDCG (gain = grade) and average precision at k.

    ``run`` has (query_id, rid, pos from 1), of repeated rids the first counts; ``qrels`` (query_id, rid, grade > 0
    is relevant). Queries without judgements score 0.
    """
    first = run.groupBy("query_id", "rid").agg(F.min("pos").alias("pos"))
    relevant = qrels.where("grade > 0").groupBy("query_id", "rid").agg(F.max("grade").alias("grade"))
    hits = first.join(relevant, ["query_id", "rid"])
    order = W.partitionBy("query_id").orderBy("pos", "rid")
    ranked = hits.withColumn("nth", F.row_number().over(order))
    found = ranked.groupBy("query_id").agg(
        F.sum(F.when(F.col("pos") <= k, 1).otherwise(0)).alias("found"),
        (1.0 / F.min("pos")).alias("rr"),
        F.sum(F.when(F.col("pos") <= k, F.col("grade") / F.log2(F.col("pos") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("pos") <= k, F.col("nth") / F.col("pos")).otherwise(0.0)).alias("ap"),
    )
    ideal = relevant.withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "rid")))
    ideal = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("nth") <= k, F.col("grade") / F.log2(F.col("nth") + 1)).otherwise(0.0)).alias("idcg"))
    queries = first.select("query_id").distinct()
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return queries.join(ideal, "query_id", "left").join(found, "query_id", "left").select(
        "query_id", zero(F.col("found") / F.col("n")).alias("recall"), zero(F.col("rr")).alias("mrr"), zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(F.col("ap") / F.col("n")).alias("ap")
    )


def mean_metrics(per_query: DataFrame, *by: str) -> DataFrame:
    return per_query.groupBy(*by).agg(*[F.round(F.avg(m), 6).alias(m) for m in ("recall", "mrr", "ndcg", "ap")], F.count(F.lit(1)).alias("queries"))


def latency(times: DataFrame, column: str) -> DataFrame:
    """Mean, p50, p95 and maximum; the quantiles are elements, not interpolated. No rows give none."""
    sums = times.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.max(column).alias("max")).where("n > 0")
    picked = quantile_elements(times, column)
    return sums.crossJoin(F.broadcast(picked)).select("mean", "p50", "p95", "max")  # one row each


#: Runs that the values of a column are counted in before the run of a quantile is looked at value by value.
RUNS = 1024


def quantile_elements(times: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Elements at given shares of any number of rows, exact: values are counted, the counts summed by runs of values
    (``RUNS`` of them, so the one window is over as many rows), and only the runs that hold a quantile are gone through
    value by value."""
    counts = times.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.agg(F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high"), F.sum("n").alias("all"))
    spread = F.greatest(F.lit(1e-300), F.col("high") - F.col("low"))
    run = F.least(F.lit(RUNS - 1), F.floor((F.col("v").cast("double") - F.col("low")) / spread * RUNS)).cast("int")
    placed = counts.crossJoin(F.broadcast(bounds)).withColumn("run", run)  # one row
    sums = placed.groupBy("run").agg(F.sum("n").alias("of_run"))
    before = sums.select("run", F.coalesce(F.sum("of_run").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), "of_run")  # RUNS rows
    wanted = [F.floor(F.col("all") * p) for p in shares]
    held = placed.join(F.broadcast(before), "run").where(_either([(w >= F.col("before")) & (w < F.col("before") + F.col("of_run")) for w in wanted]))
    upto = held.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy("run").orderBy("v")))
    return upto.agg(*[F.min(F.when(F.col("upto") > w, F.col("v"))).alias(f"p{int(p * 100)}") for w, p in zip(wanted, shares, strict=True)])


def _either(conditions: list) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def alpha_grid(fts: DataFrame, near: DataFrame, qrels: DataFrame, steps: int = 20, k: int = 10) -> DataFrame:
    """Recall and reciprocal rank for each weight 0, 1/steps ... 1 of the full-text score.

    ``fts`` has (query_id, rid, rank), ``near`` (query_id, rid, similarity); the hits of a query are repeated once per
    weight, nothing else is.
    """
    w = W.partitionBy("query_id")
    low, high = F.min("rank").over(w), F.max("rank").over(w)
    scaled = fts.withColumn("fts_score", F.when(high > low, (F.col("rank") - low) / (high - low)).otherwise(1.0))
    both = scaled.join(near, ["query_id", "rid"], "full_outer")
    grid = both.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("alpha", F.round(F.col("step") / steps, 4))
    grid = grid.withColumn("score", F.round(F.col("alpha") * F.coalesce("fts_score", F.lit(0.0)) + (1 - F.col("alpha")) * F.coalesce("similarity", F.lit(0.0)), 9))
    pos = grid.withColumn("pos", F.row_number().over(W.partitionBy("alpha", "query_id").orderBy(F.desc("score"), "rid")))
    relevant = qrels.where("grade > 0").select("query_id", "rid").distinct()
    n = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hit = pos.join(relevant, ["query_id", "rid"]).groupBy("alpha", "query_id").agg(F.sum(F.when(F.col("pos") <= k, 1).otherwise(0)).alias("found"), (1.0 / F.min("pos")).alias("rr"))
    every = pos.select("alpha", "query_id").distinct().join(hit, ["alpha", "query_id"], "left").join(n, "query_id", "left")
    return every.groupBy("alpha").agg(F.round(F.avg(F.coalesce(F.col("found") / F.col("n"), F.lit(0.0))), 6).alias("recall"), F.round(F.avg(F.coalesce("rr", F.lit(0.0))), 6).alias("mrr"))


#: Fixed value: from which ratio on two names are the same.
FUZZY = 85.0


def matched_entities(predicted: DataFrame, gold: DataFrame, key: str = "rid") -> DataFrame:
    """``(key, entity_type, predicted, gold)``: names of one text and type matched one to one, each predicted name in
    its order taking the first gold name that is left and at least ``FUZZY`` alike.

    Pairs are made within a text and type only, and those that aren't alike are dropped before the greedy walk, which
    takes a text's remaining pairs in order of (predicted, gold) by a fold.
    """
    p = predicted.select(key, "entity_type", F.col("name").alias("p")).groupBy(key, "entity_type", "p").agg(F.count(F.lit(1)).alias("_n")).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    g = gold.select(key, "entity_type", F.col("name").alias("g")).groupBy(key, "entity_type", "g").agg(F.count(F.lit(1)).alias("_n")).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    near = p.join(g, [key, "entity_type"]).where(fuzzy_ratio(F.lower("p"), F.lower("g")) >= FUZZY)
    lists = near.groupBy(key, "entity_type").agg(F.array_sort(F.collect_list(F.struct("p", "i", "g", "j"))).alias("all"))  # alike names of one text and type
    kind = "array<struct<p:string,i:long,g:string,j:long>>"
    free = lambda acc, x: ~F.exists(acc, lambda y: ((y["p"] == x["p"]) & (y["i"] == x["i"])) | ((y["g"] == x["g"]) & (y["j"] == x["j"])))
    taken = F.aggregate(F.col("all").cast(kind), F.array().cast(kind), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return lists.select(key, "entity_type", F.explode(taken).alias("m")).select(key, "entity_type", F.col("m.p").alias("predicted"), F.col("m.g").alias("gold"))


def fuzzy_extraction_scores(predicted: DataFrame, gold: DataFrame, key: str = "rid", *by: str) -> DataFrame:
    """Per text (and further columns of both tables in ``by``): precision, recall and F1 of fuzzily matched entities."""
    keys = [key, *by]
    p = predicted.groupBy(*keys).agg(F.count(F.lit(1)).alias("p"))
    g = gold.groupBy(*keys).agg(F.count(F.lit(1)).alias("g"))
    hit = matched_entities(predicted, gold, key).groupBy(*keys).agg(F.count(F.lit(1)).alias("hit"))
    both = p.join(g, keys, "full_outer").join(hit, keys, "left").na.fill(0, ["p", "g", "hit"])
    return _scores(both, keys)


def mean_extraction(scores: DataFrame, *by: str) -> DataFrame:
    """Means of precision, recall and F1 over all texts, or by columns of the scores."""
    return scores.groupBy(*by).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")], F.count(F.lit(1)).alias("texts"))


def extraction_scores(predicted: DataFrame, gold: DataFrame, key: str = "rid") -> DataFrame:
    """Per text: precision, recall and F1 of (key, name_normalized, entity_type) sets, matched one to one.

    Without gold entities recall is 1, and precision and F1 are 1 only if nothing was predicted.
    """
    p = predicted.groupBy(key, "name_normalized", "entity_type").agg(F.count(F.lit(1)).alias("p"))
    g = gold.groupBy(key, "name_normalized", "entity_type").agg(F.count(F.lit(1)).alias("g"))
    both = p.join(g, [key, "name_normalized", "entity_type"], "full_outer").na.fill(0, ["p", "g"])
    return _scores(both.groupBy(key).agg(F.sum(F.least("p", "g")).alias("hit"), F.sum("p").alias("p"), F.sum("g").alias("g")), [key])


def _scores(sums: DataFrame, keys: list[str]) -> DataFrame:
    precision = F.when(F.col("p") > 0, F.col("hit") / F.col("p")).otherwise(F.when(F.col("g") == 0, 1.0).otherwise(0.0))
    precision = F.when((F.col("g") == 0) & (F.col("p") > 0), 0.0).otherwise(precision)
    recall = F.when(F.col("g") > 0, F.col("hit") / F.col("g")).otherwise(1.0)
    out = sums.select(*keys, precision.alias("precision"), recall.alias("recall"))
    both_zero = (F.col("precision") + F.col("recall")) == 0
    f1 = F.when(both_zero, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.select(*keys, F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(F.when(F.col("precision") == 0, 0.0).otherwise(f1), 6).alias("f1"))


def against_first(reports: DataFrame, label: str, order: str, metrics: tuple[str, ...]) -> DataFrame:
    """Each report's metrics and their difference to the first report."""
    w = W.orderBy(order, label).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return reports.select(label, *metrics, *[F.round(F.col(m) - F.first(m).over(w), 6).alias(f"d_{m}") for m in metrics])
