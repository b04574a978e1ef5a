"""Graphs of entities: triples, personalised PageRank, walks up a hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmesh.runtime import durable

DAMPING, ROUNDS, EPSILON = 0.85, 30, 1e-6


def merge_triples(triples: DataFrame) -> DataFrame:
    """Repeated triples as one edge: weight 1 and 0.1 more for each repeat, the first source, the last access."""
    return triples.groupBy("src", "type", "dst").agg(
        F.round(1.0 + 0.1 * (F.count(F.lit(1)) - 1), 6).alias("weight"), F.min_by("source", F.struct("at", "source")).alias("source"), F.max("at").alias("last_accessed")
    )


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, epsilon: float = EPSILON) -> DataFrame:
    """``(node, score)`` of the personalised PageRank over (src, dst, weight), spread from ``seeds`` (node).

    A missing or zero weight counts 1; mass at nodes without out-edges is dropped; seeds that aren't nodes don't count,
    and without seeds there are no scores. Stops when no score moves by epsilon. Edges are combined and scaled once;
    each round is one join and one sum, written to the shared folder, where convergence is looked at: a round reads
    the one before twice, so unwritten rounds would double the plan each time.
    """
    e = edges.select("src", "dst", F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight")).alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    flow = durable(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    nodes = flow.select(F.col("src").alias("node")).union(flow.select("dst")).distinct()
    chosen = durable(nodes.join(seeds.select("node").distinct(), "node", "left_semi").withColumn("seed", F.lit(True)))
    n = chosen.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("score")).limit(0)
    start = durable(nodes.join(chosen, "node", "left").select("node", F.when(F.col("seed"), 1.0 / n).otherwise(0.0).alias("base")))
    state = start.select("node", "base", F.col("base").alias("score"))
    for _ in range(rounds):
        came = state.where("score > 0").join(flow, state["node"] == flow["src"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("came"))
        new = state.join(came, state["node"] == came["dst"], "left").select("node", "base", ((1 - damping) * F.col("base") + damping * F.coalesce("came", F.lit(0.0))).alias("score"), F.col("score").alias("was"))
        new = durable(new)
        moved = new.agg(F.max(F.abs(F.col("score") - F.col("was"))).alias("m")).first().m
        if moved is not None and moved < epsilon:
            return new.select("node", "score")
        state = new.select("node", "base", "score")
    return state.select("node", "score")


def rank_sources(scores: DataFrame, links: DataFrame, top_nodes: int = 50, most: int = 20) -> DataFrame:
    """Texts (rid) by the best score among their linked nodes; only the best nodes count."""
    best = scores.where("score > 0").orderBy(F.desc("score"), "node").limit(top_nodes)
    return links.join(best, "node").groupBy("rid").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "rid").limit(most)


def triples_of(sources: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """Up to ``most`` triples of each source, heaviest first."""
    w = W.partitionBy("source").orderBy(F.desc("weight"), "src", "type", "dst")
    rows = edges.join(sources.select("source").distinct(), "source", "left_semi")
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)


def find_seeds(nodes: DataFrame, terms: list[str], most: int = 10) -> DataFrame:
    """Nodes whose name equals a term; for terms without such a node, nodes that contain it, at most ten a term."""
    low = nodes.select("node", F.lower("name").alias("low"))
    wanted = nodes.sparkSession.createDataFrame([(t.lower(),) for t in terms] or [("",)], "term string").where("term <> ''")
    exact = low.join(F.broadcast(wanted), low["low"] == wanted["term"]).select("term", "node")  # the words of one query
    rest = wanted.join(exact.select("term").distinct(), "term", "left_anti")
    near = low.join(F.broadcast(rest), F.contains(low["low"], rest["term"])).select("term", "node")
    ranked = near.withColumn("pos", F.row_number().over(W.partitionBy("term").orderBy("node"))).where(F.col("pos") <= most)
    return exact.unionByName(ranked.select("term", "node")).select("node").distinct()


def folder_paths(items: DataFrame, depth: int | None = None) -> DataFrame:
    """``(id, path)`` of (id, parent, title) rows: titles from the root down; a walk that comes back to a node ends.

    One equi-join per level, until no walk goes on (``depth`` levels at most, if given); only rows whose walk goes on
    are joined again, and each level is written to the shared folder.
    """
    names = items.select(F.col("id").alias("p_id"), F.col("parent").alias("p_parent"), F.col("title").alias("p_title"))
    walk = items.select("id", F.col("parent").alias("next"), F.array(F.coalesce("title", F.lit(""))).alias("titles"), F.array("id").alias("seen"))
    done, level = None, 0
    while depth is None or level < depth:
        joined = durable(walk.join(names, (walk["next"] == names["p_id"]) & ~F.array_contains(walk["seen"], walk["next"]), "left"))
        ended = joined.where("p_id is null").select("id", "titles")
        done = ended if done is None else done.unionByName(ended)
        walk = joined.where("p_id is not null").select("id", F.col("p_parent").alias("next"), F.concat(F.array(F.coalesce("p_title", F.lit(""))), F.col("titles")).alias("titles"), F.concat(F.col("seen"), F.array("p_id")).alias("seen"))
        level += 1
        if walk.isEmpty():
            break
    done = walk.select("id", "titles") if done is None else done.unionByName(walk.select("id", "titles"))
    return done.select("id", F.concat(F.lit("/"), F.array_join("titles", "/")).alias("path"))
