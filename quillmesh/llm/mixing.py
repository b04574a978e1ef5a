"""Mixing sources to target shares of all tokens, with capped repeats.

Iterative proportional fitting. The tokens of the listed sources are counted per cell (source, language, topic) and
the cells' weights are raked in turn to the marginals of topic, language and, last, source, so the sources' targets
hold exactly wherever the caps allow; languages and topics come as near to their own shares of the pool as that
permits. A document is then drawn floor(w) times and once more with probability w - floor(w), w being its cell's
weight. The last draw compares a hash of doc_id and seed with that probability; per source the comparison is
calibrated on a histogram of the hashes (``BINS`` per source), which takes the sampling error out of the shares.

The size of the mix is ``total`` tokens, by default the tokens that the listed sources have. No weight exceeds
max_repeats, so a source that cannot reach its target gives max_repeats times what it has. Shares need not sum to 1.

Defined results: documents without a listed source are never drawn; empty and null texts have no tokens and are never
drawn; a listed source without documents is reported with 0; of a source listed twice the greater share and cap hold;
null or negative shares and caps count as 0; languages are compared in lower case without region, anything but two
letters is 'und'; rows repeating a doc_id are drawn each for itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmesh.llm.tokens import token_counts
from quillmesh.runtime import durable

BINS = 4096
#: Rounds of raking; sources are always raked last.
ROUNDS = 60
#: Cells (source, language, topic) that the driver rakes at most; topics are meant to be few.
CELLS = 200_000


def language(lang: Column) -> Column:
    base = F.lower(F.trim(F.split(F.coalesce(lang, F.lit("")), "[-_]")[0]))
    return F.when(base.rlike("^[a-z]{2}$"), base).otherwise(F.lit("und"))


def rake(cells: pd.DataFrame, targets: pd.DataFrame, total: float | None = None, rounds: int = ROUNDS) -> pd.DataFrame:
    """``cells`` (source, lang, topic, tokens) with their weights; ``targets`` (source, target_share, max_repeats)."""
    cells = cells.reset_index(drop=True)
    have = cells["tokens"].to_numpy(float)
    pool = float(have.sum())
    size = pool if total is None else float(total)
    goal = targets.set_index("source")
    cap = cells["source"].map(goal["max_repeats"]).to_numpy(float)
    by_source = {s: np.asarray(i) for s, i in cells.groupby("source").indices.items()}
    reach = {s: min(goal.at[s, "target_share"] * size, float((cap[i] * have[i]).sum())) for s, i in by_source.items()}
    weight = np.minimum(np.asarray([reach[s] for s in cells["source"]]) / np.maximum(1e-9, cells["source"].map(cells.groupby("source")["tokens"].sum()).to_numpy(float)), cap)
    drawn = sum(reach.values())

    def fit(groups: dict, aims: dict) -> None:
        for g, i in groups.items():
            for _ in range(4):  # capped cells keep their cap, the others share what is missing
                now = weight[i] * have[i]
                free = weight[i] < cap[i] - 1e-12
                missing = aims[g] - now.sum()
                if abs(missing) <= 1e-9 * max(1.0, aims[g]) or now.sum() <= 0:
                    break
                if missing < 0:
                    weight[i] *= aims[g] / now.sum()
                    break
                if not free.any() or now[free].sum() <= 0:
                    break
                grown = weight[i].copy()
                grown[free] *= 1 + missing / now[free].sum()
                weight[i] = np.minimum(grown, cap[i])

    if drawn > 0 and pool > 0:
        by_lang = {g: np.asarray(i) for g, i in cells.groupby("lang").indices.items()}
        by_topic = {g: np.asarray(i) for g, i in cells.groupby("topic").indices.items()}
        lang_aim = {g: drawn * have[i].sum() / pool for g, i in by_lang.items()}
        # a topic's aim follows the sources that hold it, since those must keep their targets
        topic_aim = {g: float(sum(reach[s] * have[np.intersect1d(i, by_source[s])].sum() / max(1e-9, have[by_source[s]].sum()) for s in cells["source"].iloc[i].unique())) for g, i in by_topic.items()}
        for _ in range(rounds):
            before = weight.copy()
            fit(by_topic, topic_aim)
            fit(by_lang, lang_aim)
            fit(by_source, reach)
            if np.abs(weight - before).max(initial=0.0) < 1e-9:
                break
    return cells.assign(weight=weight)


def _clean_targets(targets: DataFrame) -> DataFrame:
    share, cap = F.coalesce("target_share", F.lit(0.0)), F.coalesce("max_repeats", F.lit(0))
    return targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.greatest(F.lit(0.0), F.max(share)).alias("target_share"), F.greatest(F.lit(0), F.max(cap)).alias("max_repeats"))


def counted(documents: DataFrame, targets: DataFrame, topic: Column | None = None, path: str | None = None) -> DataFrame:
    """Documents of the listed sources with n_tokens, lang_key and topic, written once to the shared folder."""
    listed = F.broadcast(_clean_targets(targets).select("source"))  # as many rows as sources are listed by hand
    pool = documents.select("doc_id", "text", "source", language(F.col("lang")).alias("lang_key"), (topic if topic is not None else F.coalesce("namespace", F.lit(""))).alias("topic")).join(listed, "source", "left_semi")
    return durable(token_counts(pool, keep=("doc_id", "source", "lang_key", "topic"), path=path))


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42, topic: Column | None = None, path: str | None = None) -> DataFrame:
    """``(doc_id, source, copies, n_tokens)`` of every drawn document.

    To the driver come: the targets, one row per cell (listed sources x two-letter languages x topics), and one
    histogram row per listed source and bin. None of these grows with the documents; more than ``CELLS`` cells, which
    can only come from a topic that is no bounded set, raise an error.
    """
    docs = counted(documents, targets, topic, path)
    return _draw(docs, targets, total, seed)


def _draw(docs: DataFrame, targets: DataFrame, total: float | None, seed: int) -> DataFrame:
    spark = docs.sparkSession
    goal = _clean_targets(targets).toPandas()
    cells = docs.where("n_tokens > 0").groupBy("source", "lang_key", "topic").agg(F.sum("n_tokens").alias("tokens")).withColumnRenamed("lang_key", "lang").limit(CELLS + 1).toPandas()
    if len(cells) > CELLS:
        raise ValueError(f"more than {CELLS} cells of source, language and topic; give a topic of fewer values")
    fitted = rake(cells, goal, total)
    fitted["base"] = np.floor(fitted["weight"] + 1e-12)
    fitted["part"] = (fitted["weight"] - fitted["base"]).clip(lower=0.0)
    plan = spark.createDataFrame(
        [(r.source, r.lang, r.topic, int(r.base), float(r.part)) for r in fitted.itertuples()], "source string, lang_key string, topic string, base int, part double"
    )
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    drawn = docs.where("n_tokens > 0").join(F.broadcast(plan), ["source", "lang_key", "topic"]).withColumn("level", F.when(F.col("part") > 0, chance / F.col("part")))
    # per source: the level up to which extra copies are given, so that their tokens meet what is wanted
    binned = drawn.where("level < 2").groupBy("source", F.floor(F.col("level") * (BINS / 2)).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("tokens")).toPandas()
    levels = []
    for source, group in fitted.groupby("source"):
        wanted = float((group["part"] * group["tokens"]).sum())
        held = binned[binned["source"] == source].sort_values("bin")
        sums = np.concatenate([[0.0], held["tokens"].to_numpy(float).cumsum()])
        at = int(np.argmin(np.abs(sums - wanted)))
        levels.append((source, 0.0 if at == 0 else (int(held["bin"].iloc[at - 1]) + 1) * 2.0 / BINS))
    border = spark.createDataFrame(levels or [("", 0.0)], "source string, border double")
    copies = F.col("base") + F.when(F.col("level") < F.col("border"), 1).otherwise(0)
    return drawn.join(F.broadcast(border), "source").withColumn("copies", copies.cast("int")).where("copies > 0").select("doc_id", "source", "copies", "n_tokens")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: wanted and actual share, tokens, copies and distinct documents."""
    goal = _clean_targets(targets)
    got = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.sum(F.col("copies").cast("long")).alias("copies"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_repeats"))
    whole = F.sum("tokens").over(W.partitionBy())  # over one row per listed source
    return (
        goal.join(got, "source", "left").withColumn("all_tokens", whole)
        .select("source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "copies", "documents", "most_repeats")], F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))
    )
