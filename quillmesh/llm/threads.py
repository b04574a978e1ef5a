"""Rebuilding conversations from rows that hold one chat message each.

1. A message's row is parsed once; the reference ``platform:thread:number`` gives thread and number.
2. Threads that are broken, empty or unanswered are dropped (see ``kept_threads``).
3. Messages are put in order by a range partitioning on (thread, time, number) and numbered through the counts of the
   runs before them, so a thread that holds a third of all rows is spread over as many tasks as its size calls for.
4. Interleaved talk is disentangled: each message's candidate parents are all earlier messages of the thread that can
   win; links are scored by time between the two, common words, mention of the parent's sender, and change of sender;
   the likeliest is taken if it reaches ``LEAST_SCORE``. The weights are fitted on the replies that say what they
   answer (at most ``LABELLED`` of them), as a choice among candidates. A reply_to is a link with certainty. Links form
   trees by pointer jumping, and a thread's turns are those of its trees.

Defined results: rows without a well-formed reference are no messages; null or blank content takes no turn and is
neither parent nor child; a blank reply_to is none; messages with equal time and number are ordered by reference;
repeated rows of a message count once; an empty table gives no rows. Times without a zone are UTC; whole numbers are
seconds, from 100,000,000,000 on milliseconds; impossible times are unusable.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillmesh.runtime import durable, latest, shuffle_partitions, stored

#: How the namespace of messages ends.
NAMESPACE = "-message"
FIELDS = ("content", "content_type", "sender_id", "reply_to", "platform_ts")
REFERENCE = r"(?s)^([^:]+):(.+):(\d+)$"
SALTS = 16
#: Rows of a thread that one window works on.
STRETCH = 256
#: Weights of time, common words, mention and change of sender before any fit; fitted ones have the same sum.
WEIGHTS = (0.5, 0.4, 0.6, 0.1)
LEAST_SCORE = 0.35
#: Seconds in which the weight of time falls to a half.
HALF_LIFE = 900.0
#: Seconds from which on time adds so little that a share of the words must be common, and the least such share.
HORIZON = 3600
LEAST_SHARE = 0.25
#: Told replies that the weights are fitted on, and other candidates that each is compared with, at most.
LABELLED, OTHERS = 2000, 20


def instant(raw: Column) -> Column:
    """Whole seconds since 1970 of the notations of platform_ts; null if unusable."""
    text = F.trim(raw)
    number = F.when(text.rlike(r"^[+-]?\d{1,17}(\.\d+)?$"), F.floor(text.try_cast("decimal(30,9)")).cast("long"))
    seconds = F.when(F.abs(number) >= 100_000_000_000, F.floor(text.try_cast("decimal(30,9)") / 1000).cast("long")).otherwise(number)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*([Zz]|[+-]\d{2}:?\d{2})?$"), text)
    zoned = F.when(iso.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$"), F.regexp_replace(F.upper(iso), r"\s*([+-]\d{2}):?(\d{2})$", "$1:$2")).otherwise(F.concat(iso, F.lit("Z")))
    return F.coalesce(seconds, F.unix_seconds(zoned.try_cast("timestamp")))


def messages(bundles: DataFrame) -> DataFrame:
    """Parsed current message rows: thread_id, number, reference, valid, blank, ts and the fields."""
    rows = latest(bundles.where(F.col("namespace").endswith(NAMESPACE)), "rid", "updated_at", "rid", "updated_at", "reference", "contents")
    kind = T.StructType([*(T.StructField(f, T.StringType()) for f in FIELDS), T.StructField("_bad", T.StringType())])
    told = F.from_json("contents", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.withColumn("told", told).where(F.col("reference").rlike(REFERENCE))
    rows = rows.select(
        "reference",
        F.regexp_extract("reference", REFERENCE, 2).alias("thread_id"),
        F.regexp_extract("reference", REFERENCE, 3).cast("decimal(38,0)").alias("number"),
        (F.col("told").isNotNull() & F.col("told._bad").isNull() & F.coalesce(F.col("contents").rlike(r"^\s*\{"), F.lit(False))).alias("valid"),
        *[F.col(f"told.{f}").alias(f) for f in FIELDS],
    )
    blank = F.coalesce(F.col("content"), F.lit("")).rlike(r"(?U)^\s*$")
    return rows.withColumns({"blank": blank, "ts": instant(F.col("platform_ts")), "reply_to": F.when(~F.col("reply_to").rlike(r"^\s*$"), F.col("reply_to"))})


def with_roles(rows: DataFrame, self_senders: DataFrame) -> DataFrame:
    own = self_senders.where(F.col("sender_id").isNotNull()).select("sender_id").distinct().withColumn("own", F.lit(True))
    role = F.when(F.col("content_type") == "service", "system").when(F.col("own"), "self").otherwise("other")
    return rows.join(own, "sender_id", "left").withColumn("role", role).drop("own")


def kept_threads(rows: DataFrame) -> DataFrame:
    """Ids of the threads whose contents all parse, whose replies all name a message of the thread, whose messages all
    have a usable time, and in which both self and other say something."""
    said = ~F.col("blank")
    flags = rows.groupBy("thread_id").agg(
        F.bool_or(~F.col("valid")).alias("unparsed"),
        F.bool_or(said & F.col("ts").isNull()).alias("untimed"),
        F.bool_or(said & (F.col("role") == "self")).alias("asked"),
        F.bool_or(said & (F.col("role") == "other")).alias("answered"),
    )
    good = flags.where(~F.col("unparsed") & ~F.col("untimed") & F.col("asked") & F.col("answered")).select("thread_id")
    named = rows.where(F.col("reply_to").isNotNull()).select("thread_id", F.col("reply_to").alias("reference")).distinct()
    lost = named.join(rows.select("thread_id", "reference"), ["thread_id", "reference"], "left_anti").select("thread_id").distinct()
    return good.join(lost, "thread_id", "left_anti")


def ordered(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Spoken messages of kept threads with node (a unique id in order) and turn_no.

    The join with the kept threads is salted (the threads repeated per salt), the numbering needs no window over a
    thread: a partition's run of one thread starts where the runs before it ended.
    """
    spark = rows.sparkSession
    spread = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spoken = rows.where(~F.col("blank")).withColumn("salt", F.pmod(F.xxhash64("reference"), F.lit(SALTS)).cast("int")).join(spread, ["thread_id", "salt"], "left_semi").drop("salt")
    keys = ["thread_id", "ts", "number", "reference"]
    placed = spoken.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    placed = durable(placed.select("thread_id", "ts", "reference", "role", "sender_id", "content", "reply_to", F.monotonically_increasing_id().alias("node")))
    part = F.shiftright("node", 33).alias("part")
    runs = placed.groupBy("thread_id", part).agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("thread_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("thread_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.withColumn("part", part).join(runs, ["thread_id", "part"]).withColumn("turn_no", F.col("node") - F.col("first") + F.col("offset") + 1).drop("part", "first", "offset")


def _speakers_before(rows: DataFrame) -> DataFrame:
    """``(thread_id, node, turn_no)`` of the turn directly before each turn and of the last one by another sender.

    Runs of one sender are found in stretches of ``STRETCH`` turns, each with the last turn of the one before; a run
    that began in an earlier stretch is carried on from the stretches' latest beginnings.
    """
    place = F.col("turn_no") - 1
    own = F.floor(place / STRETCH)
    both = F.when(place % STRETCH == STRETCH - 1, F.array(own, own + 1)).otherwise(F.array(own))
    near = rows.select("thread_id", "node", "turn_no", "sender", F.explode(both).alias("stretch"), own.alias("own"))
    turn = W.partitionBy("thread_id", "stretch").orderBy("turn_no")
    begins = F.when(~F.col("sender").eqNullSafe(F.lag("sender").over(turn)), F.col("turn_no"))
    near = near.withColumn("begins", begins).where(F.col("own") == F.col("stretch"))
    near = near.withColumn("start", F.max("begins").over(turn.rowsBetween(W.unboundedPreceding, 0)))
    earlier = W.partitionBy("thread_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    carried = near.groupBy("thread_id", "stretch").agg(F.max("begins").alias("begins")).select("thread_id", "stretch", F.max("begins").over(earlier).alias("carried"))
    start = F.coalesce("start", "carried")
    last = near.join(carried, ["thread_id", "stretch"]).select("thread_id", "node", F.explode(F.array_distinct(F.array(F.col("turn_no") - 1, start - 1))).alias("turn_no"))
    return last.where("turn_no > 0")


def fit_weights(chosen: np.ndarray, group: np.ndarray, features: np.ndarray, rounds: int = 300) -> tuple[float, ...]:
    """Weights of a choice among candidates: ``features`` of each, its ``group`` and whether it is the one chosen.

    Ascent on the likelihood of the choices around ``WEIGHTS``, which count as ten choices; no weight is negative.
    """
    if not len(chosen):
        return WEIGHTS
    prior = np.asarray(WEIGHTS)
    w = prior * 4
    centre = w.copy()
    _, at = np.unique(group, return_inverse=True)
    n = max(1, int(chosen.sum()))
    for _ in range(rounds):
        score = features @ w
        score = np.exp(score - np.maximum.reduceat(score, np.flatnonzero(np.r_[True, at[1:] != at[:-1]]))[at])
        p = score / np.bincount(at, weights=score)[at]
        slope = features.T @ (chosen - p) / n - 10 / (n + 10) * (w - centre)
        w = np.maximum(0.0, w + slope)
    total = w.sum()
    return tuple((w * prior.sum() / total).tolist()) if total > 0 else WEIGHTS


def least_score(weights: tuple[float, ...]) -> tuple[float, float]:
    """The score that a link must reach, and the share of common words that a parent beyond the horizon then has."""
    time, common, _, other = weights
    base = other + time * 0.5 ** (HORIZON / HALF_LIFE)
    least = max(LEAST_SCORE, base + LEAST_SHARE * common)
    return least, min(1.0, (least - base) / common) if common > 0 else 1.0


def reply_links(turns: DataFrame, hidden: bool = False) -> DataFrame:
    """``(node, parent, score)`` of every message; parent is null where none is likely enough.

    Every earlier turn of the thread that can win is scored. One that shares no word and isn't mentioned is beaten by
    the turn directly before or by the last one of another sender; mentioned senders' turns are all scored, as are
    those within ``HORIZON`` that share a word. Farther back a share of the smaller of two sets of words must be common
    (``least_score``); then one of its rarest words is (as many as may be missing, and one), on which they are joined.
    Of turns alike in sender and words only the last before a message can win. ``hidden`` leaves what is told out of
    the result, for a measure of the guesses.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)))
    sender = F.coalesce("sender_id", F.lit(""))
    said = F.when(F.contains(F.col("content"), F.lit("@")), F.lower("content"))
    rows = turns.select("thread_id", "node", "ts", "turn_no", sender.alias("sender"), F.lower(F.regexp_extract(sender, "([^:@]+)$", 1)).alias("who"), words.alias("words"), said.alias("said"))
    alike = W.partitionBy("thread_id", "sender", "words").orderBy("node")
    rows = durable(rows.withColumn("next", F.lead("node").over(alike)))
    target = turns.select(F.col("thread_id"), F.col("reference").alias("reply_to"), F.col("node").alias("told"))
    told = durable(turns.where(F.col("reply_to").isNotNull()).select("thread_id", "node", "reply_to").join(target, ["thread_id", "reply_to"]).where("told < node").select("node", "told"))
    asking = rows.select("thread_id", *(F.col(c).alias(f"q_{c}") for c in ("node", "ts", "turn_no", "sender", "words", "said")))

    def featured(pairs: DataFrame, named: bool = False) -> DataFrame:
        common = F.size(F.array_intersect("q_words", "words")) / F.greatest(F.lit(1), F.least(F.size("q_words"), F.size("words")))
        time = F.pow(F.lit(0.5), (F.col("q_ts") - F.col("ts")) / HALF_LIFE)
        other = F.when(F.col("q_sender") != F.col("sender"), 1.0).otherwise(0.0)
        return pairs.select(F.col("q_node").alias("node"), F.col("node").alias("parent"), time.alias("time"), common.alias("common"), F.lit(float(named)).alias("named"), other.alias("other"))

    before = _speakers_before(rows).withColumnRenamed("node", "q_node").join(rows.select("thread_id", "turn_no", "node", "ts", "sender", "words"), ["thread_id", "turn_no"])
    before = featured(before.join(asking.drop("thread_id"), "q_node"))
    # turns within the horizon that share a word, from a message's own stretch of time and the one before
    slot = F.floor(F.col("ts") / HORIZON)
    held = rows.select("thread_id", "node", "ts", "next", F.size("words").alias("size"), F.explode("words").alias("word"))
    later = held.select("thread_id", "word", F.col("node").alias("q_node"), F.col("ts").alias("q_ts"), F.explode(F.array(slot, slot - 1)).alias("slot"))
    near = later.join(held.select("thread_id", "word", "node", "ts", "next", slot.alias("slot")), ["thread_id", "word", "slot"]).where((F.col("node") < F.col("q_node")) & (F.col("next").isNull() | (F.col("q_node") <= F.col("next"))) & (F.col("q_ts") - F.col("ts") <= HORIZON))
    near = near.select("q_node", "node").distinct()
    parents = rows.select("node", "ts", "sender", "words")
    near = featured(near.join(parents, "node").join(asking.drop("thread_id"), "q_node"))
    # all turns of the senders that a message mentions, joined on the two characters behind an @
    behind = F.array_distinct(F.transform(F.filter(F.split("q_said", "@"), lambda x, i: (i > 0) & (F.length(x) > 1)), lambda x: F.substring(x, 1, 2)))
    asked = asking.where("q_said is not null").withColumn("begins", F.explode(behind))
    people = rows.where(F.length("who") > 1).select("thread_id", "who", F.substring("who", 1, 2).alias("begins")).distinct()
    asked = asked.join(people, ["thread_id", "begins"]).where(F.contains(F.col("q_said"), F.concat(F.lit("@"), F.col("who")))).drop("q_said", "begins").distinct()
    named = featured(asked.join(rows.select("thread_id", "who", "node", "ts", "sender", "words", "next"), ["thread_id", "who"]).where("node < q_node and (next is null or q_node <= next)"), True)
    close = durable(before.unionByName(near).unionByName(named).groupBy("node", "parent").agg(*[F.max(c).alias(c) for c in ("time", "common", "named", "other")]))
    weights = _fitted(close, told)
    least, share = least_score(weights)
    # farther back: the rarest words of the smaller set against all words of the larger
    met = held.groupBy("thread_id", "word").agg(F.count(F.lit(1)).alias("met"))
    ranked = held.join(met, ["thread_id", "word"]).groupBy("thread_id", "node", "ts", "next", "size").agg(F.array_sort(F.collect_list(F.struct("met", "word"))).alias("ranked"))
    most = (F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1).cast("int")
    rare = ranked.select("thread_id", *(F.col(c).alias(f"s_{c}") for c in ("node", "ts", "next", "size")), F.explode(F.slice("ranked.word", F.lit(1), most)).alias("word"))
    late, early = F.greatest("s_node", "node"), F.least("s_node", "node")
    until = F.when(F.col("s_node") < F.col("node"), F.col("s_next")).otherwise(F.col("next"))
    far = rare.join(held, ["thread_id", "word"]).where((F.col("s_size") <= F.col("size")) & (F.abs(F.col("s_ts") - F.col("ts")) > HORIZON) & (until.isNull() | (late <= until)))
    far = far.select(late.alias("q_node"), early.alias("node")).distinct()
    far = featured(far.join(parents, "node").join(asking.drop("thread_id"), "q_node"))

    score = sum((F.col(c) * w for c, w in zip(("time", "common", "named", "other"), weights, strict=True)), F.lit(0.0))
    best = close.unionByName(far).select("node", score.alias("score"), "parent").groupBy("node").agg(F.max(F.struct("score", "parent")).alias("best"))
    best = rows.select("node").join(best, "node", "left")
    guess = best.select("node", F.when(F.col("best.score") >= least, F.col("best.parent")).alias("guess"), F.col("best.score").alias("score"))
    if hidden:
        return guess.select("node", F.col("guess").alias("parent"), "score")
    return guess.join(told, "node", "left").select("node", F.coalesce("told", "guess").alias("parent"), F.when(F.col("told").isNotNull(), 1.0).otherwise(F.col("score")).alias("score"))


def _fitted(close: DataFrame, told: DataFrame) -> tuple[float, ...]:
    """Weights fitted on a bounded sample of told replies whose parent is among the candidates."""
    n = told.count()
    if n == 0:
        return WEIGHTS
    share = min(1.0, LABELLED / n)
    picked = told.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30) < share)
    rows = close.join(picked, "node").withColumn("chosen", (F.col("parent") == F.col("told")).cast("int"))
    order = W.partitionBy("node").orderBy(F.desc("chosen"), F.xxhash64("node", "parent"))
    rows = rows.withColumn("i", F.row_number().over(order)).where(F.col("i") <= OTHERS + 1).withColumn("has", F.max("chosen").over(W.partitionBy("node"))).where("has = 1")
    got = rows.select("node", "parent", "chosen", "time", "common", "named", "other").toPandas().sort_values(["node", "parent"])
    return fit_weights(got["chosen"].to_numpy(float), got["node"].to_numpy(), got[["time", "common", "named", "other"]].to_numpy(float))


def reply_recall(turns: DataFrame) -> DataFrame:
    """One row (told, found): replies that say what they answer, and those whose parent is guessed without it."""
    target = turns.select("thread_id", F.col("reference").alias("reply_to"), F.col("node").alias("told"))
    told = turns.where(F.col("reply_to").isNotNull()).select("thread_id", "node", "reply_to").join(target, ["thread_id", "reply_to"]).where("told < node")
    return told.join(reply_links(turns, hidden=True), "node").agg(F.count(F.lit(1)).alias("told"), F.count_if(F.col("told") == F.col("parent")).alias("found"))


def link_trees(links: DataFrame) -> DataFrame:
    """``(node, parent, root)``: pointer jumping, which halves every path in each round; parents precede children."""
    state = durable(links.select("node", "parent", F.coalesce("parent", "node").alias("at")))
    done = None
    while True:
        up = state if done is None else done.unionByName(state)
        step = state.join(up.select(F.col("node").alias("at"), F.col("at").alias("next")), "at")
        step = durable(step.select("node", "parent", F.col("next").alias("at"), (F.col("next") == F.col("at")).alias("still")))
        ended = step.where("still").drop("still")
        done = ended if done is None else done.unionByName(ended)
        state = step.where(~F.col("still")).drop("still")
        if state.isEmpty():
            return done.withColumnRenamed("at", "root")


def spoken_turns(bundles: DataFrame, self_senders: DataFrame) -> DataFrame:
    """Turns of the kept threads in order; messages are parsed once and stored."""
    rows = stored(with_roles(messages(bundles), self_senders).drop("platform_ts"))
    return ordered(rows, kept_threads(rows))


def conversations(bundles: DataFrame, self_senders: DataFrame) -> DataFrame:
    """Turns of the kept threads: thread_id, turn_no, reference, role, content, and their link tree (parent, root)."""
    turns = spoken_turns(bundles, self_senders)
    trees = link_trees(reply_links(turns))
    return turns.join(trees, "node").select("thread_id", "turn_no", "reference", "role", "content", "ts", "node", "parent", "root")
