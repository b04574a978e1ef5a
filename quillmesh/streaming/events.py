"""Change events as streams: sources, windows, retry with a dead-letter table, and a breaker per service."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

#: The envelope of an event; every field is text on the wire.
ENVELOPE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "type", "source", "subject", "data", "time")])
MOST_TRIES = 3
FAILURES_TO_OPEN = 3
OPEN_SECONDS = 30.0


def envelope(rows: DataFrame, kind: str, source: str, subject: str, data: dict[str, str], time: str) -> DataFrame:
    """Rows as events; the id is a hash of kind, subject and time, so a repeated publication is the same event."""
    body = F.to_json(F.struct(*[F.col(c).cast("string").alias(n) for n, c in data.items()]))
    when = F.col(time).cast("string")
    return rows.select(F.sha2(F.concat_ws("|", F.lit(kind), F.col(subject), when), 256).alias("id"), F.lit(kind).alias("type"), F.lit(source).alias("source"), F.col(subject).alias("subject"), body.alias("data"), when.alias("time"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """New JSON files of a folder as a stream; lines that don't parse come as nulls and are left out."""
    return spark.readStream.schema(ENVELOPE).json(path).where("id is not null")


def windowed_counts(events: DataFrame, time: str, kind: str, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and kind; works on streams and on tables alike."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, length).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, then stop; run again, only what has come since."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def run_batches(stream: DataFrame, handle, checkpoint: str) -> None:
    """Like ``run_once`` with a function of (batch, number), e.g. a merge into a table."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def split_failures(tried: DataFrame, most: int = MOST_TRIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Attempts (id, tries, error) as (done, to be tried again, dead letters)."""
    failed = F.col("error").isNotNull()
    return tried.where(~failed), tried.where(failed & (F.col("tries") < most)), tried.where(failed & (F.col("tries") >= most))


#: Seconds after which an event that isn't acknowledged is given out again, and events of one pull.
IDLE_SECONDS, PULL = 5.0, 10


def pull(events: DataFrame, pending: DataFrame, now: float, most: int = PULL) -> DataFrame:
    """``(id, tries)`` that a consumer of a group gets next: first what was given out but not acknowledged for
    ``IDLE_SECONDS`` and has tries left, then new events, oldest first, ``most`` in all.

    ``events`` has (id, at), ``pending`` the group's (id, tries, given, acked).
    """
    again = pending.where(~F.col("acked") & (F.lit(now) - F.col("given") >= IDLE_SECONDS) & (F.col("tries") < MOST_TRIES)).join(events, "id").select("id", "at", (F.col("tries") + 1).alias("tries"), F.lit(0).alias("turn"))
    fresh = events.join(pending.select("id"), "id", "left_anti").select("id", "at", F.lit(1).alias("tries"), F.lit(1).alias("turn"))
    return again.unionByName(fresh).orderBy("turn", "at", "id").limit(most).select("id", "tries")


def dead_letters(pending: DataFrame, now: float) -> DataFrame:
    """Events whose last try has run out without an acknowledgement."""
    return pending.where(~F.col("acked") & (F.col("tries") >= MOST_TRIES) & (F.lit(now) - F.col("given") >= IDLE_SECONDS)).select("id", "tries")


def acknowledge(pending: DataFrame, given: DataFrame, done: DataFrame, now: float) -> DataFrame:
    """The group's state after a pull (id, tries) of which ``done`` (id) has been worked off."""
    new = given.select("id", F.col("tries").alias("_tries"), F.lit(now).alias("_given"))
    ok = done.select("id", F.lit(True).alias("_ok")).distinct()
    both = pending.join(new, "id", "full_outer").join(ok, "id", "left")
    return both.select("id", F.coalesce("_tries", "tries").alias("tries"), F.coalesce("_given", "given").alias("given"), (F.coalesce("acked", F.lit(False)) | F.coalesce("_ok", F.lit(False))).alias("acked"))


def group_lag(events: DataFrame, pending: DataFrame, *by: str) -> DataFrame:
    """Per group of events: how many there are, how many are given out without an acknowledgement, how many are new."""
    state = pending.select("id", "acked")
    rows = events.join(state, "id", "left")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("length"), F.count_if(~F.col("acked")).alias("pending"), F.count_if(F.col("acked").isNull()).alias("undelivered"))


_BREAKER_OUT = "service string, at double, state string, event string"
_BREAKER_STATE = "state string, failures int, opened double"


def breaker_step(state: str, failures: int, opened: float, at: float, ok: bool) -> tuple[str, int, float, str | None]:
    """One call outcome: closed opens after three failures on end; half open after 30 s; a probe then decides."""
    event = None
    if state == "open" and at - opened >= OPEN_SECONDS:
        state = "half_open"
    if state == "open":
        return state, failures, opened, None
    if ok:
        return "closed", 0, 0.0, event
    failures += 1
    if state == "half_open":
        return "open", failures, at, "service.down"
    if failures >= FAILURES_TO_OPEN:
        return "open", failures, at, "service.degraded"
    return "closed", failures, 0.0, None


def breaker(outcomes: DataFrame) -> DataFrame:
    """State after each call outcome (service, at in seconds, ok); a stream keyed by service.

    A state machine needs its service's outcomes in order, so those of one micro-batch are sorted in memory; the rate
    options of the source (files or rows per trigger) bound them.
    """

    def step(key, batches, held):
        state, failures, opened = held.get if held.exists else ("closed", 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = []
        for at, ok in zip(rows["at"], rows["ok"], strict=True):
            state, failures, opened, event = breaker_step(state, failures, opened, float(at), bool(ok))
            out.append((key[0], float(at), state, event))
        held.update((state, failures, opened))
        yield pd.DataFrame(out, columns=["service", "at", "state", "event"])

    return outcomes.groupBy("service").applyInPandasWithState(step, _BREAKER_OUT, _BREAKER_STATE, "append", GroupStateTimeout.NoTimeout)
