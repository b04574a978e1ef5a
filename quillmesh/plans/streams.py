"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

import uuid

from quillmesh.plans.registry import query
from quillmesh.runtime import scratch_dir, table
from quillmesh.streaming import events as S


@query("stm_event_windows", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stm_event_windows(spark, d):
    """Daily counts by kind from a stream over the table's files, with a checkpoint in the shared folder."""
    from pyspark.sql import functions as F

    schema = table(spark, d, "events").schema
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counted = S.windowed_counts(stream, "ts", "event_type")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out")

    counted.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("stm11_republish", "WITH {CUR} SELECT 'bundle.created' AS type, rid AS subject, CAST(count(*) AS BIGINT) AS n FROM cur WHERE namespace LIKE '%-plan' GROUP BY rid")
def stm11(spark, d):
    """Events of a namespace published again; the id makes a repeat recognisable."""
    from pyspark.sql import functions as F

    from quillmesh.plans.relational import current

    c = current(spark, d, "namespace").where(F.col("namespace").endswith("-plan"))
    e = S.envelope(c, "bundle.created", "backfill", "rid", {"rid": "rid"}, "updated_at")
    return e.groupBy("type", "subject").agg(F.count_distinct("id").alias("n"))


@query("stm07_breaker")
def stm07(spark, d):
    """A breaker per kind of event, run as a stream over the table's files: an event above 450 counts as a failure."""
    from pyspark.sql import functions as F

    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 16).parquet(f"{d}/events.parquet*")
    calls = stream.select(F.col("event_type").alias("service"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"), (F.col("value") < 450).alias("ok")).withColumn("at", F.col("at") / 1e6)
    S.run_once(S.breaker(calls), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").groupBy("service", "state").agg(F.count(F.lit(1)).alias("calls"), F.count("event").alias("events"))


@query(
    "stm04_retry_and_dead_letters",
    "SELECT CASE WHEN value <= 450 THEN 'done' WHEN event_id % 5 < 3 THEN 'again' ELSE 'dead' END AS fate, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1",
)
def stm04(spark, d):
    """Attempts parted into done, to be tried again, and dead letters after the third try."""
    from pyspark.sql import functions as F

    e = table(spark, d, "events").where("value is not null")
    tried = e.select(F.col("event_id").alias("id"), (F.col("event_id") % 5 + 0).alias("tries"), F.when(F.col("value") > 450, F.lit("too large")).alias("error"))
    done, again, dead = S.split_failures(tried)
    n = F.count(F.lit(1)).alias("n")
    return done.agg(n).select(F.lit("done").alias("fate"), "n").unionByName(again.agg(n).select(F.lit("again").alias("fate"), "n")).unionByName(dead.agg(n).select(F.lit("dead").alias("fate"), "n")).where("n > 0")


@query("stm05_embed_consumer")
def stm05(spark, d):
    """What the embedding consumer makes of all current bundles, but short messages: chunks with their vectors."""
    from pyspark.sql import functions as F

    from quillmesh.plans.relational import current
    from quillmesh.streaming import consumers

    b = current(spark, d, "namespace", "contents", "search_text")
    return consumers.chunk_and_embed(b.where("search_text is not null"), "hashing-64", context=True).select("rid", "chunk_index", F.length("chunk_text").alias("n"), F.size("embedding").alias("dimensions"))
