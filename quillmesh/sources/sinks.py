"""Writing tables: partitioned folders put in place at once, JSON lines, vectors by configuration, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _move(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"can't rename {a} to {b}")


def replace_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Writes beside the target, then swaps folders; readers see the old or the new table, never half of one.

    The frame may have been read from the target itself. If the second rename fails the old table is put back, and it
    is deleted only when the new one stands in its place; ``table_path`` finds the old one in between.
    """
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(new)
    fs, target = _fs(spark, path)
    _, n = _fs(spark, new)
    _, o = _fs(spark, old)
    if fs.exists(target):
        fs.delete(o, True)
        _move(fs, target, o)
    try:
        _move(fs, n, target)
    except OSError:
        if fs.exists(o) and not fs.exists(target):
            _move(fs, o, target)
        raise
    fs.delete(o, True)


def table_path(spark: SparkSession, path: str) -> str | None:
    """Where the table stands: at its path, or beside it if a swap was broken off; None if there is none."""
    for place in (path, f"{path}.old"):
        fs, p = _fs(spark, place)
        if fs.exists(p):
            return place
    return None


def replace_parts(df: DataFrame, path: str, part: str) -> None:
    """Replaces only those partitions (folders of the column ``part``) of a table that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def register_config(configs: DataFrame, chunks: DataFrame | None, config: dict) -> tuple[DataFrame, DataFrame | None]:
    """The table of embedding configurations with one put in or replaced by config_id, and the chunks without those of
    a configuration whose dimensions have changed (they have to be made again)."""
    new = configs.sparkSession.createDataFrame([tuple(config.get(f.name) for f in configs.schema.fields)], configs.schema)
    old = configs.where(F.col("config_id") == config["config_id"]).select("dimensions")
    out = configs.where(F.col("config_id") != config["config_id"]).unionByName(new)
    if chunks is None:
        return out, None
    changed = old.where(F.col("dimensions") != config["dimensions"]).select(F.lit(config["config_id"]).alias("config_id")).distinct()
    return out, chunks.join(F.broadcast(changed), "config_id", "left_anti")  # at most one row


def save_state(spark: SparkSession, path: str, state: dict[str, str]) -> None:
    """Small state of a run (high-water marks, hashes) as a table of keys and values, replaced at once."""
    replace_table(spark.createDataFrame(sorted(state.items()), "key string, value string").coalesce(1), path)


def load_state(spark: SparkSession, path: str) -> dict[str, str]:
    """The saved state; empty if there is none."""
    place = table_path(spark, path)
    return {r.key: r.value for r in spark.read.parquet(place).collect()} if place else {}


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_bucketed(df: DataFrame, table: str, keys: tuple[str, ...], buckets: int = 64) -> None:
    """A table bucketed and sorted on its join keys, so later joins on them need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def analyse(spark: SparkSession, table: str, columns: tuple[str, ...] = ()) -> None:
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(columns)}" if columns else ""))
