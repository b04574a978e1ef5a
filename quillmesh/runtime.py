"""Session, table access and durable cuts of lineage, shared by every operator."""

from __future__ import annotations

import hashlib
import os
import re
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "quillmesh", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tuned for; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, unless their Python finds it by itself.

    A local worker finds it beside the working directory, on PYTHONPATH or among the installed packages; on a cluster
    it is always sent.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quillmesh_sent", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(home)
    near = {os.path.abspath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p} | {p for p in sys.path if p.endswith("-packages")}
    sc._quillmesh_sent = True
    if root in near and re.fullmatch(r"local(\[.*\])?", sc.master):
        return
    path = os.path.join(sc._temp_dir, "quillmesh.zip")  # the context's own folder, from which it serves its files
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    whole = os.path.join(folder, f)
                    out.write(whole, os.path.relpath(whole, root))
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory; ``name.parquet`` may be a file or a folder of parts."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: ``spark.checkpoint.dir`` of the session; only in local mode, where there is one
    machine, an own one if that is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):  # a folder of this machine is no folder of the others
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "quillmesh-checkpoints"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that a lost executor costs a re-read, not a re-run.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` the files go when no frame refers to them any more.
    """
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a compressed table in the shared folder and read again; for wide rows of text, whose
    columns are then read one by one. The folder is removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def kept(inputs: DataFrame, name: str, make) -> DataFrame:
    """A table that is made once per state of its input files and then read: ``make()`` is written under a name with
    their paths, lengths and times to the shared folder, where later queries of the session find it."""
    spark = inputs.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    seen = []
    for f in sorted(inputs.inputFiles()):
        p = jvm.org.apache.hadoop.fs.Path(f)
        status = p.getFileSystem(conf).getFileStatus(p)
        seen.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    stamp = hashlib.sha256("\n".join(seen).encode()).hexdigest()[:16]
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{stamp}"
    done, folder = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    if not fs.exists(done):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        fs.deleteOnExit(folder)
    return spark.read.parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def latest(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """One row per ``key``: the one with the greatest ``order`` (null is least), ties by the greatest values.

    The pick is a max over a struct, so it combines on the map side and no group of versions is ever collected.
    Rows with a null key are left out.
    """
    rest = [c for c in columns if c not in (key, order)]
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_row"))
    out: list[Column] = [F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in columns]
    return picked.select(*out)
