"""Tables of SQLite files as a data source: ``spark.read.format("sqlite")`` and ``spark.readStream.format("sqlite")``.

Options: path; query (a table or a SELECT in brackets); rowid, the number of growing order (default ``rowid``);
partitions for batches. Files are opened read-only, so a live one is never locked; each task opens its own.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


def _rows(options: dict, names: list[str], low: int | None, high: int | None) -> Iterator[tuple]:
    key = options.get("rowid", "rowid")
    where = " AND ".join(x for x in (f"{key} > {low}" if low is not None else "", f"{key} <= {high}" if high is not None else "") if x) or "1"
    con = sqlite3.connect(f"file:{options['path']}?mode=ro", uri=True)
    try:
        yield from con.execute(f"SELECT {', '.join(names)} FROM {options['query']} WHERE {where} ORDER BY {key}")
    finally:
        con.close()


def _span(options: dict) -> tuple[int, int]:
    key = options.get("rowid", "rowid")
    con = sqlite3.connect(f"file:{options['path']}?mode=ro", uri=True)
    try:
        low, high = con.execute(f"SELECT min({key}), max({key}) FROM {options['query']}").fetchone()
    finally:
        con.close()
    return (low or 0) - 1, high if high is not None else -1


class Span(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = dict(options), schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        low, high = _span(self.options)
        n = max(1, min(int(self.options.get("partitions", "4")), high - low))
        edges = [low + (high - low) * i // n for i in range(n + 1)]
        return [Span(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: Span) -> Iterator[tuple]:
        yield from _rows(self.options, self.names, partition.low, partition.high)


class SqliteStream(SimpleDataSourceStreamReader):
    """Rows behind the last seen number, at most ``batch`` at once."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = dict(options), schema.fieldNames()

    def initialOffset(self) -> dict:
        return {"seen": int(self.options.get("since", "-1"))}

    def read(self, start: dict):
        _, high = _span(self.options)
        stop = min(high, start["seen"] + int(self.options.get("batch", "1000")))
        if stop <= start["seen"]:
            return iter([]), start
        return iter(list(_rows(self.options, self.names, start["seen"], stop))), {"seen": stop}  # at most one batch

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return _rows(self.options, self.names, start["seen"], end["seen"])


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("give the schema of the columns to read")

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return SqliteStream(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
