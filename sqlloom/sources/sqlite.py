"""Tables of SQLite files as a Spark data source: ``spark.read.format("sqlite").option("path", ..).option("table", ..)``.

Scans are cut into ranges of the row id. Values come as SQLite holds them: dates are texts.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from sqlloom.session import ship_package


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str):
    """The type for a declared one, by SQLite's affinity rules."""
    d = (declared or "").upper()
    if "INT" in d:
        return LongType()
    if "BLOB" in d:
        return BinaryType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return DoubleType()
    return StringType()


def table_names(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return [r[0] for r in c.execute("select name from sqlite_master where type = 'table' and name <> 'sqlite_sequence' and sql is not null order by name")]


def create_statements(path: str) -> dict[str, str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return dict(c.execute("select name, sql from sqlite_master where type = 'table' and name <> 'sqlite_sequence' and sql is not null"))


def primary_key(path: str, table: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return [r[1] for r in sorted((r for r in c.execute(f"pragma table_info({_quoted(table)})") if r[5]), key=lambda r: r[5])]


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            rows = c.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        return StructType([StructField(r[1], spark_type(r[2]), True) for r in rows])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", 4)))


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, parts: int):
        self.path, self.table, self.schema, self.parts = path, table, schema, parts

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            try:
                low, high = c.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without row ids is read as one
                return [Range(0, -1)]
        if low is None:
            return [Range(1, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(x, min(high, x + step - 1)) for x in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        kinds = [f.dataType for f in self.schema.fields]
        casts = {LongType: int, DoubleType: float, StringType: str, BinaryType: bytes}
        where, args = ("", ()) if partition.high == -1 else (" where rowid between ? and ?", (partition.low, partition.high))
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            for row in c.execute(f"select {', '.join(_quoted(f.name) for f in self.schema.fields)} from {_quoted(self.table)}{where}", args):
                out = []
                for value, kind in zip(row, kinds):
                    try:
                        out.append(None if value is None else value if isinstance(value, casts[type(kind)]) else casts[type(kind)](value))
                    except (TypeError, ValueError):
                        out.append(None)
                yield tuple(out)


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions).load()


def register_database(spark: SparkSession, path: str) -> list[str]:
    """Views on all tables of a file: the tables that SQL texts see."""
    names = table_names(path)
    for name in names:
        read_table(spark, path, name).createOrReplaceTempView(f"`{name}`")
    return names


class Databases:
    """Makes one database's tables the current ones at a time: ``databases(spark, db_id)`` takes the views of the one before away."""

    def __init__(self, path_of: Callable[[str], str]):
        self.path_of, self.names = path_of, []

    def __call__(self, spark: SparkSession, db_id: str) -> None:
        for name in self.names:
            spark.catalog.dropTempView(name)
        path = self.path_of(db_id)
        self.names = register_database(spark, path) if os.path.exists(path) else []
