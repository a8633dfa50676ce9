"""SQLite snapshots as a Spark source.

``snapshot_files`` reads whole snapshot files from any store that Spark reads, one
task per file. ``SqliteSnapshot`` is a Python data source for large files on a
path that all executors see: it splits each file by rowid ranges and evaluates
simple comparisons inside SQLite.
"""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

_OPS: dict[type, str] = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


#: Rows of one snapshot made here, which stays far below the 2 GB of a binary value.
ROWS_PER_FILE = 500_000
#: Bytes of a large snapshot that one task reads, and rows of one Arrow batch.
BYTES_PER_TASK, BATCH_ROWS = 64 << 20, 10_000


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def to_snapshots(v: DataFrame, table: str, columns: list[str], rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Rows as SQLite snapshots, databases (binary column ``content``) of at most ``rows_per_file`` rows; each partition makes as many as it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db, held = None, 0
        for batch in batches:
            for low in range(0, batch.num_rows, rows_per_file):
                part = batch.slice(low, rows_per_file)
                if db is not None and held + part.num_rows > rows_per_file:
                    yield _content(db)
                    db, held = None, 0
                if db is None:
                    db = sqlite3.connect(":memory:")
                    db.execute(f"CREATE TABLE {quoted(table)} ({', '.join(map(quoted, columns))})")
                db.executemany(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(columns))})", zip(*(part.column(c).to_pylist() for c in columns)))
                held += part.num_rows
        if db is not None:
            yield _content(db)

    return v.select(columns).mapInArrow(run, "content binary")


def _content(db: sqlite3.Connection) -> pa.RecordBatch:
    db.commit()
    return pa.RecordBatch.from_arrays([pa.array([db.serialize()], pa.binary())], ["content"])


def write_files(snapshots: DataFrame, folder: str) -> int:
    """Writes snapshots (binary column ``content``) as files in a folder that all executors mount, and returns how many. A task that runs again writes its
    files again under the same names."""
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = 0
        for batch in batches:
            for content in batch.column("content"):
                name = f"{folder}/snapshot-{TaskContext.get().partitionId():05d}-{number:05d}.db"
                with open(f"{name}.{os.getpid()}", "wb") as file:
                    file.write(content.as_py())
                os.replace(file.name, name)
                number += 1
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], ["n"])

    return snapshots.select("content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def scan_snapshots(snapshots: DataFrame, table: str, schema: str, where: dict[str, object] | None = None) -> DataFrame:
    """The rows of a table in snapshots with a binary column ``content``; equalities in ``where`` are evaluated inside SQLite."""
    fields = StructType.fromDDL(schema)
    names = [f.name for f in fields]
    clause = " AND ".join(f"{quoted(k)} = ?" for k in where or {})
    sql = f"SELECT {', '.join(map(quoted, names))} FROM {quoted(table)}" + (f" WHERE {clause}" if clause else "")
    values = list((where or {}).values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        for batch in batches:
            for content in batch.column("content").to_pylist():
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                cursor = db.execute(sql, values)
                while rows := cursor.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return snapshots.select("content").mapInArrow(run, schema)


def snapshot_files(spark: SparkSession, path: str, table: str, schema: str, where: dict[str, object] | None = None) -> DataFrame:
    return scan_snapshots(spark.read.format("binaryFile").load(path).where(F.col("length") > 0), table, schema, where)


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, partitions: int | None):
        self.path, self.table, self.schema, self.n, self.clauses = path, table, schema, partitions, []

    def partitions(self):
        files = sorted(glob.glob(f"{glob.escape(self.path)}/*.db")) if os.path.isdir(self.path) else [self.path]
        found = []
        for path in files:
            db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            db.close()
            if low is not None:
                n = self.n or max(4 if len(files) == 1 else 1, os.path.getsize(path) // BYTES_PER_TASK)
                step = max(1, -(-(high - low + 1) // n))
                found += [_Range(path, a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
        return found or [_Range(self.path, 0, -1)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition.high < partition.low:
            return
        db, arrow = sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True), to_arrow_schema(self.schema)
        more = "".join(f" AND {c}" for c, _ in self.clauses)
        sql = f"SELECT {', '.join(map(quoted, self.schema.names))} FROM {quoted(self.table)} WHERE rowid BETWEEN ? AND ?{more}"
        cursor = db.execute(sql, [partition.low, partition.high, *[v for _, v in self.clauses]])
        while rows := cursor.fetchmany(BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


class _PushingReader(_Reader):
    """Spark accepts this method only where pushdown is on."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            op = _OPS.get(type(f))
            if op and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)):
                self.clauses.append((f"{quoted(f.attribute[0])} {op} ?", f.value))
            else:
                yield f


class SqliteSnapshot(DataSource):
    """``spark.read.format("sqlite_snapshot").schema(...).option("path", ...).option("table", ...)``; path is a file or a folder of ``.db``
    files; option ``partitions``, of each file, defaults to one for every 64 MB, 4 at least for a single file. Rows come in Arrow batches.

    With option ``pushdown`` set to true, which needs ``spark.sql.python.filterPushdown.enabled``, simple comparisons are evaluated inside SQLite."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_snapshot"

    def reader(self, schema: StructType) -> DataSourceReader:
        reader = _PushingReader if self.options.get("pushdown", "false").lower() == "true" else _Reader
        return reader(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", "0")) or None)
