"""SQLite tables as a Spark source and sink: row-id ranges in parallel, filters in SQLite, writes that are seen whole or not at all.

    spark.dataSource.register(SqliteSource)
    spark.read.format("casemill_sqlite").option("path", file).option("table", "cases").load()

The file lies where the driver and all executors reach it.  A write puts each task's rows into a file of its own beside it; the commit
takes all of them over in one transaction, and an abort, or a task that runs again, leaves the table as it was.
"""

from __future__ import annotations

import os
import re
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing, suppress
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

#: Rows of a range, about, and of a batch.
RANGE, BATCH = 100_000, 10_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def kind_of(declared: str):
    """The Spark type of a declared column type, by SQLite's rules of affinity."""
    declared = declared.upper()
    if "BOOL" in declared:
        return BooleanType()
    if "INT" in declared:
        return LongType()
    if any(w in declared for w in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return StringType()
    if not declared or "BLOB" in declared:
        return BinaryType()
    return DoubleType()


def declared_of(kind) -> str:
    name = kind.typeName()
    return {"long": "INTEGER", "integer": "INTEGER", "short": "INTEGER", "byte": "INTEGER", "boolean": "BOOLEAN", "double": "REAL", "float": "REAL", "binary": "BLOB"}.get(name, "TEXT")


def opened(path: str, *, write: bool = False) -> sqlite3.Connection:
    return sqlite3.connect(path, timeout=60) if write else sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=60)


@dataclass
class Range(ds.InputPartition):
    low: int
    high: int


@dataclass
class Part(ds.WriterCommitMessage):
    file: str | None
    rows: int


class Reader(ds.DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, size: int):
        self.path, self.table, self.schema, self.size, self.where, self.values = path, table, schema, size, [], []

    def pushFilters(self, filters: list) -> Iterator:
        """Comparisons with a value, IN, and null tests go to SQLite; all others stay with Spark."""
        for f in filters:
            column = quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if column and type(f) in _COMPARED and isinstance(value, int | float | str):
                self.where.append(f"{column} {_COMPARED[type(f)]} ?")
                self.values.append(value)
            elif column and isinstance(f, ds.In) and all(isinstance(v, int | float | str) for v in value) and len(value) <= 500:
                self.where.append(f"{column} IN ({', '.join('?' * len(value))})")
                self.values += list(value)
            elif column and isinstance(f, ds.IsNull | ds.IsNotNull):
                self.where.append(f"{column} IS {'NOT ' * isinstance(f, ds.IsNotNull)}NULL")
            else:
                yield f

    def partitions(self) -> list[Range]:
        with closing(opened(self.path)) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        return [] if low is None else [Range(a, min(a + self.size - 1, high)) for a in range(low, high + 1, self.size)]

    def read(self, partition: Range):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        names = ", ".join(quoted(f.name) for f in self.schema.fields)
        condition = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        flags = [isinstance(f.dataType, BooleanType) for f in self.schema.fields]
        with closing(opened(self.path)) as db:
            found = db.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE {condition}", [partition.low, partition.high, *self.values])
            while rows := found.fetchmany(BATCH):
                columns = [[None if v is None else bool(v) for v in c] if flag else list(c) for flag, c in zip(flags, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Writer(ds.DataSourceWriter):
    def __init__(self, path: str, table: str, schema: StructType, key: str | None, overwrite: bool):
        self.path, self.table, self.schema, self.key, self.overwrite, self.run = path, table, schema, key, overwrite, uuid.uuid4().hex

    def _create(self, db: sqlite3.Connection, table: str, key: str | None) -> None:
        columns = ", ".join(f"{quoted(f.name)} {declared_of(f.dataType)}{' PRIMARY KEY' if f.name == key else ''}" for f in self.schema.fields)
        db.execute(f"CREATE TABLE IF NOT EXISTS {table} ({columns})")

    def write(self, iterator) -> Part:
        file, n = f"{self.path}.{self.run}.{uuid.uuid4().hex}.part", 0
        plain = (type(None), bool, int, float, str, bytes)
        with closing(opened(file, write=True)) as db:
            self._create(db, "part", None)
            put = f"INSERT INTO part VALUES ({', '.join('?' * len(self.schema.fields))})"
            for row in iterator:
                db.execute(put, [v if isinstance(v, plain) else bytes(v) if isinstance(v, bytearray) else str(v) for v in row])
                n += 1
            db.commit()
        return Part(file, n)

    def commit(self, messages: list) -> None:
        """All tasks' rows in one transaction; rows of a known key replace it."""
        with closing(opened(self.path, write=True)) as db:
            db.isolation_level = None
            db.execute("BEGIN IMMEDIATE")
            try:
                self._create(db, quoted(self.table), self.key)
                if self.overwrite:
                    db.execute(f"DELETE FROM {quoted(self.table)}")
                names = ", ".join(quoted(f.name) for f in self.schema.fields)
                put = f"INSERT {'OR REPLACE ' * bool(self.key)}INTO {quoted(self.table)} ({names}) VALUES ({', '.join('?' * len(self.schema.fields))})"
                for m in messages:
                    if m is not None and m.rows:
                        with closing(opened(m.file)) as part:
                            db.executemany(put, part.execute("SELECT * FROM part"))
                db.execute("COMMIT")
            except BaseException:
                db.execute("ROLLBACK")
                raise
        self._clear(messages)

    def abort(self, messages: list) -> None:
        self._clear(messages)

    def _clear(self, messages: list) -> None:
        """Removes the parts of this run, those of attempts that nobody reported too."""
        folder = os.path.dirname(self.path) or "."
        for name in os.listdir(folder):
            if name.startswith(f"{os.path.basename(self.path)}.{self.run}."):
                with suppress(FileNotFoundError):
                    os.remove(os.path.join(folder, name))


class SqliteSource(ds.DataSource):
    """Options: path, table, rows (of a range), and for writes key (a column whose rows replace those of the same value)."""

    @classmethod
    def name(cls) -> str:
        return "casemill_sqlite"

    def _place(self) -> tuple[str, str]:
        return re.sub(r"^file:(//)?", "", self.options["path"]), self.options["table"]

    def schema(self) -> StructType:
        path, table = self._place()
        with closing(opened(path)) as db:
            found = db.execute(f"SELECT name, type FROM pragma_table_info({quoted(table)})").fetchall()
        if not found:
            raise ValueError(f"there is no table {table} in {path}")
        return StructType([StructField(n, kind_of(t)) for n, t in found])

    def reader(self, schema: StructType) -> Reader:
        return Reader(*self._place(), schema, int(self.options.get("rows", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(*self._place(), schema, self.options.get("key"), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session and lets filters reach it."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set(PUSHDOWN, "true")
