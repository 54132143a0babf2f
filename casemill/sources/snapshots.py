"""Tables in one folder that change together: a version names the files of every table, and a change is visible whole or not at all.

`versions/000000000012.json` lists, for each table, its schema and its files with the least and greatest key in them.  A change writes new
files first and then renames one new version into place; the rename fails where another change was faster.  So a crash between any
two steps leaves the version before it readable, a reader stays on the version it began with, and files that no version names are
only litter.  Updates copy: of a keyed table only the files that hold a touched key are written anew.

The folder needs a file system whose rename without overwriting is atomic, as HDFS has it; an object store needs one on top.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Touched keys are looked for in the files whose range they fall in; the list of ranges is broadcast up to this many files.
LISTED = 100_000


class Conflict(RuntimeError):
    """Another change was committed first."""


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The latest version; 0 before the first change."""
        fs, path = self._path("versions")
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def state(self, version: int | None = None) -> dict:
        """{"tables": {name: {"schema", "files"}}, "notes": {...}} of a version, the latest if none is given."""
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "notes": {}}
        fs, path = self._path(f"versions/{version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def files(self, name: str, *, version: int | None = None, keys: Iterable | None = None, state: dict | None = None) -> list[dict]:
        """The files of a table; with keys only those whose range holds one of them."""
        found = (state or self.state(version))["tables"].get(name, {"files": []})["files"]
        if keys is None:
            return found
        keys = sorted(set(keys))
        import bisect

        held = lambda f: (at := bisect.bisect_left(keys, f["low"])) < len(keys) and keys[at] <= f["high"]
        return [f for f in found if f["low"] is None or held(f)]

    def read(self, name: str, schema: str | StructType | None = None, *, version: int | None = None, key: str | None = None, keys: Iterable | None = None, files: list[dict] | None = None) -> DataFrame:
        """A table as it is in a version; with key and keys only the rows of those, from the files that may hold them.

        A table that is not there is empty, with the given schema.
        """
        state = self.state(version)
        table = state["tables"].get(name)
        kind = StructType.fromJson(table["schema"]) if table else schema
        keys = None if keys is None else list(keys)
        chosen = self.files(name, keys=keys, state=state) if files is None else files
        if not chosen:
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(kind).parquet(*[f"{self.folder}/{f['path']}" for f in chosen])
        return rows if keys is None else rows.filter(F.col(key).isin(keys))

    def begin(self) -> Change:
        return Change(self)

    def clear(self) -> None:
        """Removes everything; that there is nothing is no error."""
        fs, path = self._path("")
        fs.delete(path, True)

    def vacuum(self, *, versions: int = 1, older_than: float = 86_400.0) -> int:
        """Deletes all but the last versions, and the files that none of those name and that are older than so many seconds; how many went.

        A change in progress has files that no version names yet: older_than must exceed the longest change.
        """
        last = self.version()
        kept = {f["path"] for v in range(max(1, last - versions + 1), last + 1) for t in self.state(v)["tables"].values() for f in t["files"]}
        fs, data = self._path("data")
        gone = 0
        if fs.exists(data):
            base, each = str(data.toString()), fs.listFiles(data, True)
            while each.hasNext():
                status = each.next()
                full = str(status.getPath().toString())
                path = "data" + full[full.index("/data/") + 5 :] if base not in full else "data" + full.split(base, 1)[1]
                if path not in kept and status.getModificationTime() / 1000 < time.time() - older_than:
                    fs.delete(status.getPath(), False)
                    gone += 1
        for v in range(1, last - versions + 1):
            fs.delete(self._path(f"versions/{v:012d}.json")[1], False)
        return gone


class Change:
    """What becomes the next version; nothing of it is visible before commit()."""

    def __init__(self, tables: Tables):
        self.tables, self.spark = tables, tables.spark
        self.base = tables.version()
        self.state = tables.state(self.base)

    def read(self, name: str, schema: str | None = None, **options) -> DataFrame:
        """A table as this change has it so far."""
        files = self.tables.files(name, keys=options.get("keys"), state=self.state)
        table = self.state["tables"].get(name)
        return self.tables.read(name, StructType.fromJson(table["schema"]) if table else schema, files=files, version=self.base, key=options.get("key"), keys=options.get("keys"))

    def _entry(self, name: str, schema: StructType) -> dict:
        return self.state["tables"].setdefault(name, {"schema": json.loads(schema.json()), "files": []})

    def _written(self, name: str, df: DataFrame, key: str | None, by: str | None, extra: dict, options: dict) -> list[dict]:
        place = f"data/{name}/{uuid.uuid4().hex}"
        if key:
            df = df.repartitionByRange(key).sortWithinPartitions(key)
        writer = df.write.options(**{"compression": "zstd"} | options)
        (writer.partitionBy(by) if by else writer).parquet(f"{self.tables.folder}/{place}")
        fs, path = self.tables._path(place)
        each, found = fs.listFiles(path, True), []
        while each.hasNext():
            full = str(each.next().getPath().toString())
            if full.endswith(".parquet"):
                found.append(place + full.split(place, 1)[1])
        ranges = {}
        if by:
            ranges = {p: (v := int(p.split(f"/{by}=")[1].split("/")[0]), v) for p in found}
        elif key and found:
            rows = self.spark.read.schema(df.schema).parquet(*[f"{self.tables.folder}/{p}" for p in found])
            for r in rows.groupBy(F.input_file_name().alias("f")).agg(F.min(key).alias("low"), F.max(key).alias("high")).collect():  # a row a file
                ranges[place + r["f"].split(place, 1)[1]] = r["low"], r["high"]
            found = [p for p in found if p in ranges]
            if not all(isinstance(v, int | str) for pair in ranges.values() for v in pair):
                ranges = {}  # keys of other kinds, and null ones, have no noted range
        return [{"path": p, "low": ranges.get(p, (None, None))[0], "high": ranges.get(p, (None, None))[1], **extra} for p in sorted(found)]

    def append(self, name: str, df: DataFrame, *, key: str | None = None, by: str | None = None, extra: dict | None = None, options: dict | None = None) -> None:
        """Adds rows; key: sorted into files by it, whose ranges are noted; by: a file or more for each value of an integer column, which is not stored."""
        kept = StructType([f for f in df.schema.fields if f.name != by])
        self._entry(name, kept)["files"] += self._written(name, df, key, by, extra or {}, options or {})

    def replace(self, name: str, df: DataFrame, **options) -> None:
        """The table becomes these rows."""
        new = df.schema
        self.state["tables"].pop(name, None)
        self._entry(name, new)
        self.append(name, df, **options)

    def _touched(self, name: str, keys: DataFrame, key: str) -> list[dict]:
        """The files that hold a row of one of the keys (one column): those whose range does, then those that do."""
        files = self.tables.files(name, state=self.state)
        if not files:
            return []
        if len(files) <= LISTED and all(f["low"] is not None for f in files):
            kind = keys.schema[0].dataType.simpleString()
            ranges = self.spark.createDataFrame([(i, f["low"], f["high"]) for i, f in enumerate(files)], f"file int, low {kind}, high {kind}")
            near = keys.join(F.broadcast(ranges), F.col(key).between(F.col("low"), F.col("high")))  # at most LISTED ranges
            files = [files[r["file"]] for r in near.select("file").distinct().collect()]
        if not files:
            return []
        rows = self.read_files(name, files).select(key, F.input_file_name().alias("_file")).join(keys, key, "left_semi")
        held = {r["_file"].split("/data/")[-1] for r in rows.select("_file").distinct().collect()}
        return [f for f in files if f["path"].removeprefix("data/") in held]

    def read_files(self, name: str, files: list[dict]) -> DataFrame:
        return self.tables.read(name, StructType.fromJson(self.state["tables"][name]["schema"]), files=files, version=self.base)

    def _rewrite(self, name: str, key: str, touched: list[dict], rows: DataFrame) -> None:
        gone = {f["path"] for f in touched}
        table = self.state["tables"][name]
        new = self._written(name, rows, key, None, {}, {})
        table["files"] = [f for f in table["files"] if f["path"] not in gone] + new

    def merge(self, name: str, rows: DataFrame, key: str, fold: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
        """Puts rows, unique by key, in place of those of the same key; fold(old, rows) may combine old and new rows otherwise."""
        kept = rows.schema
        self._entry(name, kept)
        touched = self._touched(name, rows.select(key), key)
        if not touched:
            self._rewrite(name, key, [], fold(self.spark.createDataFrame([], kept), rows) if fold else rows)
            return
        old = self.read_files(name, touched)
        merged = fold(old, rows) if fold else old.join(rows.select(key), key, "left_anti").unionByName(rows)
        self._rewrite(name, key, touched, merged.select(*kept.names))

    def delete(self, name: str, keys: DataFrame, key: str) -> None:
        """Takes the rows of the keys out; where there are none, nothing is written."""
        if name not in self.state["tables"]:
            return
        keys = keys.select(key).distinct()
        if touched := self._touched(name, keys, key):
            self._rewrite(name, key, touched, self.read_files(name, touched).join(keys, key, "left_anti"))

    def note(self, key: str, value) -> None:
        """A value that is committed with the tables."""
        self.state["notes"][key] = value

    def commit(self) -> int:
        """Makes the change the next version, or raises Conflict."""
        jvm, version = self.spark._jvm, self.base + 1
        fs, final = self.tables._path(f"versions/{version:012d}.json")
        fs, part = self.tables._path(f"versions/{uuid.uuid4().hex}.tmp")
        out = fs.create(part, False)
        out.write(json.dumps(self.state).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(part, final, none)
        except Exception as e:
            fs.delete(part, False)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {version} is there already") from None
            raise
        return version
