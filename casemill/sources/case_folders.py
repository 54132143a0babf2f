"""A folder a case: `{category}-cases/{year}/{reference}/` with decision.html, decision.pdf and metadata.json, written in parallel.

    write_cases(cases, "hdfs://host/cases")
    read_cases(spark, "hdfs://host/cases", "case_reference string, year int, category string, title string")

A task lays a case out below `_staging-<run>`, which no Spark reader lists, and renames its folder into place: a new case is there whole or
not at all, whatever fails.  Of a case that stands, each file is renamed over its older self, metadata.json last, and a file that the
new rows lack stays.  As each case counts by itself, those that were written stay when the job fails later; a task or a job that runs
again ends with the same files.  The driver hears two numbers a task and removes the staging.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casemill.operators.ledger import output_folder

# The files of a case.
PAGE, PDF, METADATA = "decision.html", "decision.pdf", "metadata.json"
#: Of a name longer than LONG, so much stays, and the rest is told by a hash; a file system takes 255 bytes.
LONG, KEPT = 200, 150
#: Cases of a batch that is read, names of one that is listed, and tasks a core that open them.
FILES, NAMES, TASKS = 32, 10_000, 4


def safe_name(reference: Column) -> Column:
    """A folder's name for any reference, another one for each: what is no letter, digit, `.`, `-`, `_` or `*` is escaped, and so is a
    first `.` or `_`, which would hide the folder from Spark."""
    name = F.regexp_replace(F.regexp_replace(F.url_encode(reference), r"^\.", "%2E"), "^_", "%5F")
    return F.when(F.length(name) > LONG, F.concat(F.substring(name, 1, KEPT), F.lit("~"), F.substring(F.sha2(reference, 256), 1, 32))).otherwise(name)


def case_files(cases: DataFrame) -> DataFrame:
    """(folder, html, pdf, metadata), one row a folder: what write_cases() puts there.

    cases has case_reference, year, category, html and pdf (binary); all other columns go into metadata.json beside the first three.  A row
    without a reference, or with neither page nor PDF, is no case; an empty page or PDF is none, as Spark
    reads no empty files.  A year that is null is `unknown`.  Of rows with one folder the
    greatest by metadata, page and PDF is taken.
    """
    year = F.coalesce(F.col("year").cast("string"), F.lit("unknown"))
    fields = [c for c in cases.columns if c not in ("html", "pdf")]
    about = F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields]), {"ignoreNullFields": "false"})
    rows = cases.withColumns({"html": F.when(F.length("html") > 0, F.col("html")), "pdf": F.when(F.length("pdf") > 0, F.col("pdf"))})
    rows = rows.filter((F.col("case_reference") != "") & (F.col("html").isNotNull() | F.col("pdf").isNotNull()))
    rows = rows.select(output_folder(F.col("category"), year, safe_name(F.col("case_reference"))).alias("folder"), F.struct(about.alias("metadata"), "html", "pdf").alias("d"))
    return rows.groupBy("folder").agg(F.max("d").alias("d")).select("folder", "d.html", "d.pdf", "d.metadata")


def write_cases(cases: DataFrame, root: str) -> None:
    """Writes case_files() below root, the URI of a place that driver and executors share; files of a case that is there already are replaced."""
    cases.sparkSession.dataSource.register(CaseFolders)
    case_files(cases).write.format(CaseFolders.name()).option("path", root).mode("append").save()


def read_cases(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """folder (below root), the fields of schema from metadata.json, html and pdf of every case below root.

    The driver lists the folders of years alone.  A task lists the cases of a year, which a file system gives at once, so the names of one
    year's folder must fit a task; the names are dealt, and a task opens the files of its cases beside each other.  A folder without
    metadata, or with none in it, is no case.
    """
    from pyarrow import fs

    def inside(system, at: str) -> list:
        return [i for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.Directory and not i.base_name.startswith((".", "_"))]

    system, place = fs.FileSystem.from_uri(root)
    kinds = [i.base_name for i in inside(system, place) if re.fullmatch("[a-z]+-cases", i.base_name)]
    years = sorted(f"{kind}/{i.base_name}" for kind in kinds for i in inside(system, f"{place.rstrip('/')}/{kind}"))

    def listed(batches):
        import pyarrow as pa

        system, place = fs.FileSystem.from_uri(root)
        for year in (y for b in batches for y in b.column(0).to_pylist()):
            names = [f"{year}/{i.base_name}" for i in inside(system, f"{place.rstrip('/')}/{year}")]
            for k in range(0, len(names), NAMES):
                yield pa.RecordBatch.from_arrays([pa.array(names[k : k + NAMES], pa.string())], ["folder"])

    def opened(batches):
        import pyarrow as pa

        system, place = fs.FileSystem.from_uri(root)

        def content(at: str, name: str) -> bytes | None:
            try:
                with system.open_input_stream(f"{place.rstrip('/')}/{at}/{name}") as f:
                    return f.read()
            except FileNotFoundError:
                return None

        for b in batches:
            for k in range(0, b.num_rows, FILES):
                found = [(n, about, content(n, PAGE), content(n, PDF)) for n in b.column(0).slice(k, FILES).to_pylist() if (about := content(n, METADATA))]
                kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)], ["folder", "m", "html", "pdf"])

    tasks = spark.sparkContext.defaultParallelism * TASKS
    names = spark.createDataFrame([(y,) for y in years], "year string").mapInArrow(listed, "folder string").repartition(tasks, "folder")
    cases = names.mapInArrow(opened, "folder string, m binary, html binary, pdf binary")
    return cases.select("folder", F.from_json(F.col("m").cast("string"), schema).alias("m"), F.col("html").cast("string").alias("html"), "pdf").select("folder", "m.*", "html", "pdf")


@dataclass
class Written(ds.WriterCommitMessage):
    cases: int
    size: int


class Writer(ds.DataSourceWriter):
    def __init__(self, root: str, schema: StructType):
        if set(schema.names) != {"folder", "html", "pdf", "metadata"}:
            raise ValueError(f"a case has folder, html, pdf and metadata, not {schema.names}")
        self.root, self.run = root, uuid.uuid4().hex

    def _place(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.root)
        return system, root.rstrip("/"), f"{root.rstrip('/')}/_staging-{self.run}"

    def write(self, iterator: Iterator) -> Written:
        system, root, staging = self._place()
        own, made, size, parents = f"{staging}/{uuid.uuid4().hex}", 0, 0, set()
        for row in iterator:
            at = f"{own}/{made}"
            system.create_dir(at, recursive=True)
            for name, data in ((PAGE, row["html"]), (PDF, row["pdf"]), (METADATA, row["metadata"])):
                if data is not None:
                    data = data.encode() if isinstance(data, str) else bytes(data)
                    with system.open_output_stream(f"{at}/{name}") as f:
                        f.write(data)
                    size += len(data)
            goal = f"{root}/{row['folder']}"
            parent = goal.rsplit("/", 1)[0]
            if parent not in parents:
                system.create_dir(parent, recursive=True)
                parents.add(parent)
            place(system, at, goal)
            made += 1
        return Written(made, size)

    def commit(self, messages: list) -> None:
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        system, _, staging = self._place()
        with suppress(FileNotFoundError):
            system.delete_dir(staging)


def place(system, new: str, goal: str) -> None:
    """Renames folder new to goal; where goal stands, or another attempt's comes between, new's files are renamed over those in it.

    A folder is never moved out of the way: were the job ended just then, the case would be gone.
    """
    from pyarrow import fs

    if system.get_file_info(goal).type == fs.FileType.NotFound:
        try:
            return system.move(new, goal)
        except OSError:
            if system.get_file_info(goal).type == fs.FileType.NotFound:
                raise
    for name in (PAGE, PDF, METADATA):
        if system.get_file_info(f"{new}/{name}").type != fs.FileType.NotFound:
            system.move(f"{new}/{name}", f"{goal}/{name}")


class CaseFolders(ds.DataSource):
    """A sink for case_files(); option path: the URI of the root."""

    @classmethod
    def name(cls) -> str:
        return "casemill_cases"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("cases are renewed one by one; overwrite would have to remove all others")
        return Writer(self.options["path"], schema)
