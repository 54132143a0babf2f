"""Readers of the engine's inputs: raw files, JSON folders, companion metadata, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import records

# What may be uploaded.
MIME_TYPES = ("application/pdf", "image/jpeg", "image/png", "image/heic")


def binary_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", as_of_year: int | None = None) -> DataFrame:
    """path, modificationTime, length, content of all files below folder, with case_reference, category and (given as_of_year) year from the path.

    A folder that is not there is an error; one without such files gives no rows, which scan_status() tells apart.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    rows = rows.withColumns({"case_reference": records.reference_from_path(F.col("path")), "category": records.category_from_path(F.col("path"))})
    return rows if as_of_year is None else rows.withColumn("year", records.year_from_path(F.col("path"), as_of_year))


def scan_status(files: DataFrame) -> DataFrame:
    """One row: files, and status `ok` or `no_pdfs_found`."""
    return files.agg(F.count("*").alias("files")).withColumn("status", F.when(F.col("files") > 0, "ok").otherwise("no_pdfs_found"))


def extract_text(files: DataFrame, reader) -> DataFrame:
    """path, text, page_count, title, author, creation_date, error.

    reader(bytes) gives a text, or (pages, metadata): blank pages are skipped and the others joined by an empty line.  An empty text
    or a failure becomes an error, not a lost row.
    """
    facts = ("title", "author", "creation_date")

    def run(batches):
        import pyarrow as pa

        names = ["path", "text", "page_count", *facts, "error"]
        for b in batches:
            out = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text, pages, found, error = None, None, {}, None
                try:
                    text = reader(data)
                    if not isinstance(text, str):
                        pages, found = text
                        text, pages = "\n\n".join(p for p in pages if p and p.strip()), len(pages)
                except Exception as problem:  # a reader may raise anything; the row keeps what it said
                    text, error = None, f"{type(problem).__name__}: {problem}"
                out.append((path, text, pages, *(found.get(f) for f in facts), error or (None if text and text.strip() else "no text")))
            kinds = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * len(facts), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, "path string, text string, page_count int, title string, author string, creation_date string, error string")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def companion_metadata(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(folder, and the fields of schema) of every metadata.json below folder; one that cannot be read is left out."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").text(folder)
    rows = rows.select(parent(F.col("_metadata.file_path")).alias("folder"), "value").filter(F.get_json_object("value", "$").isNotNull())
    return rows.select("folder", F.from_json("value", schema).alias("m")).select("folder", "m.*")


def with_metadata(docs: DataFrame, metadata: DataFrame) -> DataFrame:
    """docs (path and their own fields) with the non-null values of the metadata beside them; what both lack stays null."""
    fields = [c for c in metadata.columns if c != "folder"]
    new = metadata.select(F.col("folder").alias("_folder"), *[F.col(c).alias(f"_{c}") for c in fields])
    rows = docs.join(new, parent(F.regexp_replace("path", "^file:/+", "file:///")) == F.regexp_replace("_folder", "^file:/+", "file:///"), "left")
    added = [F.col(f"_{c}").alias(c) for c in fields if c not in docs.columns]
    return rows.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in docs.columns], *added)


def json_folder(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One record a file; unreadable files are left out."""
    rows = spark.read.option("wholetext", True).text(glob).filter(F.get_json_object("value", "$").isNotNull())
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def stored_chunks(rows: DataFrame) -> DataFrame:
    """Chunks as a vector store gives them back: a year that is no number is 2020, blank regions and types are null, the rest has its defaults."""
    has = lambda c, default: F.coalesce(F.col(c), F.lit(default)).alias(c)
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    year = F.coalesce(F.col("year").cast("string").try_cast("int"), F.lit(2020)).alias("year")
    return rows.select("chunk_id", has("case_reference", ""), has("text", ""), has("section_type", "unknown"), has("chunk_index", 0), year, blank("region"), blank("case_type"), has("token_count", 0))


def evidence_id(path: Column) -> Column:
    """Eight hexadecimal places that follow from where a file is stored."""
    return F.substring(F.sha2(path, 256), 1, 8)


def allowed_uploads(files: DataFrame, column: str = "mime") -> DataFrame:
    """Files of a kind that may be uploaded, with their evidence_id."""
    return files.filter(F.lower(column).isin(*MIME_TYPES)).withColumn("evidence_id", evidence_id(F.col("path")))


def uploads_processed(files: DataFrame) -> DataFrame:
    """files (path, mime, description, text): evidence type and description; images have a placeholder for text."""
    from casemill.functions.lexicons import evidence_type
    from casemill.functions.text import issue_title, snippet

    body = F.when(F.lower("mime").startswith("image/"), F.lit("[image]")).otherwise(F.col("text"))
    kind = evidence_type(F.concat_ws(" ", "path", "description", body))
    return files.withColumn("evidence_type", kind).withColumn("evidence_text", F.concat(issue_title(kind), F.lit(": "), snippet(F.regexp_replace(F.coalesce(body, F.lit("")), "\n", " "), 100)))
