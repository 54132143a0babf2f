"""The engine as one object over a folder: ingest documents, retrieve for many queries at once, tell what is stored, clear it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import lexicons
from casemill.functions import text as T
from casemill.functions.encoding import BytePairs
from casemill.operators import chunking, embed, retrieval, stats, store
from casemill.operators.index import KeywordIndex
from casemill.sources.scratch import Passing, stored
from casemill.sources.snapshots import Change, Tables

CHUNK = "chunk_id string, case_reference string, chunk_index int, section string, text string, token_count int, year int, region string, case_type string"
VECTOR = "id string, embedding array<double>, case_reference string, region string, case_type string, section string, year int"
FETCH, FUSED, FINAL = 2, 20, 10
#: References that repeat within one ingest up to which they are broadcast, and only their rows are shuffled.
REPEATED = 10_000


class Engine:
    """Chunks, vectors and a keyword index in one folder that the cluster shares, changed together.

    `where` filters reach the semantic branch alone, as in the reference, unless scope="both".  An encoder counts chunks' tokens by its
    vocabulary.  A ledger, the URI of a shared folder for this embedder alone, keeps each text's vector: a repeated ingest pays for none twice.
    """

    def __init__(
        self, spark: SparkSession, folder: str, embedder: embed.Embedder | None = None, *, chunk_tokens: int = chunking.CHUNK_TOKENS, overlap: int = chunking.OVERLAP_TOKENS,
        issues: Mapping = lexicons.ISSUES, evidence: Mapping = lexicons.EVIDENCE, as_of_year: int = 2024, lite: bool = False,
        encoder: BytePairs | None = None, ledger: str | None = None,
    ):
        self.spark, self.folder, self.embedder = spark, folder.rstrip("/"), embedder or embed.HashedWords(64)
        self.chunk_tokens, self.overlap, self.issues, self.evidence, self.as_of_year = chunk_tokens, overlap, dict(issues), dict(evidence), as_of_year
        self.encoder, self.ledger = encoder, ledger
        self.tables = Tables(spark, self.folder)
        self.index = KeywordIndex(spark, self.folder, lite=lite, id_type="string", tables=self.tables, texts=("chunks", "chunk_id", "text"))

    def chunks(self) -> DataFrame:
        """All stored chunks; none before the first ingest."""
        return self.tables.read("chunks", CHUNK)

    def vectors(self) -> DataFrame:
        """(id, embedding, and the metadata that filters name) of all stored chunks."""
        return self.tables.read("vectors", VECTOR)

    def ingest(self, docs: DataFrame, *, skip_existing: bool = True, pii: bool = True, batch: tuple[str, int] | None = None) -> DataFrame:
        """Cleans, chunks, embeds and indexes docs (case_reference, text, year, region, case_type); returns the counters as one row.

        A document whose cleaned text is blank is skipped; one that has an error column which is not null has failed.  Of rows that
        repeat a reference the greatest by year, region, case type and text is taken.  Chunks whose id is stored already are left out,
        or with skip_existing=False replaced, in all tables alike.  An empty frame adds nothing.

        Chunks, vectors, postings and the batch's number become visible together: a call that fails anywhere leaves the engine as it
        was, and may be repeated.  batch (a source and its number) that is not greater than the source's last one changes nothing.
        """
        change = self.tables.begin()
        done = change.state["notes"].get("batches", {})
        if batch and done.get(batch[0], -1) >= batch[1]:
            docs = docs.limit(0)
        bad = F.col("error").isNotNull() if "error" in docs.columns else F.lit(False)
        rows = docs.select("case_reference", "year", "region", "case_type", F.when(~bad, T.clean(F.col("text"), pii=pii, preserve_paragraphs=True)).alias("text"), bad.alias("failed"))
        with Passing(self.spark) as passing:
            rows = passing.stored(rows.withColumn("status", F.when(F.col("failed"), "failed").when(F.length(F.trim("text")) > 0, "processed").otherwise("skipped")), "ingest")
            good = self._taken(rows.filter("status = 'processed' and case_reference is not null"))
            made = chunking.chunks(good, self.chunk_tokens, self.overlap, "case_reference", encoder=self.encoder, keep=("year", "region", "case_type")).withColumnRenamed("id", "case_reference")
            if skip_existing and self.tables.files("chunks", state=change.state):
                made = store.unseen(made, change.read("chunks", CHUNK), "chunk_id")
            made = passing.stored(made.select(*[c.split()[0] for c in CHUNK.split(", ")]), "chunks")
            counts = rows.select("status", F.lit(0).cast("long").alias("chunks")).unionByName(made.agg(F.count("*").alias("chunks")).select(F.lit("chunks").alias("status"), "chunks"))
            counts = stats.ingestion(counts).withColumn("total", F.col("total") - 1)
            counts = self.spark.createDataFrame(counts.collect(), counts.schema)  # one row
            if batch and done.get(batch[0], -1) < batch[1]:
                change.note("batches", {**done, batch[0]: batch[1]})
            elif made.isEmpty():
                return counts
            if not made.isEmpty():
                if not skip_existing:
                    self._forget(change, good.select("case_reference"))
                passing.drop("ingest")
                before = len(self.tables.files("chunks", state=change.state))
                change.append("chunks", made, key="case_reference")
                made = change.read_files("chunks", change.state["tables"]["chunks"]["files"][before:])
                passing.drop("chunks")
                vectors = embed.embed(made, self.embedder, "chunk_id", "text", ledger=self.ledger)
                about = made.select(F.col("chunk_id").alias("id"), "case_reference", "region", "case_type", "section", "year")
                change.append("vectors", embed.with_vectors(vectors, about).select(*[c.split()[0] for c in VECTOR.split(", ")]), key="case_reference")
                self.index.add(change, made, id_col="chunk_id", ref_col="case_reference")
            change.commit()
        return counts

    def _taken(self, rows: DataFrame) -> DataFrame:
        """Of rows that repeat a reference the greatest; the texts of the others are not shuffled unless very many repeat."""
        meta = F.struct(F.col("year").cast("int").alias("year"), "region", "case_type", "text")
        one = lambda some: some.groupBy("case_reference").agg(F.max(meta).alias("d")).select("case_reference", "d.*")
        rows = rows.select("case_reference", "year", "region", "case_type", "text")
        twice = stored(rows.groupBy("case_reference").count().filter("count > 1").select("case_reference"), "twice")
        if (n := twice.count()) > REPEATED:
            return one(rows)
        alone = rows.select("case_reference", meta.alias("d")).select("case_reference", "d.*")
        if not n:
            return alone
        twice = F.broadcast(twice)  # at most REPEATED references
        return alone.join(twice, "case_reference", "left_anti").unionByName(one(rows.join(twice, "case_reference", "left_semi")))

    def _forget(self, change: Change, cases: DataFrame) -> None:
        """Takes the cases (case_reference) out of all tables, as part of a change."""
        cases = stored(cases.select("case_reference").distinct(), "forgotten")
        gone = change.read("chunks", CHUNK).join(cases, "case_reference", "left_semi").select(F.col("chunk_id").alias("id"))
        if gone.isEmpty():
            return
        self.index.remove(change, gone)
        for name in ("chunks", "vectors"):
            change.delete(name, cases, "case_reference")

    def delete(self, cases: DataFrame) -> None:
        """Takes the cases (case_reference) out of chunks, vectors and index at once; those that are not there are no error."""
        change = self.tables.begin()
        self._forget(change, cases)
        change.commit()

    def ingest_stream(self, docs: DataFrame, checkpoint: str, source: str, **options):
        """Starts a query that ingests each micro-batch of a stream once: a batch that is replayed after a failure is known by its number."""

        def once(rows: DataFrame, number: int) -> None:
            self.ingest(rows, batch=(source, number), **options)

        return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(once)

    def ingest_one(self, case_reference: str, text: str, *, year: int, region: str = "", case_type: str = "") -> DataFrame:
        """One document, in place of what is stored of its case; it costs work by its own terms, and statistics are those of old and new chunks."""
        row = self.spark.createDataFrame([(case_reference, text, year, region, case_type)], "case_reference string, text string, year int, region string, case_type string")
        return self.ingest(row, skip_existing=False)

    def retrieve(self, queries: DataFrame, *, k: int = FINAL, where: Mapping | None = None, scope: str = "semantic") -> DataFrame:
        """(query_id, id, case_reference, text, ..., rerank_score, rerank_rank, explanation) for stated queries (query_id, query, query_region)."""
        vectors = self.vectors()
        asked = embed.embed(queries, self.embedder, "query_id", "query").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
        semantic = retrieval.cosine_top(vectors, stored(asked, "asked"), FETCH * FUSED, filters=dict(where) if where else None, id_col="id")
        within = vectors.filter(retrieval.where(dict(where))) if where and scope == "both" else None
        fused = retrieval.fuse(semantic, self.index.search(queries, FETCH * FUSED, within=within), FUSED)
        texts = self.chunks().select(F.col("chunk_id").alias("id"), "text", "case_reference", "section", "year", "region")
        rows = retrieval.enrich(fused, texts).join(queries.select("query_id", "query", "query_region"), "query_id")
        return retrieval.rerank(rows, k, as_of_year=self.as_of_year, issues=self.issues, evidence=self.evidence)

    def confidence(self, results: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, n_results, confidence, is_uncertain, reason) of what retrieve() gave."""
        return retrieval.confidence(results, queries, results, built=self.index.is_built())

    def get_stats(self) -> DataFrame:
        """One row of the collection's statistics and the index's."""
        whole = stats.collection(self.chunks())
        if not self.index.is_built():
            return whole.withColumns({"total_tokens": F.lit(0).cast("long"), "avg_tokens": F.lit(0.0)})
        return whole.crossJoin(self.index.stats().select("total_tokens", "avg_tokens"))  # one row each

    def clear_index(self) -> None:
        """Removes everything in the folder; that there is nothing is no error."""
        self.tables.clear()
