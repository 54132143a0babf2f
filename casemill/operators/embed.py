"""Embeddings behind a provider, their cost, and the vector table."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.operators import calls

# Dimensions and prices per million tokens by model; an unknown model costs as the small one.
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}
PRICES = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13, "text-embedding-ada-002": 0.10}


class Embedder(Protocol):
    dims: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashedWords:
    """A deterministic stand-in for a model: words are hashed to dimensions, counted, and scaled to length one."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        import numpy as np

        out = np.zeros((len(texts), self.dims))
        place = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dims for w in {w for t in texts for w in (t or "").lower().split()}}
        for row, text in zip(out, texts, strict=True):
            np.add.at(row, [place[w] for w in (text or "").lower().split()], 1)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


def embed(rows: DataFrame, provider: Embedder, id_col: str, text_col: str, batch: int = 50, *, ledger: str | None = None, back_off: calls.BackOff | None = None) -> DataFrame:
    """(id, embedding): texts in batches of the provider's size, in their order; refused calls are repeated after growing pauses.

    A provider that gives another number of vectors than it got texts is an error.  With a ledger (a folder of calls.answered) equal texts
    are asked once and known ones not at all; a null text has then no vector and is not asked.
    """
    if ledger:
        asked = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        told = calls.answered(asked, calls.indexed(provider.embed), ledger, column="text", kind="array<double>", batch=batch, back_off=back_off)
        return told.select("id", F.col("answer").alias("embedding"))
    back_off = back_off or calls.BackOff()
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, batch):
                some = b.slice(at, batch)
                vectors = back_off(calls.indexed(provider.embed), some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["id", "embedding"])

    return rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, embedding array<double>")


def model_cost(tokens: Column, model: Column) -> Column:
    """Dollars of embedding so many tokens."""
    table = F.create_map(*[F.lit(x) for pair in PRICES.items() for x in pair])
    return F.round(tokens / 1e6 * F.coalesce(F.try_element_at(table, model), F.lit(0.02)), 8)


def with_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunks with their vectors; a chunk without one is an error, not a silent gap."""
    both = chunks.join(vectors, "id", "left")
    return both.filter(F.when(F.col("embedding").isNotNull(), True).otherwise(F.raise_error(F.lit("a chunk has no vector")).cast("boolean")))


def append_vectors(vectors: DataFrame, chunks: DataFrame, path: str, by: str = "year") -> None:
    """Appends chunks with their vectors to a table partitioned by year."""
    with_vectors(vectors, chunks).write.mode("append").partitionBy(by).parquet(path)
