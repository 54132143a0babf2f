"""A stored vector index in cells: exact cosine search that reads only the cells which can hold one of the k nearest.

Centroids are fitted on a bounded sample; every vector lies in the cell of its nearest centroid, a cell's files are its own, and its
radius is the greatest angle between the centroid and a vector of it.  Angles obey the triangle inequality, so no vector of a cell is
nearer to a query than the angle to the centroid less the radius.  A search reads each query's nearest cells first, which gives a
k-th score, and then whatever other cells reach it: the result is that of a scan of all vectors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators.retrieval import cosine_similarity, top, where
from casemill.sources.scratch import stored
from casemill.sources.snapshots import Tables

#: Vectors that centroids are fitted on, at most, rounds of that, and the greatest number of cells.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 4096
#: Queries of a search that are planned together.
QUERIES = 1024
#: Scores are rounded to six digits, and angles to a few more.
MARGIN = 2e-6


def fit(x, cells: int, seed: int = 7):
    """Unit centroids of unit vectors."""
    import numpy as np

    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


class VectorCells:
    """The index in a folder that the cluster shares; vectors of one length, with any other columns for filters beside them."""

    def __init__(self, spark: SparkSession, folder: str, *, tables: Tables | None = None):
        self.spark, self.tables = spark, tables or Tables(spark, folder)
        self.read_cells = 0, 0

    def build(self, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> VectorCells:
        """Indexes vectors in place of what is there.  cells: None for the square root of their number; null vectors are left out."""
        import numpy as np

        v = F.col(vector_col).cast("array<double>")
        others = [c for c in vectors.columns if c not in (id_col, vector_col)]
        rows = stored(vectors.select(F.col(id_col).alias("id"), v.alias("v"), *others).filter("v is not null"), "vectors")
        n = rows.count()
        share = min(1.0, 2 * sample / max(n, 1))
        some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).filter(F.exists("v", lambda x: x != 0))
        found = some.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]  # bounded by `sample`
        x = np.stack(found.to_list()) if len(found) else np.zeros((0, 1))
        c = fit(x / np.linalg.norm(x, axis=1, keepdims=True), cells or min(MOST_CELLS, max(1, math.isqrt(n)))) if len(x) else np.zeros((0, 1))

        def assign(batches):
            import pyarrow as pa

            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                norm = np.linalg.norm(x, axis=1)
                cell, angle = np.full(len(x), -1), np.zeros(len(x))
                if len(c):
                    near = x / np.where(norm == 0, 1, norm)[:, None] @ c.T
                    cell = np.where(norm == 0, -1, near.argmax(1))
                    angle = np.where(norm == 0, 0.0, np.arccos(np.clip(near.max(1), -1, 1)))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], b.column(0), pa.array(cell.astype(np.int32)), pa.array(angle)], [*b.schema.names[1:], "v", "cell", "angle"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "v")
        placed = stored(rows.select("v", "id", *others).mapInArrow(assign, f"{kinds}, v array<double>, cell int, angle double"), "placed")
        radius = {r["cell"]: (r["angle"], r["n"]) for r in placed.groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect()}  # MOST_CELLS rows at most
        change = self.tables.begin()
        for name in ("cells", "vectors"):
            change.state["tables"].pop(name, None)
        zero = [0.0] * (c.shape[1] if len(c) else 1)
        # a few digits more, as an angle near 0 is known to some 1e-8 only
        rows = [(k, (c[k].tolist() if k >= 0 else zero), float(a) + 1e-7, m) for k, (a, m) in sorted(radius.items())]
        change.append("cells", self.spark.createDataFrame(rows, "cell int, c array<double>, radius double, n long"))
        # a large cell still spreads over several tasks and files
        change.append("vectors", placed.drop("angle").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (1 << 22))))), by="cell")
        change.commit()
        return self

    def _scored(self, pairs: list[tuple[int, int]], asked: DataFrame, version: int, filters: dict | None, kind: str) -> DataFrame:
        """(query_id, id, score) of the vectors in each query's cells."""
        cells = sorted({p[0] for p in pairs})
        rows = self.tables.read("vectors", files=self.tables.files("vectors", version=version, keys=cells), version=version)
        rows = rows.withColumn("cell", F.regexp_extract(F.input_file_name(), r"/cell=(-?\d+)/", 1).cast("int"))
        rows = rows.filter(where(filters)) if filters else rows
        met = F.broadcast(self.spark.createDataFrame(pairs, f"cell int, query_id {kind}").join(asked, "query_id"))  # QUERIES queries at most
        return rows.join(met, "cell").select("query_id", "id", F.round(cosine_similarity(F.col("v"), F.col("q")), 6).alias("score"))

    def search(self, queries: DataFrame, k: int, *, filters: dict | None = None) -> DataFrame:
        """(query_id, id, score, rank) of the k nearest of each stated query (query_id, q) by cosine; filters apply before scoring.

        read_cells then tells how many pairs of a query and a cell were read, and how many there are.
        """
        import numpy as np

        kind, version = queries.schema["query_id"].dataType.simpleString(), self.tables.version()
        state = self.tables.state(version)
        asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"))
        nothing = self.spark.createDataFrame([], f"query_id {kind}, id long, score double, rank int")
        if "cells" not in state["tables"]:
            return nothing
        cells = self.tables.read("cells", version=version).orderBy("cell").collect()  # MOST_CELLS rows at most
        stated = asked.collect()  # the stated queries' own vectors
        if not cells or not stated:
            return nothing
        number, size = [r["cell"] for r in cells], np.array([r["n"] for r in cells])
        c, radius = np.array([r["c"] for r in cells]), np.array([r["radius"] for r in cells])
        out, self.read_cells = None, (0, len(stated) * len(cells))
        for at in range(0, len(stated), QUERIES):
            some = stated[at : at + QUERIES]
            q = np.array([r["q"] for r in some])
            norm = np.linalg.norm(q, axis=1, keepdims=True)
            angle = np.arccos(np.clip(q / np.where(norm == 0, 1, norm) @ c.T, -1, 1))
            bound = np.cos(np.clip(angle - radius[None], 0, math.pi))
            bound[norm[:, 0] == 0] = 0.0  # a query of length 0 scores 0 with everything
            bound[:, np.array(number) < 0] = 0.0  # and so does a vector of length 0
            block = asked.filter(F.col("query_id").isin([r["query_id"] for r in some]))
            order = np.argsort(-bound, axis=1, kind="stable")
            first = [order[i, : int(np.searchsorted(np.cumsum(size[order[i]]), k)) + 1] for i in range(len(some))]
            pairs = [(number[j], some[i]["query_id"]) for i in range(len(some)) for j in first[i].tolist()]
            near = stored(top(self._scored(pairs, block, version, filters, kind), k), "near")
            floor = {r["query_id"]: r["f"] for r in near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("f")).filter(F.col("n") >= k).collect()}  # a row a query
            more = []
            for i, r in enumerate(some):
                reach = np.flatnonzero(bound[i] >= floor.get(r["query_id"], -2.0) - MARGIN)
                more += [(number[j], r["query_id"]) for j in np.setdiff1d(reach, first[i]).tolist()]
            self.read_cells = self.read_cells[0] + len(pairs) + len(more), self.read_cells[1]
            hits = near.select("query_id", "id", "score")
            if more:
                hits = hits.unionByName(self._scored(more, block, version, filters, kind))
            out = top(hits, k) if out is None else out.unionByName(top(hits, k))
        return out
