"""Nearest neighbours by inner product: score-aware quantisation, four-bit table scans, exact reranking.

A vector is cut into subspaces of two components and each part is coded by one of sixteen centroids, four bits.  Codes and
centroids are fitted to the score-aware loss: the part of the residual that is parallel to the vector, which shifts large inner
products, weighs `eta` times as much as the orthogonal part.  The parallel part couples the subspaces, so codes are improved one
subspace at a time with the others held, and each centroid solves a two-by-two system.  The codebook is fitted on a bounded
sample; every vector is coded.

A query's table has its inner product with every centroid; a scan adds a candidate's sixteen-entry look-ups, two at a time.  Queries
and candidates meet in blocks of bounded size.  Each block reranks the best `rerank` of a query exactly in double precision; the k-th
of them is a floor, and every other candidate whose quantised score plus the bound on its quantisation error (norm of its residual
times norm of the query) reaches the floor is compared exactly too, so a crowd of near copies is reranked whole and no true
neighbour is lost.  A query's best over all blocks are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.shared import groups, hash_sample, mapped, written

SAMPLE = 16_384
CENTROIDS = 16
#: Vectors of a block, and queries that meet it in one task: each vector travels once for so many queries.
INDEX_BLOCK, QUERY_BLOCK = 16_384, 4096
#: Queries of a task, at least, where there are few blocks for many tasks.
LEAST_QUERIES = 512
RERANK = 200
#: Inner products above this share of the norm are the ones to keep right; gives the weight of parallel residuals.
THRESHOLD = 0.2


def parallel_weight(dims: int, threshold: float = THRESHOLD) -> float:
    """eta of the score-aware loss for vectors of so many dimensions."""
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


def _parts(x: np.ndarray) -> np.ndarray:
    """(n, subspaces, 2); an odd last component gets a zero beside it."""
    x = np.concatenate((x, np.zeros((len(x), x.shape[1] % 2))), 1)
    return x.reshape(len(x), -1, 2)


def encode(x: np.ndarray, book: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """(n, subspaces) codes of least score-aware loss, by coordinate descent from the nearest centroids."""
    parts = _parts(x)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    n, m, _ = parts.shape
    along = np.einsum("nmd,mcd->nmc", unit, book)
    square = ((parts[:, :, None, :] - book[None]) ** 2).sum(3)
    code = square.argmin(2)
    rows = np.arange(n)
    own = np.einsum("nmd,nmd->nm", unit, parts)
    off = (own - np.take_along_axis(along, code[:, :, None], 2)[:, :, 0]).sum(1)
    for _ in range(rounds):
        for s in range(m):
            rest = off - own[:, s] + along[rows, s, code[:, s]]
            shift = rest[:, None] + own[:, s, None] - along[:, s]
            code[:, s] = (square[:, s] + (eta - 1) * shift**2).argmin(1)
            off = shift[rows, code[:, s]]
    return code.astype(np.uint8)


def fit(x: np.ndarray, *, threshold: float = THRESHOLD, rounds: int = 8, seed: int = 5) -> tuple[np.ndarray, float]:
    """(book, eta): the centroids (subspaces, 16, 2) fitted to the sample."""
    eta, rng = parallel_weight(x.shape[1], threshold), np.random.default_rng(seed)
    parts = _parts(x)
    n, m, _ = parts.shape
    book = parts[rng.integers(0, n, (CENTROIDS, m)), np.arange(m)].transpose(1, 0, 2).copy()
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    own = np.einsum("nmd,nmd->nm", unit, parts)
    for step in range(rounds):
        code = encode(x, book, 1.0 if step < rounds // 2 else eta, 0 if step < rounds // 2 else 1)
        weight = 0.0 if step < rounds // 2 else eta - 1
        chosen = book[np.arange(m), code]
        off = (own - np.einsum("nmd,nmd->nm", unit, chosen)).sum(1)
        for s in range(m):
            rest = off - own[:, s] + (unit[:, s] * chosen[:, s]).sum(1)
            for c in range(CENTROIDS):
                mine = np.flatnonzero(code[:, s] == c)
                if not len(mine):
                    book[s, c] = parts[rng.integers(n), s]
                    continue
                u = unit[mine, s]
                left = len(mine) * np.eye(2) + weight * u.T @ u
                right = parts[mine, s].sum(0) + weight * (u * (rest[mine] + own[mine, s])[:, None]).sum(0)
                book[s, c] = np.linalg.solve(left, right)
            chosen[:, s] = book[s, code[:, s]]
            off = rest + own[:, s] - (unit[:, s] * chosen[:, s]).sum(1)
    return book, eta


def residual(x: np.ndarray, code: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(n,) what a scan's score can be off by, per unit of the query's norm: the residual's norm, and the rounding of float32 sums."""
    norm = np.linalg.norm(_parts(x) - book[np.arange(len(book)), code], axis=(1, 2))
    return norm + (len(book) + 8) * 2.0**-23 * (np.linalg.norm(x, axis=1) + norm)


def pack(code: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte; an odd number of subspaces gets a zero code."""
    code = np.concatenate((code, np.zeros((len(code), code.shape[1] % 2), np.uint8)), 1)
    return code[:, ::2] << 4 | code[:, 1::2]


def tables(queries: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(bytes of a code, queries, 256) float32: what each packed byte adds to each query's score."""
    one = np.einsum("qmd,mcd->mqc", _parts(queries), book).astype(np.float32)
    if len(one) % 2:
        one = np.concatenate((one, np.zeros_like(one[:1])))
    return (one[::2, :, :, None] + one[1::2, :, None, :]).reshape(len(one) // 2, len(queries), 256)


def scan(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(queries, candidates) approximate scores."""
    out = np.zeros((table.shape[1], len(packed)), np.float32)
    for s in range(len(table)):
        out += np.take(table[s], packed[:, s], axis=1)
    return out


def best_of_block(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, packed: np.ndarray, slack: np.ndarray, book: np.ndarray, k: int, rerank: int):
    """For each query the exact k best of the candidates (x, ids) without its own id: (ids, scores) in order, by score and id."""
    rough = scan(tables(q, book), packed)
    first = np.argpartition(-rough, rerank, axis=1)[:, :rerank] if len(x) > rerank else np.tile(np.arange(len(x)), (len(q), 1))
    score = np.einsum("qd,qrd->qr", q, x[first])
    score[ids[first] == own[:, None]] = -np.inf
    floor = -np.partition(-score, k - 1, axis=1)[:, k - 1] if score.shape[1] >= k else np.full(len(q), -np.inf)
    norm = np.linalg.norm(q, axis=1)
    near = ~(rough + norm[:, None] * slack < floor[:, None]) | ~np.isfinite(rough)
    some = np.flatnonzero(near.any(0))
    # the product's sums may be rounded in another order than a pair's own, so it only narrows what is scored pair by pair
    with np.errstate(all="ignore"):
        lost = 4 * x.shape[1] * 2.0**-52 * norm[:, None] * np.linalg.norm(x[some], axis=1)
        reach = near[:, some] & ~(q @ x[some].T + lost < floor[:, None])
    for i in range(len(q)):
        mine = some[reach[i]]
        mine = mine[ids[mine] != own[i]]
        exact = np.einsum("qd,qrd->qr", q[i : i + 1], x[mine][None])[0]
        order = np.lexsort((ids[mine], -exact))[:k]
        order = order[np.isfinite(exact[order])]
        yield ids[mine[order]], exact[order]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part: not null or zero, and all components finite."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return written(rows.filter(finite), "vectors")


def nearest(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, sample: int = SAMPLE, rerank: int = RERANK,
    index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates for each id divisible by `every`, among all rows but its own.

    score is the inner product of the original vectors in double precision; ties go to the smaller vec_id.  Rows that cannot take
    part (usable()) are left out; an empty table gives no rows; other columns are ignored.  Of equal vectors the k + 1 least ids
    are indexed, as no other can be among a query's k best.  sample bounds the rows that the codebook is fitted on; it and rerank, the
    candidates a query and block that set its floor (k + 1 at least), change the work but not the result.  Vectors of several lengths
    have no inner product with each other: each length is searched by itself, one after the other.
    """
    rows = usable(vectors, id_col, vector_col)
    lengths = [r["d"] for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    if not lengths:
        return rows.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    found = [_nearest(rows if len(lengths) == 1 else rows.filter(F.size("v") == d), k, every, sample, rerank, index_block, query_block) for d in lengths]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def _nearest(rows: DataFrame, k: int, every: int, sample: int, rerank: int, index_block: int, query_block: int) -> DataFrame:
    """nearest() among usable vectors of one length, of which there are some."""
    twins = Window.partitionBy("v").orderBy("id")
    index = written(rows.withColumn("r", F.row_number().over(twins)).filter(F.col("r") <= k + 1).drop("r"), "index")
    queries = rows.filter(F.col("id") % every == 0)
    some = hash_sample(index, "id", sample).select("v").toPandas()["v"]
    book, eta = fit(np.stack(some.to_list()).astype(float))
    rerank = max(rerank, k + 1)
    blocks, asked = -(-index.count() // index_block), max(1, queries.count())
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(-(-asked // query_block), min(-(-asked // min(query_block, LEAST_QUERIES)), -(-tasks // blocks)))

    def code(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                codes = encode(x, book, eta)
                packed = pa.array([c.tobytes() for c in pack(codes)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed, pa.array(residual(x, codes, book))], ["id", "v", "code", "slack"])

    coded = mapped(index, code, "id long, v array<double>, code binary, slack double")
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = coded.select(place(blocks).alias("block"), all_of(chunks).alias("chunk"), F.lit(0).alias("kind"), "id", "v", "code", "slack")
    right = queries.select(all_of(blocks).alias("block"), place(chunks).alias("chunk"), F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("slack"))
    met = left.unionByName(right).repartition(min(20_000, blocks * chunks), "block", "chunk").sortWithinPartitions("block", "chunk", "kind", "id")

    def search(batches):
        import pyarrow as pa

        for t in groups(batches, 2):
            kind, ids = t.column(2).to_numpy(), t.column(3).to_numpy()
            x = t.column(4).combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            n = int((kind == 0).sum())
            if not n or n == len(ids):
                continue
            packed = np.frombuffer(b"".join(t.column(5).slice(0, n).to_pylist()), np.uint8).reshape(n, -1)
            slack = t.column(6).slice(0, n).to_numpy()
            for at in range(n, len(ids), 64):
                own = ids[at : at + 64]
                found = list(best_of_block(x[at : at + 64], own, x[:n], ids[:n], packed, slack, book, k, rerank))
                of = np.repeat(own, [len(f) for f, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.concatenate([f for f, _ in found])), pa.array(np.concatenate([s for _, s in found]))], ["query_id", "vec_id", "score"])

    hits = mapped(met, search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
