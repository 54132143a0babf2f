"""Vector code compression: product codes by partial-distance search, in integers throughout.

Components become integers, vectors are cut into PARTS equal parts, and a codebook a part is improved for some rounds: every part
goes to the nearest entry, every entry becomes the floored mean of its parts.  The nearest entry is found by partial distances: the
dimensions are taken in descending variance of the codebook; the entry that is nearest over the first few of them gives a first
complete distance, and an entry is dropped for a part once its distance so far strictly exceeds the least complete one, so that ties
stay and go to the lower index.  All sums are integers, so the result depends neither on the order nor on the number of tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.shared import mapped, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Dimensions over which all entries are compared before the first are dropped, and at a time after that.
FIRST, STEP = 4, 2
#: Pairs are followed one by one once fewer than one in SPARSE is left.
SPARSE = 8
#: Parts that are compared at once.
ROWS = 256


def partial_search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of the nearest entry of the book for each row, squared Euclidean, ties to the lower index."""
    n, width = x.shape
    order = np.argsort(-book.astype(float).var(axis=0), kind="stable")
    peak = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    kind = np.int32 if 4 * int(peak) ** 2 * width < 1 << 31 else np.int64
    x, book = np.ascontiguousarray(x[:, order].T, kind), np.ascontiguousarray(book[:, order].T, kind)
    so_far, step = np.zeros((n, book.shape[1]), kind), np.empty((n, book.shape[1]), kind)
    least, alive, at = None, None, 0
    # while many entries are left, the mask only counts them
    while at < width and (alive is None or np.count_nonzero(alive) * SPARSE > alive.size):
        end = min(at + (STEP if at else FIRST), width)
        for d in range(at, end):
            np.subtract(x[d][:, None], book[d][None], out=step)
            np.multiply(step, step, out=step)
            so_far += step
        at = end
        if least is None:
            guess = so_far.argmin(1)
            least = ((x - book[:, guess]) ** 2).sum(0)
        alive = so_far <= least[:, None]
    row, entry = np.nonzero(alive)
    distance = so_far[row, entry]
    while at < width:
        end = min(at + STEP, width)
        for d in range(at, end):
            distance = distance + (x[d, row] - book[d, entry]) ** 2
        at = end
        stay = distance <= least[row]
        row, entry, distance = row[stay], entry[stay], distance[stay]
    # pairs are in the order of rows and entries, and the nearest entry of every row is among them
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    best = np.minimum.reduceat(distance, np.flatnonzero(new))
    hit = np.flatnonzero(distance == best[np.cumsum(new) - 1])
    first = np.ones(len(hit), bool)
    first[1:] = row[hit][1:] != row[hit][:-1]
    return entry[hit[first]], distance[hit[first]].astype(np.int64)


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, distances), a column a part, of vectors whose parts lie one after the other."""
    width = books.shape[2]
    code, distance = np.zeros((len(x), len(books)), np.int64), np.zeros((len(x), len(books)), np.int64)
    for at in range(0, len(x), ROWS):
        for p in range(len(books)):
            code[at : at + ROWS, p], distance[at : at + ROWS, p] = partial_search(x[at : at + ROWS, p * width : (p + 1) * width], books[p])
    return code, distance


def _vectors(batch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def improve(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books with each entry replaced by the floored mean of its parts; entries that no part is nearest to stay."""
    parts, entries, width = books.shape

    def run(batches):
        import pyarrow as pa

        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = _vectors(batch, 0)
            code, _ = assign(x, books)
            for p in range(parts):
                np.add.at(total, p * entries + code[:, p], x[:, p * width : (p + 1) * width])
                count += np.bincount(p * entries + code[:, p], minlength=parts * entries)
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *(pa.array(c) for c in total[used].T)], ["entry", "n", *(f"s{d}" for d in range(width))])

    names = [f"s{d}" for d in range(width)]
    sums = mapped(rows.select("v"), run, ", ".join(f"{c} long" for c in ("entry", "n", *names)))
    out = books.reshape(-1, width).copy()
    # one row an entry; `sum` combines a task's rows before they are sent
    for r in sums.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).collect():
        out[r["entry"]] = [r[c] // r["n"] for c in names]
    return out.reshape(books.shape)


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _coded(rows: DataFrame, dims: int, parts: int, entries: int, rounds: int) -> DataFrame:
    width = -(-dims // parts)
    peak = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0
    if peak >= 1 << 25 or 4 * peak**2 * max(width, 1) >= 1 << 62:
        raise ValueError(f"components of up to {peak / SCALE:g} are too large: squared distances would not fit 64 bits")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()  # at most `entries` rows
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    if width:
        for _ in range(rounds):
            books = improve(rows, books)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if width:
                code, distance = assign(_vectors(batch, 2), books)
            else:
                code = distance = np.zeros((batch.num_rows, parts), np.int64)
            digits = len(f"{entries - 1:x}")
            text = ["".join(f"{c:0{digits}x}" for c in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text), pa.array(distance.sum(1))], ["vec_id", "label", "code", "error"])

    out = mapped(rows.select("vec_id", "label", "v"), run, "vec_id long, label long, code string, error long")
    return out.withColumn("codebooks_sha256", F.lit(codebooks_sha256(books)))


def compress(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector that is not null and holds no null or non-finite component.

    Components are floor(1024 * x); the seeds are the `entries` smallest ids, null ids last and equal ids by vector; fewer rows give
    fewer entries.  Equal rows get equal codes; null labels are one label; other columns are ignored; an empty table gives no rows.
    Vectors of several lengths get codebooks of their own a length; a length that `parts` does not divide is filled up with zeros,
    which are in the codebooks and change no distance.  Components are refused where their squared distances would not fit 64 bits.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v")).filter("v is not null")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    # least and greatest first, so that what does not fit is refused and not cut
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(2.0**52)), F.lit(-(2.0**52)))).cast("long"))
    rows = rows.withColumn("dims", F.size("v")).withColumn("v", F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.pmod(-F.col("dims"), F.lit(parts)))))
    rows = written(rows, "whole-vectors")
    found = None
    for r in rows.select("dims").distinct().orderBy("dims").collect():
        one = _coded(rows.filter(F.col("dims") == r["dims"]), r["dims"], parts, entries, rounds)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    found = written(found, "codes")
    of_label = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return found.join(of_label, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def compress_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL, a pair of tables a round; for small tables of vectors of one length, as it lists every part with every entry."""
    steps = [
        "k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v"
        " FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM k, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        near = "list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v)"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, x.p, any_value(x.v) AS v, min(struct_pack(d := {near}, e := e)) AS n FROM x JOIN b{i} b ON x.p = b.p GROUP BY r, x.p)")
        if i < rounds:
            steps.append(f"f{i} AS (SELECT p, e, list(m ORDER BY j) AS v FROM (SELECT p, n.e AS e, j, floor(sum(v[j]) / count(*)) AS m FROM a{i}, range(1, (SELECT max(len(v)) FROM x) + 1) t(j) GROUP BY p, n.e, j) GROUP BY p, e)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(f.v, b.v) AS v FROM b{i} b LEFT JOIN f{i} f ON b.p = f.p AND b.e = f.e)")
    steps.append(f"c AS (SELECT r, string_agg(printf('%02x', n.e), '' ORDER BY p) AS code, sum(n.d)::BIGINT AS error FROM a{rounds} GROUP BY r)")
    steps.append(f"s AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda y: y::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (r), s"
