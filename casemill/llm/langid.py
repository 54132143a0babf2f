"""Language by nearest centroid: TF-IDF vectors of letter trigrams against several centroids a language, by cosine.

A text is lower-cased, everything but letters becomes a space, and its byte trigrams are counted in hashed dimensions.  The
document frequencies are counted over all documents that may be learned from: those that have a language and are not held out.  A
bounded number of them a language is clustered on the sphere; a text gets the language of its nearest centroid, and is flagged as
rejected where the cosine is far below what the training texts of that language reach.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.shared import mapped, slices
from casemill.llm.toxicity import held_out

DIMS = 4096
#: Training texts a language and in all, at most; those of least hash.
PER_LANGUAGE, SAMPLE = 1000, 8000
CENTROIDS = 4
UNDETERMINED = "und"
#: Texts hashed at a time, by bytes.
SPAN = 4 << 20
_LETTER = re.compile(r"[^\W\d_]")
_CLASS = np.full(256, 0x20, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def counts(texts: list[str | None]) -> np.ndarray:
    """(texts, DIMS) float32 counts of hashed trigrams."""
    out = np.zeros((len(texts), DIMS), np.float32)
    batch: list[tuple[int, bytes]] = []
    size = 0

    def add():
        data = _CLASS[np.frombuffer(b"".join(b for _, b in batch), np.uint8)]
        of = np.repeat(np.array([k for k, _ in batch]), [len(b) for _, b in batch])
        keep = np.ones(len(data), bool)
        # runs of spaces become one, but a text's first space stays beside the last one of the text before
        keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20) | (of[1:] != of[:-1])
        data, of = data[keep].astype(np.uint32), of[keep]
        code = (data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
        same = of[2:] == of[:-2]
        low, high = batch[0][0], batch[-1][0] + 1
        out[low:high] += np.bincount((of[:-2][same] - low) * DIMS + code[same], minlength=(high - low) * DIMS).reshape(-1, DIMS)

    for k, text in enumerate(texts):
        data = b" " + (text or "").lower().encode() + b" "
        for at in range(0, len(data), SPAN):
            batch.append((k, data[at : at + SPAN + 2]))
            size += len(batch[-1][1])
            if size >= SPAN or len(batch) >= 128:
                add()
                batch, size = [], 0
    if batch:
        add()
    return out


def weigh(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors (square-root frequencies)."""
    x = np.sqrt(count) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Up to k unit centroids of unit vectors, by cosine."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def document_frequency(docs: DataFrame) -> np.ndarray:
    """Number of all texts and, for each dimension, of those that have it; summed a task at a time."""

    def run(batches):
        import pyarrow as pa

        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for some in slices(batch, 0, rows=128, size=SPAN):
                c = counts(some.column(0).to_pylist())
                total += (c > 0).sum(0)
                n += len(c)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(np.append(total, n))], ["dim", "n"])

    rows = mapped(docs.select(F.col("text").cast("string")), run, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for r in rows:
        out[r["dim"]] = r["n"]
    return out


def learnable(docs: DataFrame) -> DataFrame:
    """(id, text, lang) of the rows that may be learned from: with an id and a language, and not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))


def training_ids(known: DataFrame, per_language: int, sample: int) -> list[int]:
    """Ids of at most per_language rows a language and sample in all: those of least hash, languages taken in turn."""
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(sample).collect()  # bounded: no later language could be chosen
    if not sizes:
        return []
    share = known.sparkSession.createDataFrame([(r["lang"], min(1.0, 4 * per_language / r["n"])) for r in sizes], "lang string, share double")
    # a share of the hash range that holds about four times as many rows as are wanted comes to the shuffle, not a language
    few = known.select("id", "lang").join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    order = Window.partitionBy("lang").orderBy("h", "id")
    few = few.withColumn("h", F.xxhash64("id")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_language)
    return [r["id"] for r in few.orderBy("r", "lang").limit(sample).select("id").distinct().collect()]  # bounded by `sample`


def learn(docs: DataFrame, *, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, centroids: int = CENTROIDS) -> dict:
    """The model: idf, unit centroids, the language of each, and the least cosine of each language that is not rejected.

    Only learnable() rows are used; centroids are fitted to at most per_language texts a language and sample in all.
    """
    known = learnable(docs)
    df = document_frequency(known)
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1).astype(np.float32)
    chosen = training_ids(known, per_language, sample)
    empty = {"idf": idf, "centroids": np.zeros((0, DIMS), np.float32), "langs": [], "least": []}
    if not chosen:
        return empty
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "id long")
    texts = known.join(F.broadcast(ids), "id").select("text", "lang")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for some in slices(batch, 0, rows=128, size=SPAN):
                c = np.sqrt(counts(some.column(0).to_pylist())).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in c], pa.binary()), some.column(1)], ["v", "lang"])

    found = mapped(texts, run, "v binary, lang string").toArrow()
    if not found.num_rows:
        return empty
    root = np.frombuffer(b"".join(found.column(0).to_pylist()), np.float16).reshape(-1, DIMS).astype(np.float32)
    x, lang = weigh(root**2, idf), np.array(found.column(1).to_pylist(), object)
    full = np.linalg.norm(x, axis=1) > 0.5
    x, lang = x[full], lang[full]
    out = empty
    for name in sorted(set(lang.tolist())):
        own = x[lang == name]
        c = cluster(own, centroids)
        best = (own @ c.T).max(1)
        out["centroids"] = np.concatenate((out["centroids"], c.astype(np.float32)))
        out["langs"] += [name] * len(c)
        out["least"].append(float(best.mean() - 3 * best.std()))
    return out


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine with the nearest centroid), rejected, for every row.

    A text that is null or has no letter is `und` with score 0, and so is every text where nothing could be learned.  Only the
    text is an input; repeated rows get equal results; other columns are ignored; an empty table gives no rows; a null doc_id is
    not held out.
    """
    idf, centroids, langs = model["idf"], model["centroids"], model["langs"]
    least = dict(zip(sorted(set(langs)), model["least"], strict=True))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for some in slices(batch, rows=128, size=SPAN):
                texts = some.column(1).to_pylist()
                lettered = np.array([bool(langs) and has_letter(t) for t in texts])
                if langs:
                    near = weigh(counts(texts), idf) @ centroids.T
                    best = near.argmax(1)
                    score = np.where(lettered, np.clip(near[np.arange(len(best)), best].astype(float), 0, 1), 0.0)
                    names = [langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered, strict=True)]
                else:
                    score, names = np.zeros(len(texts)), [UNDETERMINED] * len(texts)
                rejected = [n == UNDETERMINED or s < least[n] for n, s in zip(names, score.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(names), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    out = mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
