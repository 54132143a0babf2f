"""Quality of a text: random-indexing vectors pooled per document, then a two-layer network with calibrated probabilities.

A text is a sequence of tokens: runs of letters and digits, runs of marks, and after each its shape (case, digits, length, whether it
repeats a token just before it).  Every token has a sparse random index vector; the vector of a token is the sum of the index
vectors around its occurrences in the whole corpus, counted in one pass, a bounded table a task.  A document's features are the means
of its words' and of its shapes' vectors.  A network of one hidden layer is fitted in numpy to a bounded sample of labelled rows,
and a temperature, fitted to rows of the sample that the network did not see, turns its output into probabilities.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.shared import hash_sample, mapped, slices, written
from casemill.llm.spans import LOWER, PIECE, TERM, buffers, cuts, hashes

#: Labelled rows that are learned from, at most; those of least hash.
SAMPLE = 20_000
WORDS, MARKS, SHAPES = 4096, 512, 128
TOKENS = WORDS + MARKS + SHAPES
DIMS, NONZERO, WINDOW = 64, 2, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 3e-3, 1e-4
#: One row of the sample in CALIBRATION is kept from the network, for the temperature.
CALIBRATION = 5
GOOD_AT = 0.3
#: Texts whose tokens are counted at once.
ROWS = 256

_UPPER, _DIGIT, _SPACE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT[ord("0") : ord("9") + 1] = True
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20130)
_PLACE = _rng.integers(0, DIMS, (TOKENS, NONZERO))
_SIGN = _rng.choice([-1, 1], (TOKENS, NONZERO))


def held_out(doc_id):
    """Whether a row is kept for testing: crc32 of the id as text leaves 0 by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def tokens(data: np.ndarray, places: np.ndarray):
    """(token, shape, text) of the words and runs of marks in order, a piece at a time; shapes lie behind words and marks."""
    for a, b in cuts(data, ~_SPACE):
        part = data[a:b]
        kind = np.where(TERM[part], 1, np.where(_SPACE[part], 0, 2)).astype(np.int8)
        first = np.zeros(b - a, bool)
        low, high = np.searchsorted(places, (a, b))
        first[places[low:high] - a] = True
        new = np.ones(b - a, bool)
        new[1:] = (kind[1:] != kind[:-1]) | first[1:]
        edge = np.append(np.flatnonzero(new), b - a)
        start, size = edge[:-1], np.diff(edge)
        full = kind[start] > 0
        start, size = start[full], size[full]
        if not len(start):
            continue
        text = np.searchsorted(places, start + a, side="right") - 1
        word = kind[start] == 1
        h = hashes(LOWER[part], start, size)
        token = np.where(word, h % np.uint64(WORDS), np.uint64(WORDS) + h % np.uint64(MARKS)).astype(np.int64)
        count = lambda of: (c := np.concatenate(([0], np.cumsum(of[part]))))[start + size] - c[start]
        upper, digit = count(_UPPER), count(_DIGIT)
        case = np.where(digit > 0, 3, np.where(upper == 0, 0, np.where(upper * 2 > size, 2, 1)))
        again = np.zeros(len(h), bool)
        for back in (1, 2):
            again[back:] |= (h[back:] == h[:-back]) & (text[back:] == text[:-back])
        shape = (((word * 4 + case) * 2 + again) * 8) + np.minimum(np.log2(size).astype(np.int64), 7)
        yield token, WORDS + MARKS + shape, text


def count_tokens(column) -> np.ndarray:
    """(texts, TOKENS) how often each text has each token and shape."""
    data, places = buffers(column)
    out = np.zeros(len(column) * TOKENS)
    for token, shape, text in tokens(data, places):
        for ids in (token, shape):
            out += np.bincount(text * TOKENS + ids, minlength=len(out))
    return out.reshape(-1, TOKENS)


def contexts(column) -> np.ndarray:
    """(TOKENS, DIMS) sums of the index vectors around the occurrences of each token."""
    data, places = buffers(column)
    out = np.zeros(TOKENS * DIMS, np.int64)
    for token, shape, text in tokens(data, places):
        ids, of = np.stack((token, shape), 1).ravel(), np.repeat(text, 2)
        for back in range(1, WINDOW + 1):
            same = np.flatnonzero(of[back:] == of[:-back])
            for one, other in ((ids[same], ids[same + back]), (ids[same + back], ids[same])):
                for j in range(NONZERO):
                    out += np.bincount(one * DIMS + _PLACE[other, j], weights=_SIGN[other, j], minlength=len(out)).astype(np.int64)
    return out.reshape(TOKENS, DIMS)


def token_vectors(docs: DataFrame) -> np.ndarray:
    """(TOKENS, DIMS) unit vectors of the tokens over all texts; a token that does not occur has none."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((TOKENS, DIMS), np.int64)
        for batch in batches:
            for some in slices(batch, 0, rows=4096, size=PIECE):
                total += contexts(some.column(0))
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(c) for c in total[used].T)], ["token", *(f"d{k}" for k in range(DIMS))])

    names = [f"d{k}" for k in range(DIMS)]
    rows = mapped(docs.select(F.col("text").cast("string")), run, ", ".join(f"{c} long" for c in ("token", *names)))
    out = np.zeros((TOKENS, DIMS))
    for r in rows.groupBy("token").agg(*(F.sum(c).alias(c) for c in names)).collect():  # TOKENS rows at most
        out[r["token"]] = r[1:]
    # what all tokens have in common says nothing
    out -= out.sum(0) * (np.abs(out).sum(1) / max(1.0, np.abs(out).sum()))[:, None]
    # in steps of 2**-12, so that sums over a text are exact and do not depend on what it is scored with
    return np.round(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12) * 4096) / 4096


def pooled(count: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(texts, 2 * DIMS): the mean vector of the words and marks, and that of the shapes."""
    out = []
    for part in (slice(0, WORDS + MARKS), slice(WORDS + MARKS, TOKENS)):
        c = count[:, part]
        out.append((c @ vectors[part]) / np.maximum(c.sum(1, keepdims=True), 1))
    return np.concatenate(out, 1)


class Network:
    """Standardised features, a layer of tanh units, one output; `temperature` divides it before it becomes a probability."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.spread, self.temperature = mean, spread, 1.0
        self.w = [rng.normal(0, len(mean) ** -0.5, (len(mean), HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def output(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        # sums of one row at a time: a matrix product may round by the number of rows
        hidden = np.tanh(np.einsum("nf,fh->nh", (x - self.mean) / self.spread, a) + b)
        return np.einsum("nh,h->n", hidden, c) + d

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.output(x) / self.temperature, -60, 60)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 12) -> None:
        """Adam on the cross entropy with weight decay."""
        rng, step = np.random.default_rng(seed), 0
        x = (x - self.mean) / self.spread
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                some = order[at : at + BATCH]
                a, b, c, d = self.w
                hidden = np.tanh(x[some] @ a + b)
                off = (1 / (1 + np.exp(-np.clip(hidden @ c + d, -60, 60))) - y[some]) / len(some)
                back = off[:, None] * c * (1 - hidden**2)
                slope = [x[some].T @ back + DECAY * a, back.sum(0), hidden.T @ off + DECAY * c, off.sum(keepdims=True)]
                step += 1
                for w, g, m, v in zip(self.w, slope, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g**2 - v)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least cross entropy, by golden section over its logarithm."""
        z = self.output(x)
        loss = lambda t: float((np.logaddexp(0, z / np.exp(t)) - y * z / np.exp(t)).sum())
        low, high, g = -3.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(40):
            one, two = high - g * (high - low), low + g * (high - low)
            low, high = (low, two) if loss(one) < loss(two) else (one, high)
        self.temperature = float(np.exp((low + high) / 2))


def features(docs: DataFrame, vectors: np.ndarray, keep: list[str]) -> DataFrame:
    """The kept columns and `x`, the pooled vector of each text as bytes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for some in slices(batch, 0, rows=ROWS, size=PIECE):
                x = pooled(count_tokens(some.column(0)), vectors).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array([r.tobytes() for r in x], pa.binary())], [*some.schema.names[1:], "x"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return mapped(docs.select(F.col("text").cast("string").alias("text"), *keep), run, f"{kinds}, x binary")


def learn(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", sample: int = SAMPLE) -> dict:
    """The model: token vectors over all texts, and a network (None if nothing can be learned: no labels, or one kind of them).

    Labels come only from rows that are not held out, of at most `sample` rows, a documented bound; rows of null id or label are
    left out, and an id with several labels has the least of them.
    """
    spark = docs.sparkSession
    vectors = token_vectors(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("good")).filter("id is not null and good is not null")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.min("good").alias("good"))
    chosen = hash_sample(known, "id", sample).collect()  # bounded by `sample`
    if len({r["good"] > 0 for r in chosen}) < 2:
        return {"vectors": vectors, "network": None}
    few = spark.createDataFrame([(r["id"], int(r["good"] > 0)) for r in chosen], "id long, good int")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "id")
    # an id may stand for many rows: the bound holds for rows
    rows = written(rows.withColumn("h", F.xxhash64("id", "text")), "labelled")
    if rows.count() > sample:
        rows = hash_sample(rows, "h", sample)
    found = features(rows, vectors, ["good", "h"]).toArrow()  # bounded by `sample`
    good, h = found.column(0).to_numpy().astype(float), found.column(1).to_numpy()
    x = np.frombuffer(b"".join(found.column(2).to_pylist()), np.float32).reshape(-1, 2 * DIMS).astype(float)
    order = np.lexsort((good, h))
    x, good, h = x[order], good[order], h[order]
    if len(set(good.tolist())) < 2:
        return {"vectors": vectors, "network": None}
    apart = h % CALIBRATION == 0
    if not (~apart).any() or len(set(good[~apart].tolist())) < 2:
        apart[:] = False
    network = Network(x[~apart].mean(0), x[~apart].std(0) + 1e-3)
    network.fit(x[~apart], good[~apart])
    if len(set(good[apart].tolist())) == 2:
        network.calibrate(x[apart], good[apart])
    return {"vectors": vectors, "network": network}


def score_documents(docs: DataFrame, model: dict, *, good_at: float = GOOD_AT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; only the text is an input.

    A null or empty text has no tokens and is scored as a text of mean zero; equal texts score alike; where nothing could be learned
    every score is 0.5; a null doc_id is not held out; other columns are ignored; an empty table gives no rows.
    """
    vectors, network = model["vectors"], model["network"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for some in slices(batch, 0, rows=ROWS, size=PIECE):
                if network is None:
                    p = np.full(some.num_rows, 0.5)
                else:
                    x = pooled(count_tokens(some.column(0)), vectors).astype(np.float32).astype(float)
                    p = np.round(network.probability(x), 6)
                yield pa.RecordBatch.from_arrays([some.column(1), pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    out = mapped(rows, run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= good_at).cast("int").alias("predicted"))
