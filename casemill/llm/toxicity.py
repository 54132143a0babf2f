"""Toxic passages by maximum-scoring segment search over token log-odds.

Learning counts the texts of either label that hold a token, near copies together as one text: a word, or the first letters of a
longer one.  Log-odds get a Dirichlet prior; a token scores by them if its share of toxic texts could not be chance (of all
tokens seen so often, at most one is expected to pass) and they are large; all other tokens share one small negative score.
A text is scanned once, left to right, for all its maximal scoring segments (no prefix or suffix of one can be cut with gain,
none can be joined with another with gain).  Their scores follow an extreme-value law over clean text; its scale makes the mean
of exp(scale * score) one, and the evidence of a text is how unlikely such a set of segments is in clean text of its length.
Evidence becomes a probability by a logistic curve that is fitted to the labelled sample.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.shared import hash_sample, mapped, slices, written
from casemill.llm.shingles import _PLACE, mix, shingle_sets

#: Labelled rows that are learned from, at most; those of least hash.
SAMPLE = 30_000
#: Letters of the prefixes that are tokens beside whole words; a word goes by its longest listed form.
PREFIXES = (6, 5, 4)
#: Bands of hash ranges of which near copies share one with a chance of 0.99 at a similarity of 0.9.
BANDS, BAND = 8, 8
PRIOR = 0.5
LEAST_LOG_ODDS = 2.0
TOXIC_AT = 0.7
#: Words whose scores a task remembers; some 100 bytes each.
CACHE_WORDS = 200_000
#: Bytes of text that are lists of words at a time.
SLICE_BYTES = 1 << 20
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def held_out(doc_id):
    """Whether a row is kept for testing: crc32 of the id as text leaves 1 by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments, in one pass with amortised constant work a token."""
    out: list[list] = []  # start, end, sum before it, sum at its end
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        start, before, total = i, total, total + s
        end, at = i + 1, total
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= before:
                j -= 1
            if j < 0 or out[j][3] >= at:
                out.append([start, end, before, at])
                break
            start, before = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, at - before) for a, b, before, at in out]


class Model:
    """Scores of tokens, and the extreme-value law of segment scores over clean text."""

    def __init__(self, log_odds: dict[str, float], rate: float, other: float):
        self.log_odds, self.other = log_odds, other
        self.scale, self.k = 1.0, 0.1
        self.slope, self.at_none = 1.0, -3.0  # of the logistic curve
        if log_odds:
            # clean text: a listed token with probability `rate`, spread evenly over the list
            gain = lambda x: rate * sum(math.exp(x * s) for s in log_odds.values()) / len(log_odds) + (1 - rate) * math.exp(x * other) - 1
            low, high = 1e-6, 1.0
            while gain(high) < 0 and high < 64:
                high *= 2
            for _ in range(60):
                middle = (low + high) / 2
                low, high = (middle, high) if gain(middle) < 0 else (low, middle)
            self.scale, self.k = low, max(1e-4, low * -other)
        self.cache: dict[str, float] = {}

    def scores(self, text: str | None) -> list[float]:
        tokens = words(text)
        cache = self.cache
        try:
            return list(map(cache.__getitem__, tokens))
        except KeyError:
            for w in set(tokens).difference(cache):
                forms = (w, *(f"{w[:n]}*" for n in PREFIXES))
                cache[w] = next((self.log_odds[f] for f in forms if f in self.log_odds), self.other)
            out = list(map(cache.__getitem__, tokens))
            if len(cache) > CACHE_WORDS:
                cache.clear()
            return out

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """(first token, end, score, expected number in clean text of this length) of each segment."""
        scores = self.scores(text)
        if not scores or max(scores) <= 0:
            return []
        return [(a, b, s, self.k * len(scores) * math.exp(-self.scale * s)) for a, b, s in segments(scores)]

    def evidence(self, text: str | None) -> float:
        """-log of the least chance, over r, that clean text of this length has r segments that together score as the r best do."""
        excess = sorted((-math.log(max(e, 1e-300)) for *_, e in self.passages(text)), reverse=True)
        best, total = 0.0, 0.0
        for r, x in enumerate(excess, 1):
            total += x
            if total <= 0:
                break
            # one segment: Gumbel tail; r segments: the sum statistic's tail
            log_chance = math.log(-math.expm1(-math.exp(-total))) if r == 1 and total < 30 else -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
            best = max(best, -log_chance)
        return best

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.at_none + self.slope * self.evidence(text)))))

    def calibrate(self, evidence: list[float], toxic: list[int], rounds: int = 50) -> None:
        """Fits the logistic curve by damped Newton steps with a slight pull to the default; evidence counts up to 20.

        A step is halved until the loss, which is convex, falls; so the fit neither overshoots nor diverges at any number of rows.
        """
        x = np.stack([np.ones(len(evidence)), np.minimum(evidence, 20.0)], 1)
        y, pull = np.array(toxic, float), np.array([self.at_none, self.slope])
        loss = lambda w: float((np.logaddexp(0, x @ w) - y * (x @ w)).sum() + ((w - pull) ** 2).sum() / 2)
        w, now = pull.copy(), loss(pull)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - y) + (w - pull))
            size = 1.0
            while size > 1e-9 and not loss(w - size * step) < now:
                size /= 2
            if size <= 1e-9:
                break
            w = w - size * step
            now = loss(w)
        self.at_none, self.slope = float(w[0]), max(1e-3, float(w[1]))


def _family_keys(shingles: np.ndarray) -> list[int]:
    """Keys that near copies are likely to share: the whole set's, and one for each BAND of the least shingles of equal hash ranges.

    Texts that only share a passage would have to agree in all ranges of a band.  A band of a short text that lacks shingles has no key.
    """
    if not len(shingles):
        return []
    at = np.searchsorted(shingles, np.arange(BANDS * BAND, dtype=np.uint64) << np.uint64(64 - int(math.log2(BANDS * BAND))))
    full = at < np.append(at[1:], len(shingles))
    least = np.where(full, shingles[np.minimum(at, len(shingles) - 1)], np.uint64(0)).reshape(BANDS, BAND)
    keys = mix((least * _PLACE[:BAND]).sum(1) + np.arange(1, BANDS + 1, dtype=np.uint64))[full.reshape(BANDS, BAND).sum(1) >= BAND - 2]
    whole = mix(shingles.sum(keepdims=True) ^ np.uint64(len(shingles)))
    return np.concatenate((whole, keys)).astype(np.int64).tolist()


def _token_sets(texts: DataFrame) -> DataFrame:
    """row, toxic, the distinct tokens and the family keys of each text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for some in slices(batch, 0, rows=256, size=SLICE_BYTES):
                said = some.column(0).to_pylist()
                keys = [_family_keys(s) for s in shingle_sets([(t or "").encode() for t in said])]
                tokens = []
                for t in said:
                    found = set(words(t))
                    tokens.append(list(found | {f"{w[:n]}*" for w in found for n in PREFIXES if len(w) > n}))
                yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), pa.array(tokens, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64()))], ["row", "toxic", "tokens", "keys"])

    return mapped(texts.select("text", "row", "toxic"), run, "row long, toxic int, tokens array<string>, keys array<bigint>")


def _shares(sets: DataFrame) -> DataFrame:
    """(row, share): what each text counts, one by the most texts of its label that share a key with it; texts of no words have none."""
    keys = sets.select("row", "toxic", F.explode("keys").alias("key"))
    many = keys.groupBy("key", "toxic").agg(F.count("*").alias("many"))
    return keys.join(many, ["key", "toxic"]).groupBy("row").agg((1 / F.max("many")).alias("share"))


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, least: float = LEAST_LOG_ODDS, prior: float = PRIOR) -> Model:
    """The model from the labelled rows that are not held out (at most `sample`, a documented bound; both labels, null ones left out)."""
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    usable = usable.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = hash_sample(usable, "doc_id", sample).collect()  # bounded by `sample`
    if not chosen:
        return Model({}, 0.0, -0.1)
    few = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = rows.join(F.broadcast(few), "id").select("text", "toxic")  # few: bounded by `sample`
    texts = written(texts.withColumn("row", F.monotonically_increasing_id()), "labelled")
    if texts.count() > sample:  # an id may stand for many rows: the bound holds for rows
        texts = written(hash_sample(texts, "row", sample), "labelled")
    # near copies share the weight of one text of their label: they are no evidence of their own
    sets = written(_token_sets(texts), "tokens")
    one = written(sets.join(_shares(sets), "row", "left").select("toxic", "tokens", F.coalesce("share", F.lit(1.0)).alias("share")), "shares")
    size = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.sum("share").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return Model({}, 0.0, -0.1)
    exploded = one.select("toxic", "share", F.explode("tokens").alias("token"))
    counts = exploded.groupBy("token").agg(F.sum(F.col("toxic") * F.col("share")).alias("t"), F.sum("share").alias("n")).filter("n > 1.99")
    counts = written(counts, "counts")
    share = bad / (bad + good)
    # sums of shares may differ from whole numbers in the last digits
    p = F.least(F.lit(1.0), F.round(F.col("t") / F.col("n"), 12))
    unlikely = F.col("n") * (F.when(p > 0, p * F.log(p / share)).otherwise(0.0) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0))
    odds = F.log((F.col("t") + prior) / (bad + prior)) - F.log((F.greatest(F.col("n") - F.col("t"), F.lit(0.0)) + prior) / (good + prior))
    tested = max(1, counts.count())
    kept = counts.filter((p > share) & (unlikely >= math.log(tested)) & (odds >= least)).select("token", odds.alias("odds"), (F.col("n") - F.col("t")).alias("clean"), "t").orderBy("token").collect()
    log_odds = {r["token"]: round(r["odds"], 9) for r in kept}
    clean = max(0.0, sum(r["clean"] for r in kept if not r["token"].endswith("*")))
    toxic = sum(r["t"] for r in kept if not r["token"].endswith("*"))
    total = one.groupBy("toxic").agg(F.sum(F.size("tokens") * F.col("share")).alias("n")).collect()
    n = {r["toxic"]: max(1, r["n"] or 1) for r in total}
    rate = (clean + prior) / n[0]
    model = Model(log_odds, rate, min(-1e-3, math.log1p(-min(0.5, (toxic + prior) / n[1])) - math.log1p(-rate)))

    def weigh(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.evidence(t) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], ["evidence", "toxic"])

    found = mapped(texts.select("text", "toxic"), weigh, "evidence double, toxic int").toArrow()  # bounded by `sample`
    model.calibrate(found.column(0).to_pylist(), found.column(1).to_pylist())
    return model


def score_documents(docs: DataFrame, model: Model, *, toxic_at: float = TOXIC_AT, spans: bool = False, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, and with spans the significant passages (first token, end, score, expected).

    A text of no words, null, or without a toxic token has the least score.  Only the text is an input.  Repeated rows score alike; other
    columns are ignored unless named in keep; an empty table gives no rows; a null doc_id is not held out.
    """
    keep = keep or []
    schema = "score double" + (", passages array<struct<first:int,end:int,score:double,expected:double>>" if spans else "")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in keep if c not in ("doc_id", "text")])
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for some in slices(batch, size=SLICE_BYTES):
                texts = some.column(1).to_pylist()
                columns, names = [*(c for i, c in enumerate(some.columns) if i != 1 or "text" in keep)], [n for i, n in enumerate(some.schema.names) if i != 1 or "text" in keep]
                columns.append(pa.array([model.score(t) for t in texts], pa.float64()))
                names.append("score")
                if spans:
                    found = [[dict(zip(("first", "end", "score", "expected"), p, strict=True)) for p in model.passages(t) if p[3] < 1] for t in texts]
                    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
                    columns.append(pa.array(found, kind))
                    names.append("passages")
                yield pa.RecordBatch.from_arrays(columns, names)

    kept = [f for i, f in enumerate(base.schema.fields) if i != 1 or "text" in keep]
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    out = mapped(base, run, f"{given}, {schema}")
    return out.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False))).withColumn("predicted", (F.col("score") >= toxic_at).cast("int"))
