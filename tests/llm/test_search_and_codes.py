"""Ranked lexical search, vector codes and the quality classifier."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from casemill.llm import codes, lexical, quality, spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked_by_hand(docs, items, k):
    bags = [(i, words_of(t)) for i, t in docs]
    bags = [(i, w) for i, w in bags if w]
    n, length = len(bags), sum(len(w) for _, w in bags)
    out = []
    for item, text in items:
        scored = []
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in w for _, w in bags) + 1))) for t in set(words_of(text))}
        for i, w in bags:
            m = 50 + 50 * len(w) * n // length
            s = sum(weight[t] * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in weight if t in w)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def some_docs(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "Lo", "mé", "T9") for b in ("", "x", "yy", "ñe", "7")]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)]


ODD = [(None, "ka Lox, ka"), (None, None), (5000, ""), (5001, "--- !!"), (5002, "kA\x00KA\x7flox"), (5003, "ka " * 5000), (5003, "ka " * 5000), (5004, "méñe" * 300)]
ITEMS = [(1, "KA méx t97"), (2, None), (3, ""), (4, "lox lox unseen"), (4, "tyy"), (None, "ka")]


@pytest.mark.parametrize("block, group", [(4, 1024), (32, 2)])
def test_ranking(spark, block, group):
    docs = some_docs(400) + ODD
    d = spark.createDataFrame([(i, t, 9, 9.0) for i, t in docs], "doc_id long, text string, rank int, score double").repartition(3)
    b = spark.createDataFrame([(i, t, 3) for i, t in ITEMS], "item_id long, text string, n int")
    out = [tuple(r) for r in lexical.rank_documents(d, b, k=7, block=block, group_items=group).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(out, key=str) == ranked_by_hand(docs, ITEMS, 7)
    everything = lexical.rank_documents(d, b, k=1000).collect()
    assert sorted(map(tuple, everything), key=str) == ranked_by_hand(docs, ITEMS, 1000)


def test_ranking_of_nothing(spark):
    d = spark.createDataFrame(some_docs(5), "doc_id long, text string")
    b = spark.createDataFrame([(1, "ka")], "item_id long, text string")
    for x, y in ((d.limit(0), b), (d, b.limit(0)), (d, b.filter("false")), (d.withColumn("text", d.text.substr(1, 0)), b)):
        assert lexical.rank_documents(x, y).collect() == []


def test_ranking_sql(spark):
    docs = [(i, t) for i, t in some_docs(150, 3) + ODD if t is None or "\x00" not in t]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", ITEMS)
    assert sorted(con.execute(lexical.RANK_SQL).fetchall(), key=str) == ranked_by_hand(docs, ITEMS, 50)


def test_ranges_below_the_threshold_are_not_scored(spark, monkeypatch):
    """A topic in few ranges: the bounds of the others are below the k-th score, and their forward index is never read."""
    docs = [(i, "ka lo " + ("rare méx " * 3 if i // 32 == 7 else "tyy ")) for i in range(3200)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    vocabulary = ["ka", "méx", "rare"]
    counted = lexical.count_terms(d, lexical.Vocabulary(vocabulary), "doc_id", "text")
    weight, n, length = lexical.weights(counted, 3)
    index = lexical.build(counted, weight, n, length, 32).toArrow()
    assert index.num_rows == 100 and n == 3200
    seen = []
    kept = lexical.Ranges.score
    monkeypatch.setattr(lexical.Ranges, "score", lambda self, ranges, wanted: seen.append(len(ranges)) or kept(self, ranges, wanted))
    asked = lexical.Asked([1], np.array([0, 1, 2]), np.array([0, 3]))
    monkeypatch.setattr(lexical, "mapped", lambda df, run, schema: list(run(iter(index.to_batches()))))
    found = lexical.search(None, asked, 3, 20, [1])
    assert sorted(pa.Table.from_batches(found).column("doc_id").to_pylist()) == list(range(224, 244))
    assert sum(seen) <= lexical.FIRST


def test_ranking_stores_the_counts_alone(spark, monkeypatch):
    """Every stored table is files of each task; the ranges are made where they are searched."""
    names, kept = [], lexical.written
    monkeypatch.setattr(lexical, "written", lambda df, name: names.append(name) or kept(df, name))
    d = spark.createDataFrame(some_docs(100), "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = lexical.rank_documents(d, b, k=7, block=4).collect()
    assert names == ["counts"] and sorted(map(tuple, out), key=str) == ranked_by_hand(some_docs(100), ITEMS, 7)


def test_words_in_pieces():
    texts = [None, "", "ab  cd", "efgh", "i" * 5000 + " j", "kl", "x y " * 3000]
    data, places = spans.buffers(pa.array(texts))
    found = []
    kept = spans.cuts
    spans.cuts = lambda data, inside: kept(data, inside, 64)
    try:
        for start, size, text in spans.words(data, places, spans.TERM):
            found += [(int(t), bytes(data[s : s + n]).decode()) for s, n, t in zip(start, size, text, strict=True)]
    finally:
        spans.cuts = kept
    assert found == [(k, w) for k, t in enumerate(texts) for w in words_of(t)]


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    """(code, error) of the rows, in order, and the digest, in Python integers."""
    v = [[math.floor(1024 * float(np.float32(x))) for x in r] for _, r in rows]
    width = len(v[0]) // parts
    cut = [[tuple(x[p * width : (p + 1) * width]) for p in range(parts)] for x in v]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, v[i]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(c[p], books[p]) for c in cut]
            for e in range(len(books[p])):
                own = [c[p] for c, o in zip(cut, of, strict=True) if o == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    code = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(far(c[p], books[p][e]) for p, e in enumerate(k)) for c, k in zip(cut, code, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return ["".join(f"{e:02x}" for e in k) for k in code], error, digest


def test_codes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 12)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, x[i].tolist(), None if i % 7 == 0 else i % 3, "c") for i in range(500)]
    bad = [(900, None, 1, "c"), (901, [1.0] * 11 + [None], 1, "c"), (902, [float("nan")] * 12, 1, "c"), (903, [float("inf")] * 12, 1, "c")]
    rows += [(None, [0.5] * 12, 2, "c"), (7, x[7].tolist(), None, "c")]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int, code string").repartition(4)
    code, error, digest = codes_by_hand([(r[0], r[1]) for r in rows])
    out = codes.compress(frame).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    total = {}
    for r, e in zip(rows, error, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    want = [(r[0], c, e, total[r[2]], digest) for r, c, e in zip(rows, code, error, strict=True)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [r[:3] for r in rows + bad])
    assert sorted(con.execute(codes.compress_sql()).fetchall(), key=str) == sorted(want, key=str)


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>, label int"
    frame = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 1), (2, [-1.0001, 0.0, 0.0, 0.0], 1), (3, [0.25] * 6, 2), (4, [], 2)], kind)
    out = {r["vec_id"]: r for r in codes.compress(frame).collect()}
    assert [out[i]["error"] for i in (1, 2, 3, 4)] == [0, 0, 0, 0] and out[1]["code"] == "00000000" and out[2]["code"] == "01010101"
    assert out[1]["codebooks_sha256"] == hashlib.sha256(b"1024,-1025,2048,0,3072,0,4096,0").hexdigest() != out[3]["codebooks_sha256"]
    assert codes.compress(frame.limit(0)).collect() == []
    with pytest.raises(ValueError, match="too large"):
        codes.compress(spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0], 1)], kind))


@pytest.mark.parametrize("width, peak", [(1, 3), (16, 500), (5, 1 << 24), (24, 40)])
def test_partial_distances_find_the_nearest(width, peak):
    rng = np.random.default_rng(width)
    x, book = rng.integers(-peak, peak, (300, width)), rng.integers(-peak, peak, (256, width))
    x[:20] = book[5]
    book[200] = book[5]
    full = ((x[:, None] - book[None]) ** 2).sum(2)
    code, distance = codes.partial_search(x, book)
    assert (code == full.argmin(1)).all() and (distance == full.min(1)).all()


def quality_rows(n=600, seed=5):
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("the", "on", "er", "in", "sta") for b in ("", "ing", "ed", "tion")]
    out = []
    for i in range(n):
        w = rng.choices(vocabulary, k=rng.randint(20, 120))
        good = rng.random() < 0.8
        if not good:
            kind = rng.randrange(3)
            w = [f"{x.upper()}!!" for x in w] if kind == 0 else [f"{x} |" for x in w] if kind == 1 else [x for x in w for _ in range(6)]
        out.append((i, " ".join(w), int(good)))
    return out


def test_quality_of_held_out_rows(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([(i, t, 1, 0.5) for i, t, _ in rows], "doc_id long, text string, good int, score double").repartition(3)
    labels = spark.createDataFrame([(i, g, 0) for i, _, g in rows] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    out = {r["doc_id"]: r for r in quality.score_documents(docs, model).collect()}
    held = [(out[i], g) for i, _, g in rows if out[i]["held_out"]]
    assert len(held) > 60 and all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(r["predicted"] == g for r, g in held) >= 0.97 * len(held)
    assert np.mean([(r["score"] - g) ** 2 for r, g in held]) < 0.03 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    # rows that are held out teach nothing
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(string(doc_id) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    again = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, quality.learn(docs, turned)).collect()}
    assert again == {i: r["score"] for i, r in out.items()}


def test_quality_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "doc_id long, quality int")
    model = quality.learn(odd, labels)
    out = quality.score_documents(odd, model).collect()
    assert len(out) == odd.count() and len({r["score"] for r in out if r["doc_id"] == 5}) == 1 and not [r for r in out if r["doc_id"] is None and r["held_out"]]
    assert quality.score_documents(none, model).collect() == []
    for rows in (labels.limit(0), labels.filter("quality = 1")):
        assert {r["score"] for r in quality.score_documents(odd, quality.learn(odd, rows)).collect()} == {0.5}
    assert quality.learn(none, labels)["network"] is None
    # the bound holds for rows where an id stands for many
    many = odd.filter("doc_id = 5 or doc_id = 2").crossJoin(spark.range(20).select("id")).drop("id")
    assert quality.learn(many, labels, sample=3)["vectors"].shape == (quality.TOKENS, quality.DIMS)


def test_a_text_scores_alike_in_any_batch(spark):
    rows = quality_rows(200, 6)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.learn(docs, spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, quality int"))
    one = {r["doc_id"]: r["score"] for r in quality.score_documents(docs.repartition(7), model).collect()}
    assert one == {r["doc_id"]: r["score"] for r in quality.score_documents(docs.coalesce(1).orderBy("text"), model).collect()}


def test_temperature_softens_a_network_that_is_too_sure():
    rng = np.random.default_rng(1)
    net = quality.Network(np.zeros(2), np.ones(2))
    z = rng.normal(size=4000)
    x, y = np.stack((z, np.zeros(4000)), 1), (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    net.output = lambda x: 6 * x[:, 0]
    net.calibrate(x, y)
    assert 5 < net.temperature < 7.5
