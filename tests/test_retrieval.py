"""BM25, cosine, fusion, re-ranking and confidence on literal rows."""

import pytest
from pyspark.sql import functions as F

from casemill.functions import lexicons
from casemill.operators import retrieval as R

CHUNKS = [(0, "deposit not protected section"), (1, "cleaning charges disputed"), (2, "deposit protected late"), (3, "garden overgrown"), (4, "rent arrears owed rent"), (5, "walls painting")]


@pytest.mark.parametrize(
    "query, want",
    [("deposit protected", [(2, 1.175573), (0, 1.022238)]), ("rent", [(4, 1.676494)]), ("rent rent", [(4, 3.352988)]), ("zzz", []), ("", [])],
)
def test_bm25(spark, query, want):
    docs = spark.createDataFrame(CHUNKS, "doc_id int, text string")
    rows = R.bm25(docs, spark.createDataFrame([(1, query)], "query_id int, query string"), 5).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in rows] == want


def test_bm25_does_not_depend_on_row_order(spark):
    asked = spark.createDataFrame([(1, "deposit rent section")], "query_id int, query string")
    found = [{tuple(r) for r in R.bm25(spark.createDataFrame(rows, "doc_id int, text string"), asked, 5).collect()} for rows in (CHUNKS, CHUNKS[::-1])]
    assert found[0] == found[1]


@pytest.mark.parametrize("a, b, want", [(1, 1, 0.01639344), (1, None, 0.01175870), (None, 1, 0.00557903), (2, 5, 0.01590571)])
def test_fusion(spark, a, b, want):
    frame = lambda rank: spark.createDataFrame([] if rank is None else [(1, 7, 0.5, rank)], "query_id int, id int, score double, rank int")
    assert R.fuse(frame(a), frame(b), 5).first()["fused"] == pytest.approx(want, abs=1e-8)


def test_empty_branches(spark):
    none = spark.createDataFrame([], "query_id int, id int, score double, rank int")
    assert R.fuse(none, none, 5).count() == 0


def test_temporal(spark):
    rows = spark.createDataFrame([(2024 - n,) for n in (0, 2, 5, 6, 10, 14, 20, -3)], "y int").select(lexicons.temporal_factor(F.col("y"), 2024)).collect()
    assert [round(r[0], 6) for r in rows] == [1.0, 0.9, 0.7, 0.7, 0.5, 0.3, 0.3, 1.0]


def test_rerank_sum(spark):
    row = [(1, 9, "deposit protection", "LON", "nothing of note", 2019, "LON", 0.4, 1, 0.0, 999, 0.016393442, 1)]
    frame = spark.createDataFrame(row, "query_id int, id int, query string, query_region string, text string, year int, region string, semantic_score double, semantic_rank int, bm25_score double, bm25_rank int, fused double, fused_rank int")
    out = R.rerank(frame, 5, as_of_year=2024, issues=lexicons.ISSUES, evidence=lexicons.EVIDENCE).first()
    assert out["issue"] == 0.3 and out["evidence"] == 0.5
    assert out["rerank_score"] == pytest.approx(0.4 * 0.3 + 0.2 * 0.7 + 0.1 + 0.2 * 0.5 + 0.1 * 0.16393442, abs=1e-6)
    assert out["explanation"] == "Relatively recent (2019); Same region (LON)"


@pytest.mark.parametrize(
    "semantic, want, uncertain",
    [([0.85, 0.7, 0.6, 0.5, 0.45], 0.933333, False), ([0.25, 0.23, 0.21], 0.366667, True), ([0.72], 0.633333, False), ([], 0.0, True)],
)
def test_confidence(spark, semantic, want, uncertain):
    rows = spark.createDataFrame([(1, s, 0.01, k + 1) for k, s in enumerate(semantic)], "query_id int, semantic_score double, fused double, rerank_rank int")
    out = R.confidence(rows, spark.createDataFrame([(1,)], "query_id int")).first()
    assert out["confidence"] == want and out["is_uncertain"] is uncertain


def test_cosine_and_filters(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 2020), (2, [0.0, 2.0], 2018), (3, [3.0, 3.0], 2021), (4, [0.0, 0.0], 2022)], "vec_id int, embedding array<double>, year int")
    asked = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, q array<double>")
    got = {r["id"]: r["score"] for r in R.cosine_top(vectors, asked, 9, filters={"year": {"$gte": 2020}}).collect()}
    assert got == {3: 1.0, 1: 0.707107, 4: 0.0}
    assert [r["id"] for r in R.cosine_top(vectors, asked, 1).collect()] == [3]


def test_gate(spark):
    gate = lambda c, u, n: spark.range(1).select(R.abstain(F.lit(c).cast("double"), F.lit(u).cast("boolean"), F.lit(n).cast("int"))).first()[0]
    assert [gate(0.4, False, 9), gate(0.9, True, 9), gate(0.9, False, 2), gate(0.9, False, 3), gate(None, None, None)] == ["abstain_confidence", "abstain_confidence", "abstain_cases", "proceed", "proceed"]


def test_keywords_inside_words(spark):
    frame = spark.createDataFrame([("at last",), ("prescribed information",), ("improvement notice",), ("none here",), (None,)], "t string")
    assert [r[0] for r in frame.select(lexicons.tier(F.col("t"))).collect()] == ["adjacent", "deposit", "adjacent", "other", "other"]
    assert frame.select(lexicons.keyword_hits(F.col("t"), lexicons.ADJACENT_KEYWORDS, word_boundary=True)).first()[0] == []
