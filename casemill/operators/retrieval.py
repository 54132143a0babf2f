"""Hybrid retrieval: postings and BM25, exact cosine, reciprocal-rank fusion, feature re-ranking, confidence.

Every operator takes a frame of queries and answers all of them at once.  Query frames are stated sets; the side that grows with the
corpus is never broadcast, and queries only up to a stated number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import lexicons, text

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, SEMANTIC_WEIGHT, KEYWORD_WEIGHT, MISSING_RANK = 60, 0.7, 0.3, 999
#: Queries of a cosine search that are broadcast together.
QUERY_BLOCK = 1024
FACTORS = {"issue": 0.4, "temporal": 0.2, "region": 0.1, "evidence": 0.2, "fused": 0.1}


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, len): one row a document and term; the term count is combined before the shuffle."""
    # the tokens are evaluated once, in the generator
    counted = F.get(F.transform(F.array(text.tokens(F.col(text_col))), lambda t: F.transform(t, lambda w: F.struct(w.alias("term"), F.size(t).alias("len")))), 0)
    rows = docs.select(F.col(id_col).alias("id"), F.explode(counted).alias("w")).select("id", "w.term", "w.len")
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def index_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ref_col: str | None = None) -> DataFrame:
    """n_docs, avg_tokens, total_tokens and, with ref_col, unique_refs."""
    n = F.size(text.tokens(F.col(text_col)))
    refs = [F.count_distinct(ref_col).alias("unique_refs")] if ref_col else []
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_tokens"), F.coalesce(F.sum(n), F.lit(0)).alias("total_tokens"), *refs)


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, score, rank) of the k best documents a query (query_id, query); repeated query terms count; ties by id; scores above 0.

    Builds an index for this search alone; keep a KeywordIndex where there is more than one.
    """
    from casemill.operators.index import KeywordIndex
    from casemill.sources.scratch import folder

    kind = docs.schema[id_col].dataType.simpleString()
    return KeywordIndex(docs.sparkSession, folder(docs.sparkSession, "keywords"), lite=True, id_type=kind).build(docs, id_col=id_col, text_col=text_col).search(queries, k)


def top(scored: DataFrame, k: int, by: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows of each query_id with their rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def where(filters: dict) -> Column:
    """A condition from {column: value} or {column: {"$gte": value, ...}}; several are joined by AND."""
    ops = {
        "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
        "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: ~c.isin(*v),
    }
    out = F.lit(True)
    for name, value in filters.items():
        for op, operand in (value if isinstance(value, dict) else {"$eq": value}).items():
            out = out & ops[op](F.col(name), operand)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int, *, filters: dict | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) of the k nearest of each stated query (query_id, q); filters apply before scoring."""
    rows = vectors.filter(where(filters)) if filters else vectors
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.sqrt(dot(F.col(vector_col), F.col(vector_col))).alias("n"))
    asked = queries.select("query_id", "q", F.sqrt(dot(F.col("q"), F.col("q"))).alias("m"))
    score = F.when(F.col("n") * F.col("m") == 0, 0.0).otherwise(dot(F.col("v"), F.col("q")) / (F.col("n") * F.col("m")))
    few = asked.limit(QUERY_BLOCK + 1).count()
    if few <= QUERY_BLOCK:
        met = rows.crossJoin(F.broadcast(asked))  # a stated set of at most QUERY_BLOCK queries against all rows
    else:
        # more queries are cut into blocks of that size, and each block meets every row in a task of its own slice of them
        blocks = -(-asked.count() // QUERY_BLOCK)
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        slices = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        rows = rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")).withColumn("block", every(blocks))
        met = rows.join(asked.withColumn("slice", every(slices)), ["block", "slice"])
    return top(met.select("query_id", "id", F.round(score, 6).alias("score")), k)


def fuse(semantic: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """Reciprocal-rank fusion of two ranked frames; a side that lacks a row counts with rank 999 and score 0."""
    a = semantic.select("query_id", "id", F.col("score").alias("semantic_score"), F.col("rank").alias("semantic_rank"))
    b = keyword.select("query_id", "id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    both = a.join(b, ["query_id", "id"], "full_outer").fillna({"semantic_score": 0.0, "bm25_score": 0.0, "semantic_rank": MISSING_RANK, "bm25_rank": MISSING_RANK})
    fused = both.withColumn("fused", F.round(SEMANTIC_WEIGHT / (RRF_K + F.col("semantic_rank")) + KEYWORD_WEIGHT / (RRF_K + F.col("bm25_rank")), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "semantic_rank", "bm25_rank", "id")
    return fused.withColumn("fused_rank", F.row_number().over(order)).filter(F.col("fused_rank") <= k)


def rerank(results: DataFrame, k: int, *, as_of_year: int, issues: dict, evidence: dict, weights: dict = FACTORS) -> DataFrame:
    """results has query, query_region, text, year, region and fusion's columns; adds the factors, rerank_score, rerank_rank, explanation."""
    total = sum(weights.values())
    wanted, has = lexicons.categories(F.col("query"), issues), lexicons.categories(F.col("text"), issues)
    rows = results.withColumns({
        "issue": lexicons.jaccard(wanted, has),
        "temporal": lexicons.temporal_factor(F.col("year"), as_of_year),
        "region_match": lexicons.region_factor(F.col("query_region"), F.col("region")),
        "evidence": lexicons.jaccard(lexicons.categories(F.col("query"), evidence), lexicons.categories(F.col("text"), evidence)),
        "original": F.least(F.lit(1.0), F.col("fused") * 10),
        "shared": F.array_intersect(wanted, has),
    })
    parts = zip(("issue", "temporal", "region_match", "evidence", "original"), weights.values(), strict=True)
    rows = rows.withColumn("rerank_score", F.round(sum((F.col(c) * (w / total) for c, w in parts), F.lit(0.0)), 6))
    clauses = [
        F.when(F.size("shared") > 0, F.concat(F.lit("Matches issues: "), F.array_join(F.transform("shared", lambda x: F.replace(x, F.lit("_"), F.lit(" "))), ", "))),
        F.when(F.col("temporal") >= 0.9, F.concat(F.lit("Recent case ("), F.col("year"), F.lit(")"))).when(F.col("temporal") >= 0.7, F.concat(F.lit("Relatively recent ("), F.col("year"), F.lit(")"))),
        F.when((F.col("region_match") >= 0.9) & (F.col("region") != ""), F.concat(F.lit("Same region ("), F.col("region"), F.lit(")"))),
        F.when(F.col("semantic_score") >= 0.7, "Strong semantic similarity").when(F.col("semantic_score") >= 0.5, "Good semantic match"),
        F.when((F.col("bm25_score") > 0) & (F.col("bm25_rank") <= 5), "Strong keyword match"),
    ]
    said = F.array_join(F.array_compact(F.array(*clauses)), "; ")
    rows = rows.withColumn("explanation", F.when(said == "", "General relevance").otherwise(said)).drop("shared")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "fused_rank", "id")
    return rows.withColumn("rerank_rank", F.row_number().over(order)).filter(F.col("rerank_rank") <= k)


# Why a confidence is low.
NOT_BUILT, NO_CANDIDATES, NO_RESULTS = "Index not built. Run ingest first.", "No matching cases found in the database.", "No matching cases found."
NOVEL = "No sufficiently similar cases found. Your situation may be novel or the query needs refinement."
FEW, LOW = "Few relevant cases found. Results should be interpreted with caution.", "Low confidence in results. Consider consulting a legal professional."


def enrich(fused: DataFrame, texts: DataFrame) -> DataFrame:
    """fused rows with text and metadata (id, text, case_reference, section, year, region) from the store; what it lacks has its default."""
    rows = fused.join(texts, "id", "left")
    defaults = {"text": "", "case_reference": "", "section": "unknown", "year": 0, "region": ""}
    return rows.fillna({c: v for c, v in defaults.items() if c in rows.columns})


def confidence(results: DataFrame, queries: DataFrame, candidates: DataFrame | None = None, *, built: bool = True) -> DataFrame:
    """One row a query of the stated frame: confidence, is_uncertain, reason, n_results; queries without results stay, with 0.

    The reason of such a query tells an index that is not built from no candidates (query_id; None: not known) and no results.
    """
    best3 = F.when(F.col("rerank_rank") <= 3, F.col("fused"))
    per = results.groupBy("query_id").agg(
        F.count("*").alias("n_results"), F.max_by("semantic_score", -F.col("rerank_rank")).alias("top"), (F.max(best3) - F.min(best3)).alias("spread"),
        F.count_if(F.col("semantic_score") >= 0.4).alias("good"),
    )
    rows = queries.select("query_id").join(per, "query_id", "left")
    found = candidates.select("query_id").distinct().withColumn("found", F.lit(True)) if candidates is not None else queries.select("query_id").distinct().withColumn("found", F.lit(True))
    rows = rows.join(found, "query_id", "left")
    a = F.when(F.col("top") >= 0.7, 1.0).when(F.col("top") >= 0.5, 0.7).when(F.col("top") >= 0.3, 0.4).otherwise(0.2)
    b = F.when(F.col("n_results") < 3, 0.5).when(F.col("spread") < 0.1, 0.8).when(F.col("spread") < 0.2, 0.6).otherwise(0.4)
    c = F.when(F.col("good") >= 4, 1.0).when(F.col("good") >= 2, 0.7).when(F.col("good") >= 1, 0.4).otherwise(0.1)
    rows = rows.withColumn("confidence", F.when(F.col("n_results").isNull(), 0.0).otherwise(F.round((a + b + c) / 3, 6)))
    nothing = F.lit(NOT_BUILT) if not built else F.when(F.col("found").isNull(), NO_CANDIDATES).otherwise(NO_RESULTS)
    why = F.when(F.col("n_results").isNull(), nothing).when(F.col("top") < 0.3, NOVEL).when(F.col("good") < 2, FEW).otherwise(LOW)
    return rows.select("query_id", F.coalesce("n_results", F.lit(0)).alias("n_results"), "confidence", (F.col("confidence") < 0.5).alias("is_uncertain"), F.when(F.col("confidence") < 0.5, why).alias("reason"))


def abstain(conf: Column, uncertain: Column, n: Column, *, least: float = 0.5, fewest: int = 3) -> Column:
    """The cite-or-abstain gate; with no retrieval at all (null) nothing is gated."""
    return F.when(n.isNull(), "proceed").when(uncertain | (conf < least), "abstain_confidence").when(n < fewest, "abstain_cases").otherwise("proceed")


def precision(results: DataFrame, relevant: Column, k: int, rank: str = "rank") -> DataFrame:
    """(query_id, precision): the share of a query's first k that is relevant."""
    return results.filter(F.col(rank) <= k).groupBy("query_id").agg(F.round(F.avg(relevant.cast("int")), 6).alias("precision"))
