"""The stored index, the engine, its command line and the SQL functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from casemill import __main__ as cli
from casemill.engine import Engine
from casemill.functions import sql
from casemill.functions import text as T
from casemill.operators import retrieval as R
from casemill.operators.index import KeywordIndex

CHUNKS = [(0, "deposit not protected section", "a"), (1, "cleaning charges disputed", "a"), (2, "deposit protected late", "b"), (3, "garden overgrown", "c"), (4, "rent arrears owed rent", "c"), (5, "walls painting", "c")]


def asked(spark, *queries):
    return spark.createDataFrame([(i + 1, q, "LON") for i, q in enumerate(queries)], "query_id int, query string, query_region string")


def test_index_in_two_batches_equals_one(spark, tmp_path):
    docs = spark.createDataFrame([*CHUNKS, (6, None, "d")], "doc_id int, text string, ref string")
    queries = asked(spark, "deposit protected", "rent rent", "zzz", "")
    one = KeywordIndex(spark, str(tmp_path / "one"), id_type="int").build(docs, ref_col="ref")
    two = KeywordIndex(spark, str(tmp_path / "two"), buckets=3, slices=2, lite=True, id_type="int")
    assert not two.is_built() and two.search(queries, 5).collect() == []
    two.build(docs.filter("doc_id < 3"), ref_col="ref").build(docs.filter("doc_id >= 3"), ref_col="ref", mode="append")
    hits = [sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in i.search(queries, 5).collect()) for i in (one, two)]
    assert hits[0] == hits[1] and [h[2] for h in hits[0]] == [2, 0, 4]
    assert one.stats().first().asDict() == two.stats().first().asDict() and one.stats().first()["unique_refs"] == 4
    assert [h["id"] for h in one.search(queries, 5, within=spark.createDataFrame([(0,)], "id int")).collect()] == [0]
    ids = spark.createDataFrame([(2,), (9,)], "id int")
    assert [tuple(r) for r in one.get(ids).collect()] == [(2, "b", "deposit protected late")] and "text" not in two.get(ids).columns
    two.build(docs.filter("doc_id = 2").withColumn("ref", F.lit("later")), ref_col="ref", mode="append")
    assert two.get(ids).first()["ref"] == "later"
    two.clear()
    assert not two.is_built()
    two.clear()


def words_of(n, seed=3):
    import random

    rng = random.Random(seed)
    common, rare = [f"c{i:02d}" for i in range(12)], [f"r{i:03d}" for i in range(300)]
    return [(i, " ".join(rng.choices(common, k=rng.randint(3, 40)) + rng.choices(rare, k=rng.randint(0, 3))), f"f{i % 5}") for i in range(n)]


def test_search_with_early_termination_equals_a_full_one(spark, tmp_path):
    docs = spark.createDataFrame(words_of(1500), "doc_id int, text string, ref string")
    index = KeywordIndex(spark, str(tmp_path / "i"), id_type="int", block=16, slices=2).build(docs.filter("doc_id < 900")).build(docs.filter("doc_id >= 900"), mode="append")
    queries = asked(spark, "r001 c01 c02 c03", "c01 c02", "r005 r006 r007 c09 c10 c11 c09", "r299", "none")
    rows = lambda f: sorted(map(tuple, f.select("query_id", "rank", "id", "score").collect()))
    full = rows(index.search(queries, 7))
    assert rows(index.search(queries, 7, direct=0)) == full and len(full) > 25
    one = KeywordIndex(spark, str(tmp_path / "o"), id_type="int").build(docs)
    assert rows(one.search(queries, 7)) == full
    before = one.stats().first(), sorted(map(tuple, one.idf().collect()))
    index.compact()
    assert (index.stats().first(), sorted(map(tuple, index.idf().collect()))) == before and rows(index.search(queries, 7, direct=0)) == full
    assert {f["of"] for f in index.tables.files("postings")} == {8}


def test_blocks_below_the_floor_are_skipped(spark, tmp_path):
    """Common terms do not lead: of their blocks only those around the documents of rare terms are opened."""
    rows = [(i, f"c01 c01 u{i} " + ("r001 r001" if i % 500 == 7 else "filler words"), "") for i in range(4000)]
    index = KeywordIndex(spark, str(tmp_path / "i"), id_type="int", block=16).build(spark.createDataFrame(rows, "doc_id int, text string, ref string"))
    opened = []
    kept = index._parts

    def parts(met, avg):
        opened.append(met.count())
        return kept(met, avg)

    index._parts = parts
    found = index.search(asked(spark, "r001 c01"), 5, direct=0).collect()
    assert [r["id"] for r in sorted(found, key=lambda r: r["rank"])] == [7, 507, 1007, 1507, 2007]
    # 250 blocks of c01, of which eight hold a document with r001
    assert sum(opened) <= 1 + 1 + 8 and index.tables.read("postings").filter("term = 'c01'").count() == 250


def test_a_search_reads_only_the_files_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame(words_of(600), "doc_id int, text string, ref string")
    index = KeywordIndex(spark, str(tmp_path / "i"), id_type="int", buckets=16).build(docs)
    files = index.tables.files("postings")
    some = index._of_terms(files, ["r001", "r002"])
    assert len(files) == 16 and 1 <= len(some) <= 2
    opened = index.tables.read("postings", files=some).filter(F.col("term").isin("r001", "r002"))
    assert "PushedFilters: [In(term, [r001,r002])]" in opened._jdf.queryExecution().toString()
    assert opened.count() == index.tables.read("postings").filter("term in ('r001', 'r002')").count() >= 2
    # one more document touches the buckets of its own terms, and no file is written anew
    index.build(spark.createDataFrame([(9000, "r001 brandnew", "z")], "doc_id int, text string, ref string"), ref_col="ref", mode="append")
    later = index.tables.files("postings")
    assert later[:16] == files and len(later) <= 18 and index.search(asked(spark, "brandnew"), 3).first()["id"] == 9000


def test_many_queries_are_cut_into_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "vec_id int, embedding array<double>")
    queries = spark.createDataFrame([(i, [1.0, float(i), 2.0]) for i in range(20)], "query_id int, q array<double>")
    few = sorted(map(tuple, R.cosine_top(vectors, queries, 5).collect()))
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, R.cosine_top(vectors, queries, 5).collect())) == few and len(few) == 100


def test_a_hit_without_a_text_stays(spark):
    fused = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.4)], "query_id int, id int, fused double")
    rows = R.enrich(fused, spark.createDataFrame([(7, "t", 2020, None)], "id int, text string, year int, region string")).orderBy("id").collect()
    assert [(r["text"], r["year"], r["region"]) for r in rows] == [("t", 2020, ""), ("", 0, "")]


def test_reasons_of_empty_results(spark):
    none = spark.createDataFrame([], "query_id int, semantic_score double, fused double, rerank_rank int")
    queries, found = asked(spark, "x", "y"), spark.createDataFrame([(2,)], "query_id int")
    reasons = lambda **o: [r["reason"] for r in R.confidence(none, queries, found, **o).orderBy("query_id").collect()]
    assert reasons() == [R.NO_CANDIDATES, R.NO_RESULTS] and reasons(built=False) == [R.NOT_BUILT] * 2


DOCS = [
    ("LON_1", "BACKGROUND\nThe tenant paid a deposit. It was not protected.\nDECISION\nThe deposit is due.", 2023, "LON", "HMF", None), ("MAN_2", "Rent arrears were owed. Nothing else was said.", 2015, "MAN", "", None),
    ("CHI_3", " \n ", 2020, "CHI", "LSC", None), ("CHI_4", None, 2020, "CHI", "LSC", "broken file"),
]
DOC = "case_reference string, text string, year int, region string, case_type string, error string"


def test_engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "engine"))
    queries = asked(spark, "deposit protection", "rent")
    assert engine.get_stats().first()["chunks"] == 0 and engine.retrieve(queries).collect() == []
    assert {r["reason"] for r in engine.confidence(engine.retrieve(queries), queries).collect()} == {R.NOT_BUILT}
    assert engine.ingest(spark.createDataFrame(DOCS, DOC)).first().asDict() == {"total": 4, "processed": 2, "skipped": 1, "failed": 1, "chunks": 3}
    again = engine.ingest(spark.createDataFrame(DOCS, DOC)).first().asDict()
    assert again["processed"] == 2 and again["chunks"] == 0 and engine.chunks().count() == 3
    found = engine.retrieve(queries).collect()
    best = {r["query_id"]: r for r in found if r["rerank_rank"] == 1}
    assert best[1]["case_reference"] == "LON_1" and best[1]["section"] in ("background", "decision") and "Same region (LON)" in best[1]["explanation"]
    only = engine.retrieve(queries, where={"region": "MAN"}, scope="both").collect()
    assert {r["case_reference"] for r in only} == {"MAN_2"}
    # without the scope the keyword branch brings back what the filter left out, as in the reference
    assert {r["case_reference"] for r in engine.retrieve(queries, where={"region": "MAN"}).collect()} == {"MAN_2", "LON_1"}
    assert engine.ingest_one("BIR_5", "A lawn was overgrown.", year=2024, region="BIR").first()["chunks"] == 1
    stats = engine.get_stats().first()
    assert (stats["chunks"], stats["cases"], stats["avg_chunks"], stats["regions"], stats["top_types"]) == (4, 3, 1.33, ["BIR", "LON", "MAN"], ["HMF"])
    assert engine.index.search(asked(spark, "lawn"), 3).first()["id"] == "BIR_5_0"
    engine.clear_index()
    assert engine.chunks().count() == 0 and not engine.index.is_built()
    engine.clear_index()


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame(DOCS, DOC).write.parquet(str(tmp_path / "docs"))
    run = lambda *a: cli.main(["--folder", str(tmp_path / "e"), *a], spark)
    run("ingest", str(tmp_path / "docs"))
    run("query", "deposit", "--region", "lon", "--top-k", "1")
    run("stats")
    said = capsys.readouterr().out
    assert "LON_1" in said and "processed" in said and "avg_chunks" in said
    run("clear")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--folder", "x", "unknown"])


def test_sql_functions_equal_the_columns(spark):
    assert sql.register(spark) == ["clean_text", "redact_pii", "bm25_tokens", "cosine_sim", "jaccard"]
    rows = spark.createDataFrame([("â\u0080\u0099a\n\n\n\nBACKGROUND\n\nmail x.y@z.org, 0207 123 4567  it's SW1A 1AA",), (None,), ("",)], "t string")
    got = rows.select(F.expr("clean_text(t)"), F.expr("redact_pii(t)"), F.expr("bm25_tokens(t)")).collect()
    want = rows.select(T.clean(F.col("t")), T.redact(F.col("t")), T.tokens(F.col("t"))).collect()
    assert list(map(tuple, got)) == list(map(tuple, want)) and "[EMAIL]" in got[0][0]
    one = lambda e: spark.range(1).select(F.expr(e)).first()[0]
    assert one("cosine_sim(array(1D, 0D), array(1D, 1D))") == pytest.approx(0.5**0.5) and one("cosine_sim(array(0D), array(1D))") == 0
    assert (one("jaccard(array('a','b'), array('b'))"), one("jaccard(array(), array('b'))"), one("jaccard(cast(array() as array<string>), cast(array() as array<string>))")) == (0.5, 0.3, 0.5)


def test_few_buckets_leave_no_large_task(spark, tmp_path, monkeypatch):
    """With two buckets and one slice a build had two tasks with rows, whatever its size; they are parted now, and nothing that is found changes."""
    from casemill.operators import index as module

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.concat(F.lit("w"), ((F.col("id") * 7 + i * i) % 300).cast("string"))), " ").alias("text"))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    asked = spark.createDataFrame([(1, "w1 w50 w299"), (2, "w7"), (3, "nothing")], "query_id int, query string")
    whole = KeywordIndex(spark, str(tmp_path / "whole"), buckets=2, slices=1, block=16).build(docs)
    found = sorted(map(tuple, whole.search(asked, 9).collect()))
    monkeypatch.setattr(module, "TASK_BYTES", 1024)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        parted = KeywordIndex(spark, str(tmp_path / "parted"), buckets=2, slices=1, block=16).build(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = parted.tables.files("postings")
    assert len(whole.tables.files("postings")) == 2 < 4 <= len(files) and {f["of"] for f in files} == {2} and len({f["parts"] for f in files}) == 1
    counts = [spark.read.parquet(f"{tmp_path}/parted/{f['path']}").count() for f in files]
    assert sum(counts) == whole.tables.read("postings").count() and max(counts) < sum(counts) / 2
    assert sorted(map(tuple, parted.search(asked, 9).collect())) == found and sorted(map(tuple, parted.postings().collect())) == sorted(map(tuple, whole.postings().collect()))
    for i in (whole, parted):
        change = i.tables.begin()
        i.remove(change, docs.filter("doc_id < 50").select(F.col("doc_id").alias("id")))
        change.commit()
    assert sorted(map(tuple, parted.postings().collect())) == sorted(map(tuple, whole.postings().collect())) and parted.stats().first() == whole.stats().first()
    assert sorted(map(tuple, parted.search(asked, 9).collect())) == sorted(map(tuple, whole.search(asked, 9).collect()))
