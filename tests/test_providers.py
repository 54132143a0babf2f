"""Embedding providers, disputes and persistence on literal rows."""

import pytest
from pyspark.sql import functions as F

from casemill.operators import embed, intake, store


def test_embeddings_are_deterministic_units(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "a b a"), (3, ""), (4, None)], "id int, t string")
    out = {r["id"]: r["embedding"] for r in embed.embed(rows, embed.HashedWords(8), "id", "t").collect()}
    assert out[1] == out[2] and sum(x * x for x in out[1]) == pytest.approx(1) and out[3] == out[4] == [0.0] * 8


def test_a_chunk_without_a_vector_is_an_error(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 2020), (2, 2021)], "id int, year int")
    vectors = spark.createDataFrame([(1, [0.5])], "id int, embedding array<double>")
    embed.append_vectors(vectors, chunks.filter("id = 1"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1
    with pytest.raises(Exception, match="no vector"):
        embed.append_vectors(vectors, chunks, str(tmp_path / "v"))


def test_disputes(spark):
    asked = spark.createDataFrame([(1, 10, "tenant"), (2, 20, "landlord")], "dispute_id int, session_id int, role string")
    made = intake.create_disputes(asked, spark.createDataFrame([], "code string"))
    rows = {r["dispute_id"]: r for r in made.collect()}
    assert (rows[1]["tenant_session_id"], rows[1]["status"], rows[2]["landlord_session_id"]) == (10, "waiting_for_landlord", 20)
    again = intake.create_disputes(asked, made.filter("dispute_id = 1"))
    codes = {r["dispute_id"]: r["code"] for r in again.collect()}  # a code in use is replaced, no request is lost
    assert codes[2] == rows[2]["code"] and codes[1] not in (rows[1]["code"], None) and len(codes[1]) == 8
    join = made.select(F.lower("code").alias("code"), F.lit(99).alias("session_id"), F.lit("tenant").alias("role"))
    joined = {r["dispute_id"]: (r["tenant_session_id"], r["landlord_session_id"]) for r in intake.join_disputes(made.drop("status"), join).collect()}
    assert joined == {1: (10, None), 2: (99, 20)}
    sessions = spark.createDataFrame([(99, True), (20, True)], "session_id int, is_complete boolean")
    status = {r["dispute_id"]: r["status"] for r in intake.dispute_status(intake.join_disputes(made.drop("status"), join), sessions).collect()}
    assert status == {1: "waiting_for_landlord", 2: "both_complete"}


def test_a_code_that_no_request_needs_is_free(spark):
    """sha256("72404#1") and sha256("151020#1") begin alike, but 72404 has the code of its first round and asks for no other."""
    asked = spark.createDataFrame([(72404, 1, "tenant"), (151020, 2, "tenant")], "dispute_id int, session_id int, role string")
    made = intake.create_disputes(asked, spark.createDataFrame([("117A9EC0",)], "code string"))
    assert {r["dispute_id"]: r["code"] for r in made.collect()} == {72404: "E5FF9D69", 151020: "11DB26E6"}
    # a code that two want goes to the smaller id, so no two disputes share one
    asked = spark.createDataFrame([(135277, 1, "tenant"), (3897, 2, "tenant")], "dispute_id int, session_id int, role string")
    codes = {r["dispute_id"]: r["code"] for r in intake.create_disputes(asked, spark.createDataFrame([], "code string")).collect()}
    assert codes[3897] == "75D93DBE" != codes[135277] and len(codes[135277]) == 8


def test_no_free_code_is_an_error(spark):
    asked = spark.createDataFrame([(151020, 2, "tenant")], "dispute_id int, session_id int, role string")
    with pytest.raises(Exception, match="no free invite code"):
        intake.create_disputes(asked, spark.createDataFrame([("117A9EC0",), ("11DB26E6",)], "code string"), rounds=2).collect()


@pytest.mark.parametrize("name", ["join_disputes", "join_outcomes"])
def test_disputes_of_one_code_are_told_apart(spark, tmp_path, name):
    """Each pair of keys has one code of eight places; of it both, or one of another slot, or neither asks."""
    import duckdb

    import __spark_entry__ as entry

    pairs = [(857916, 162268), (788644, 265722), (183012, 888193), (64707, 477814), (873975, 155286), (3897, 135277)]
    keys = [*range(20), *[k for pair in pairs for k in pair]]
    spark.createDataFrame([(k, "O") for k in keys], "o_orderkey long, o_orderstatus string").withColumn("o_orderdate", F.lit("1995-01-01").cast("date")).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = sorted(map(repr, map(tuple, entry.queries()[name](spark, str(tmp_path)).collect())))
    assert got == sorted(map(repr, con.execute(entry.oracle_sql()[name]).fetchall()))


def test_a_request_that_names_no_dispute_is_for_one(spark):
    disputes = spark.createDataFrame([(5, "AB", None, 9), (3, "AB", None, 8), (4, "CD", 7, None)], "dispute_id int, code string, tenant_session_id int, landlord_session_id int")
    asked = spark.createDataFrame([(" ab", 1, "tenant"), ("AB", 2, "tenant"), ("cd", 1, "tenant"), ("zz", 1, "tenant")], "code string, session_id int, role string")
    assert sorted(map(tuple, intake.join_outcomes(disputes, asked).collect())) == [("AB", 1, "tenant", "joined"), ("AB", 2, "tenant", "taken"), ("CD", 1, "tenant", "taken"), ("ZZ", 1, "tenant", "unknown")]
    assert {r["dispute_id"]: r["tenant_session_id"] for r in intake.join_disputes(disputes, asked).collect()} == {3: 1, 4: 7, 5: None}
    # a dispute that has another code, or is not there, is not found by its name
    named = spark.createDataFrame([("AB", 5, 1, "tenant"), ("AB", 4, 2, "tenant"), ("AB", 6, 3, "tenant")], "code string, dispute_id int, session_id int, role string")
    assert sorted(map(tuple, intake.join_outcomes(disputes, named).collect())) == [("AB", 1, "tenant", "joined"), ("AB", 2, "tenant", "unknown"), ("AB", 3, "tenant", "unknown")]
    assert {r["dispute_id"]: r["tenant_session_id"] for r in intake.join_disputes(disputes, named).collect()} == {3: None, 4: 7, 5: 1}


def test_json_by_key(spark, tmp_path):
    path = str(tmp_path / "j")
    store.save_json(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, "k")
    store.save_json(spark.createDataFrame([("b", 3)], "k string, v int"), path, "k")
    assert sorted(map(tuple, store.load_json(spark, path, "v int, k string").select("k", "v").collect())) == [("a", 1), ("b", 3)]
