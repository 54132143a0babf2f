"""Chunks, records, store, graph, intake, prediction and streams on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casemill.functions import lexicons, records
from casemill.operators import chunking, graph, intake, predict, store
from casemill.sources import files
from casemill.streaming import windows


def test_pack_sentences():
    assert chunking.pack_sentences([4, 3, 3, 2, 9], 10, 3) == [[0, 1, 2], [2, 3], [3, 4]]
    assert chunking.pack_sentences([], 10, 3) == []
    assert chunking.pack_sentences([20, 2], 10, 3) == [[0], [1]]


def test_sections(spark):
    text = "lost\nDECISION\nfirst\n1. Facts\nwhat happened\nDecision\n\nDECISION\nlast"
    rows = chunking.sections(spark.createDataFrame([(1, text), (2, "no heading"), (3, None)], "doc_id int, text string")).orderBy("id", "ord").collect()
    assert [(r["id"], r["section"], r["body"]) for r in rows] == [(1, "facts", "what happened"), (1, "decision", "last"), (2, "unknown", "no heading")]


def test_chunk_ids(spark):
    text = "BACKGROUND\n" + " ".join(f"Word{i} here." for i in range(30)) + "\nDECISION\nDone."
    rows = chunking.chunks(spark.createDataFrame([(5, text)], "doc_id int, text string"), 20, 6).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in rows] == [f"5_{i}" for i in range(len(rows))] and rows[-1]["text"] == "Done." and len(rows) > 3
    with pytest.raises(ValueError):
        chunking.token_windows(spark.createDataFrame([(5, text)], "doc_id int, text string"), 5, 5)


def test_references(spark):
    frame = spark.createDataFrame([("LON_00BK_HMF_2022_0043",), ("A_B",), ("CHI_45UG_2021_1",)], "r string")
    got = frame.select(records.reference_region(F.col("r")), records.reference_type(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("LON", "HMF"), (None, None), ("CHI", None)]
    assert spark.range(1).select(lexicons.code_name(F.lit("xx"), lexicons.REGIONS)).first()[0] == "Unknown (xx)"


def test_records(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(records.decision_date(F.lit("Decision dated 3 March 2021."))) == dt.date(2021, 3, 3)
    assert one(records.parse_date(F.lit("31/12/2020"))) == dt.date(2020, 12, 31) and one(records.parse_date(F.lit("99/99/2020"))) is None
    assert one(records.parties(F.lit("Smith v. Jones"))) == "Smith v Jones" and one(records.parties(F.lit("Smith and Jones"))) == "Smith & Jones"
    assert one(records.judge(F.lit("Before: Judge Ann Lee"))) == "Ann Lee"
    assert one(records.html_text(F.lit("<p>a</p><script>x='</p>'</script><!-- b -->c &amp; d"))) == "a c & d"
    assert one(records.fenced_json(F.lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}'
    assert one(records.unwrap(F.lit('{"a": {"value": 3, "confidence": 0.5}}'), "a")) == "3"
    assert one(records.reference_from_path(F.lit("x/LON_1/decision/a.pdf"))) == "LON_1"


def test_upsert_keeps_first_values(spark):
    rows = spark.createDataFrame([("k1", 1, 2020, "u1", "pending"), ("k1", 2, 2021, "u2", "complete")], "k string, seq int, year int, url string, status string")
    assert store.upsert(rows, "k", "seq", ["year", "url"]).first().asDict() == {"k": "k1", "year": 2020, "url": "u1", "status": "complete"}


def test_store(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(1, None, "z"), (3, "q", "q")], "k int, v string, w string")
    assert [tuple(r) for r in store.update(rows, new, "k").orderBy("k").collect()] == [(1, "a", "z"), (2, "b", "y")]
    assert [r["k"] for r in store.unseen(rows, new, "k").collect()] == [2]
    assert sorted(map(tuple, store.difference(rows, new, "k").collect())) == [(2, "left_only"), (3, "right_only")]
    good, bad = store.quarantine(rows, {"w": F.col("w") == "y"})
    assert good.count() == 1 and bad.first()["failed_rules"] == ["w"]
    assert store.export(rows.limit(0)).count() == 0


CASE = "case_id int, user_role string, tenant_name string, landlord_name string, agent_name string, address string, start_date date, end_date date, deposit_amount double, deposit_protected boolean, protection_date date, issues array<string>, evidence array<struct<id:string,type:string,description:string>>, claims array<struct<party:string,id:string,issue:string,amount:double,description:string,evidence_ids:array<string>>>, events array<struct<type:string,date:date,description:string>>"


def case(**over):
    d = dt.date
    row = dict(case_id=1, user_role="tenant", tenant_name="T", landlord_name=None, agent_name=None, address="1 High St", start_date=d(2020, 1, 1), end_date=d(2021, 1, 1), deposit_amount=900.0, deposit_protected=True, protection_date=d(2020, 1, 11),
               issues=["cleaning"], evidence=[("e1", "receipts", "x")], claims=[("tenant", "1", "cleaning", 5.0, "stains", ["e1"])], events=[("visit", None, "x")])
    return tuple((row | over).values())


def test_graph_rules(spark):
    frame = lambda **o: spark.createDataFrame([case(**o)], CASE)
    rules = lambda **o: graph.validate(frame(**o)).first()
    assert rules()["is_consistent"] and rules()["warnings"] == []
    assert not rules(end_date=dt.date(2019, 1, 1))["is_consistent"]
    late = rules(protection_date=dt.date(2020, 2, 15))
    assert "45" in late["warnings"][0] and late["is_consistent"]
    assert len(rules(issues=["deposit_protection"], claims=[], evidence=[("e", "deposit_certificate", "")])["warnings"]) == 1
    assert rules(issues=["garden"], claims=[])["warnings"] == ["Issues without evidence: garden"]
    assert "No issues" in rules(issues=[])["warnings"]
    found = {r["node_type"]: r["n"] for r in graph.nodes(frame()).groupBy("node_type").agg(F.count("*").alias("n")).collect()}
    assert found == {"party": 2, "property": 1, "lease": 1, "evidence": 1, "issue": 1, "claimed_amount": 1, "event": 4}
    kinds = sorted(r["edge_type"] for r in graph.edges(frame()).collect())
    assert kinds == ["CLAIM_RELATES_TO", "EVENT_BEFORE", "EVENT_BEFORE", "EVIDENCE_RELATES_TO", "EVIDENCE_SUPPORTS", "LEASE_FOR", "PARTY_CLAIMS", "PARTY_OWNS", "PARTY_RENTS"]


def test_stages():
    assert intake.next_stage("basic_details", 0, {"address"}, "", True) == ("tenancy_details", 0)
    assert intake.next_stage("basic_details", 2, set(), "", True) == ("tenancy_details", 0)
    assert intake.next_stage("evidence_collection", 0, set(), "", True) == ("claim_amounts", 0)
    assert intake.next_stage("confirmation", 0, set(), "That's RIGHT", True)[0] == "complete"
    assert intake.next_stage("confirmation", 0, set(), "no", True)[0] == "confirmation"


def test_predictions(spark):
    answers = ['```json\n{"overall_outcome": "landlord_win", "overall_confidence": 0.7, "predicted_settlement_range": [1, 2], "reasoning_trace": [{"citations": [{"case_reference": "a"}]}], "issue_predictions": [{"issue_type": "cleaning", "supporting_cases": [{"case_reference": "b", "year": 2019}]}]}\n```', "oops", '{"overall_outcome": "odd", "predicted_settlement_range": [1]}']
    rows = predict.parse(spark.createDataFrame([(a,) for a in answers], "answer string")).collect()
    assert [(r["outcome"], r["confidence"], r["is_fallback"], r["low"], r["n_citations"]) for r in rows] == [("landlord_favored", 0.7, False, 1.0, 2), ("uncertain", 0.3, True, None, 0), ("uncertain", 0.5, False, None, 0)]
    step, raw, issue = rows[0]["steps"][0], rows[1]["steps"][0], rows[0]["issues"][0]
    assert (step["step"], step["confidence"], step["citations"][0]["year"], issue["outcome"], issue["citations"][0]["year"]) == (1, 0.7, 2022, "uncertain", 2019)
    assert (raw["content"], raw["confidence"], raw["title"]) == ("oops", 0.3, "Raw Analysis")
    out = predict.generate(spark.createDataFrame([("p",)], "prompt string"), predict.Canned("x")).first()
    assert out["answer"] == "x"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, m), 1, "a", 2.0) for h in range(4) for m in (0, 20, 50)], "ts timestamp, user_id int, event_type string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windows.read_events(spark, str(tmp_path / "in"), rows.schema)
    query = windows.tumbling(stream).writeStream.format("memory").queryName("t").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("t").collect())) == sorted(map(tuple, windows.tumbling(rows).collect()))


def test_files(spark, tmp_path):
    (tmp_path / "deposit-cases" / "LON_1").mkdir(parents=True)
    (tmp_path / "deposit-cases" / "LON_1" / "a.pdf").write_bytes(b"hello")
    (tmp_path / "deposit-cases" / "LON_1" / "b.pdf").write_bytes(b" ")
    rows = files.binary_files(spark, str(tmp_path))
    assert {(r["case_reference"], r["category"]) for r in rows.collect()} == {("LON_1", "deposit")}
    got = {r["error"] for r in files.extract_text(rows, lambda b: b.decode()).collect()}
    assert got == {None, "no text"}
    (tmp_path / "a.json").write_text('{"k": 1}')
    (tmp_path / "b.json").write_text("{broken")
    assert [r["k"] for r in files.json_folder(spark, str(tmp_path / "*.json"), "k int").collect()] == [1]


def test_a_running_mean_of_one_day_runs_in_many_tasks(spark):
    from casemill.operators import stats

    rows = [(i, "2024-01-01 10:00:00" if 50 < i < 250 else f"2024-01-01 {11 if i > 99 else 9}:00:{i % 60:02d}", None if i % 9 == 0 else float(i % 7)) for i in range(300)]
    log = spark.createDataFrame(rows, "id int, at string, hits double")
    out = stats.running_mean(log, "hits", "at", tie="id", parts=6)
    got = {r["id"]: r["running_mean"] for r in out.collect()}
    total, n = 0.0, 0
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        total, n = total + (v or 0.0), n + (v is not None)
        assert got[i] == (pytest.approx(total / n) if n else None)
    ranges = out._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert len(got) == 300 and ranges.size() == 2
    assert stats.running_mean(log.limit(0), "hits", "at").collect() == []
    twice = stats.running_mean(log.unionAll(log), "hits", "at", parts=4)
    assert twice.count() == 600
