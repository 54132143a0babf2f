"""Files with metadata, the ledger, graphs on disk, message steps and predictions on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casemill.functions import records
from casemill.functions import text as T
from casemill.operators import graph, intake, ledger, predict, store
from casemill.sources import files
from tests.test_operators import CASE, case



def now():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


def test_scan_with_metadata(spark, tmp_path):
    for name, meta in (("LON_1", '{"title": "A v B", "year": 2021}'), ("LON_2", "{broken")):
        (tmp_path / "deposit" / "2019" / name).mkdir(parents=True)
        (tmp_path / "deposit" / "2019" / name / "a.pdf").write_bytes(b"one\f \ftwo")
        (tmp_path / "deposit" / "2019" / name / "metadata.json").write_text(meta)
    rows = files.binary_files(spark, str(tmp_path), as_of_year=2024)
    assert files.scan_status(rows).first()["status"] == "ok" and files.scan_status(rows.limit(0)).first()["status"] == "no_pdfs_found"
    with pytest.raises(Exception, match="(?i)path"):
        files.binary_files(spark, str(tmp_path / "nowhere")).count()
    read = lambda data: (data.decode().split("\f"), {"author": "X", "creation_date": "2020"})
    text = files.extract_text(rows, read).collect()
    assert {(r["text"], r["page_count"], r["author"], r["title"], r["error"]) for r in text} == {("one\n\ntwo", 3, "X", None, None)}
    both = files.with_metadata(rows.select("path", "case_reference", "year"), files.companion_metadata(spark, str(tmp_path), "title string, year int"))
    assert sorted((r["case_reference"], r["title"] or "", r["year"]) for r in both.collect()) == [("LON_1", "A v B", 2021), ("LON_2", "", 2019)]


def test_pii_offsets(spark):
    text = "a@b.org  or 12-34-56, 12-34-56, c@d.org"
    row = spark.createDataFrame([(text,)], "t string").select(T.detect_pii(F.col("t"))).first()[0]
    assert [(p["kind"], text[p["start"] : p["end"]] == p["text"]) for p in row] == [("email", True)] * 2 + [("bank", True)] * 2


def test_pages(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    html = '<html><head><meta name="DC.date" content="2020-02-30"></head>dated 3 March 2021</html>'
    assert one(records.decision_date(F.lit("dated 3 March 2021"), F.lit(html))) == dt.date(2021, 3, 3)
    assert one(records.case_url(F.lit("http://b"), F.lit("/c/"), F.lit(2020), F.lit("LON_1"), "pdf")) == "http://b/c/2020/LON_1.pdf"
    assert one(records.index_entries(F.lit("no list"), F.lit(2020))) == []
    assert one(ledger.output_folder(F.lit("none"), F.lit(2020), F.lit("X"))) == "other-cases/2020/X"


def test_ledger_tables(spark, tmp_path):
    rows = spark.createDataFrame([("A", "<p>", None, 2020, "deposit"), ("B", None, b"%PDF", 2021, "other"), ("C", None, None, 2021, "other")], "case_reference string, html string, pdf binary, year int, category string")
    ledger.write_pages(rows, str(tmp_path / "raw"))
    assert {(r["case_reference"], r["year"]) for r in spark.read.parquet(str(tmp_path / "raw")).collect()} == {("A", 2020), ("B", 2021)}
    bad = spark.createDataFrame([("A", "x"), ("B", None)], "case_reference string, error_message string")
    ledger.append(ledger.errors(bad, now()), str(tmp_path / "errors"))
    ledger.append(ledger.errors(bad, now()), str(tmp_path / "errors"))
    assert spark.read.parquet(str(tmp_path / "errors")).count() == 2
    envelope, lines = store.export_ordered(spark.createDataFrame([("A", 2019), ("C", 2020), ("B", 2020)], "case_reference string, year int"), now())
    assert envelope.first()["total"] == 3 and ['"B"' in r["json"] for r in lines.collect()] == [True, False, False]


def test_graphs_on_disk(spark, tmp_path):
    cases = spark.createDataFrame([case(), case(case_id=2, events=[("visit", dt.date(2019, 1, 1), "x"), ("visit", dt.date(2022, 1, 1), "x")])], CASE)
    nodes, edges = graph.nodes(cases), graph.edges(cases)
    odd = nodes.limit(1).withColumn("node_type", F.lit("alien")).withColumn("case_id", F.lit(3))
    graph.save_graphs(nodes.unionByName(odd), edges, str(tmp_path))
    got, got_edges, dropped = graph.load_graphs(spark, str(tmp_path))
    key = lambda f: sorted(map(str, f.collect()))
    assert key(got.select("case_id", "node_id", "node_type", "label", "date")) == key(nodes.withColumn("case_id", F.col("case_id").cast("long"))) and got_edges.count() == edges.count() and dropped.count() == 1
    assert graph.validate(cases.filter("case_id = 2")).first()["warnings"] == ["Before tenancy start: visit"] and not graph.validate(cases.filter("case_id = 2"), strict=True).first()["is_consistent"]
    assert graph.check_dates(cases.filter("case_id = 2")).first()["findings"] == ["Event visit before start date", "Event visit after end date"]
    assert graph.nodes_of_type(nodes, "issue").count() == 2
    assert graph.required_nodes(nodes.filter("node_id = 'party_tenant'")).first()["warnings"] == ["Fewer than two parties", "Neither property nor lease", "No issues"]
    near = graph.neighbours(edges, spark.createDataFrame([(1, "lease")], "case_id int, node_id string")).collect()
    assert [(r["other"], r["edge_type"]) for r in near] == [("property", "LEASE_FOR")]
    two = spark.createDataFrame([case(claims=[("landlord", "11", "garden", 1.0, "x", []), ("tenant", "1", "cleaning", 5.0, "stains", ["e1"])])], CASE)
    target = lambda **o: graph.edges(two, **o).filter("edge_type = 'EVIDENCE_SUPPORTS'").first()["dst"]
    assert target() == "claim_tenant_1" and target(contains=True) == "claim_landlord_11"


def test_message_steps(spark):
    said = [(1, 0, "hello", None), (1, 1, "I am a tenant", "tenant"), (1, 2, "?", None), (1, 3, "??", None), (1, 4, "a date", None)]
    messages = spark.createDataFrame(said, "session_id long, seq long, text string, role string")
    answers = spark.createDataFrame([(1, 1, '{"address": {"value": "1 High St", "confidence": 0.5}}'), (1, 2, "{broken"), (1, 3, '{"no_new_info": true}'), (1, 4, '{"start_date": "2020-01-01"}')], "session_id long, seq long, answer string")
    out = intake.message_step(messages, answers, {"address": "string", "start_date": "string"}).orderBy("seq").collect()
    assert [(r["stage"], r["tries"]) for r in out] == [("greeting", 0), ("tenancy_details", 0), ("tenancy_details", 1), ("tenancy_details", 2), ("deposit_details", 0)]
    assert [r["address"] for r in out] == [None] + ["1 High St"] * 4 and out[4]["start_date"] == "2020-01-01"
    found = intake.extracted_fields(answers, {"address": "string", "start_date": "string"}).orderBy("seq").collect()
    assert [(r["no_new_info"], r["avg_confidence"]) for r in found] == [(False, 0.5), (True, 0.0), (True, 0.0), (False, 1.0)]
    assert intake.next_stage("basic_details", 2, {"address"}, "", True, carry_tries=True) == ("tenancy_details", 2)
    assert intake.stage_fold(messages.limit(0).withColumn("fields", F.array(F.lit("x")))).collect() == []


def test_responses(spark):
    rows = spark.createDataFrame([case(), case(case_id=2, user_role=None)], CASE).withColumn("stage", F.when(F.col("case_id") == 1, "basic_details").otherwise("greeting"))
    out = {r["case_id"]: r for r in intake.respond(rows, predict.Canned("hi"), {"tenant": {"basic_details": "Ask."}}).collect()}
    assert out[1]["answer"] == "hi" and out[1]["context"].startswith("Ask.\n\nINFORMATION") and out[2]["answer"] == intake.GREETING
    assert spark.range(1).select(intake.issue_of(F.lit("A Dirty floor")), intake.evidence_of(F.lit("my PHOTO"))).first()[:] == ("cleaning", "photos_after")


class Busy:
    def complete(self, prompts):
        raise predict.RateLimited


def test_predictions_are_stored(spark, tmp_path):
    cases = spark.createDataFrame([case(), case(case_id=2)], CASE).withColumn("facts", intake.case_summary())
    got = spark.createDataFrame([(2, "abstain_cases", None)], "case_id int, gate string, context string")
    model = predict.Fallback(Busy(), predict.Canned('{"overall_outcome": "tenant_win"}'))
    out = predict.predict_and_store(cases.select("case_id"), cases, got, model, str(tmp_path), now()).orderBy("case_id").collect()
    assert [(r["outcome"], r["confidence"], r["reason"]) for r in out] == [("tenant_favored", 0.5, None), ("uncertain", 0.0, "abstain_cases")]
    assert graph.load_graphs(spark, str(tmp_path / "graphs"))[0].count() > 10
    with pytest.raises(Exception, match="no such case"):
        predict.predict_and_store(spark.createDataFrame([(9,)], "case_id int"), cases, got, model, str(tmp_path), now())
    prompt = spark.range(1).select(predict.prompt_with_schema(F.lit("p"), "a int")).first()[0]
    assert prompt.startswith("p\n\n") and prompt.endswith("a int")
    assert spark.range(1).select(predict.cost(F.lit(2_000_000), F.lit(3.0)), predict.cost(F.lit(1), F.lit(None).cast("double"))).first()[:] == (6.0, None)


def test_sync_fills_what_is_empty(spark):
    disputes = spark.createDataFrame([(1, "", None, 0.0, False, True, "in_progress"), (2, "kept", "N1", 5.0, False, False, "in_progress")], "dispute_id int, property_address string, property_postcode string, deposit_amount double, tenant_complete boolean, landlord_complete boolean, status string")
    cases = spark.createDataFrame([(1, "landlord", False, "L St", "L1", None), (1, "tenant", True, "T St", None, 7.0)], "dispute_id int, role string, intake_complete boolean, property_address string, property_postcode string, deposit_amount double")
    got = [tuple(r) for r in intake.sync_disputes(disputes, cases).orderBy("dispute_id").collect()]
    assert got == [(1, "T St", "L1", 7.0, True, True, "both_complete"), (2, "kept", "N1", 5.0, False, False, "in_progress")]
    rows = spark.createDataFrame([(1, 2)], "k int, v int")
    assert [tuple(r) for r in store.delete(rows, rows, "k").collect()] == []
