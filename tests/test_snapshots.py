"""Tables that change together: versions, merges, conflicts, crashes, and the engine on top of them."""

import os

import pytest
from pyspark.sql import functions as F

from casemill.engine import Engine
from casemill.operators import store
from casemill.operators.index import KeywordIndex
from casemill.sources.snapshots import Conflict, Tables


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_merge_rewrites_only_the_files_it_touches(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))
    assert t.version() == 0 and t.read("x", "k long, v string").collect() == []
    frame = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    for low in (0, 100, 200):
        c = t.begin()
        c.append("x", frame(*[(low + i, "old") for i in range(10)]), key="k")
        c.commit()
    before = t.files("x")
    c = t.begin()
    c.merge("x", frame((103, "new"), (150, "more")), "k")
    assert c.commit() == 4
    after = t.files("x")
    assert [f["path"] for f in before if f in after] == [before[0]["path"], before[2]["path"]]
    assert rows(t.read("x").filter("k > 102 and k < 160")) == [(103, "new")] + [(k, "old") for k in range(104, 110)] + [(150, "more")] and t.read("x").count() == 31
    # readers may stay on a version, and read some keys from their files alone
    assert rows(t.read("x", version=3).filter("v = 'new'")) == [] and rows(t.read("x", key="k", keys=[205, 999])) == [(205, "old")]
    assert [f["path"] for f in t.files("x", keys=[205])] == [before[2]["path"]]
    c = t.begin()
    c.delete("x", frame((0, ""), (777, "")).select("k"), "k")
    c.merge("x", frame((1, "again")), "k", lambda old, new: store.upsert(old.withColumn("s", F.lit(0)).unionByName(new.withColumn("s", F.lit(1))), "k", "s", ["v"]))
    c.commit()
    assert (t.read("x").count(), t.read("x", key="k", keys=[0, 1]).collect()[0]["v"]) == (30, "old")
    assert t.vacuum(older_than=-1) >= 2 and t.read("x").count() == 30
    t.clear()
    assert t.version() == 0


def test_the_slower_of_two_changes_is_refused(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))
    one, two = t.begin(), t.begin()
    for c, v in ((one, 1), (two, 2)):
        c.append("x", spark.createDataFrame([(v,)], "k int"), key="k")
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert rows(t.read("x")) == [(1,)]


DOC = "case_reference string, text string, year int, region string, case_type string"


@pytest.mark.parametrize("step", ["embed", "chunks", "vectors", "postings", "commit"])
def test_a_crash_at_any_step_changes_nothing(spark, tmp_path, monkeypatch, step):
    engine = Engine(spark, str(tmp_path / "e"))
    engine.ingest(spark.createDataFrame([("A", "A deposit was paid.", 2020, "LON", "")], DOC))
    before = rows(engine.chunks()), engine.index.stats().first(), engine.tables.version()
    from casemill.operators import embed
    from casemill.sources.snapshots import Change

    def broken(*_, **__):
        raise RuntimeError("lost")

    kept = Change.append
    with monkeypatch.context() as m:
        if step == "embed":
            m.setattr(embed, "embed", broken)
        elif step == "commit":
            m.setattr(Change, "commit", broken)
        else:
            m.setattr(Change, "append", lambda self, name, *a, **b: broken() if name == step else kept(self, name, *a, **b))
        with pytest.raises(RuntimeError):
            engine.ingest(spark.createDataFrame([("B", "Rent was owed.", 2021, "MAN", "")], DOC))
    assert (rows(engine.chunks()), engine.index.stats().first(), engine.tables.version()) == before
    assert engine.ingest(spark.createDataFrame([("B", "Rent was owed.", 2021, "MAN", "")], DOC)).first()["chunks"] == 1
    assert engine.vectors().count() == 2 and engine.index.stats().first()["n_docs"] == 2


def test_a_case_is_replaced_in_all_tables(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    docs = [("A", "A deposit was paid late.", 2020, "LON", ""), ("A", "A deposit was paid late.", 2021, "LON", ""), ("B", "Rent was owed, a deposit too.", 2021, "MAN", "")]
    engine.ingest(spark.createDataFrame(docs, DOC))
    assert rows(engine.chunks().select("chunk_id", "year")) == [("A_0", 2021), ("B_0", 2021)]
    engine.ingest_one("A", "Cleaning charges only.", year=2022, region="CHI")
    assert rows(engine.chunks().select("chunk_id", "year", "region")) == [("A_0", 2022, "CHI"), ("B_0", 2021, "MAN")] and engine.vectors().count() == 2
    # the index is what a new one over the same chunks would be
    new = KeywordIndex(spark, str(tmp_path / "n"), id_type="string").build(engine.chunks(), id_col="chunk_id", ref_col="case_reference")
    assert rows(engine.index.postings()) == rows(new.postings()) and engine.index.stats().first() == new.stats().first()
    assert rows(engine.index.idf()) == rows(new.idf())
    engine.delete(spark.createDataFrame([("A",), ("Z",)], "case_reference string"))
    assert rows(engine.chunks().select("chunk_id")) == [("B_0",)] and engine.index.stats().first()["n_docs"] == 1


def test_an_ingest_leaves_texts_in_one_table_alone(spark, tmp_path, monkeypatch):
    from casemill import engine as module
    from casemill.sources import scratch

    place = scratch.folder(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    held = lambda: {n for n in os.listdir(place) if n.startswith(("ingest-", "chunks-"))} if os.path.isdir(place) else set()
    stood = held()
    docs = spark.createDataFrame([("A", "A deposit was paid late.", 2020, "LON", ""), ("A", "Rent was owed.", 2021, "LON", ""), ("B", "Cleaning charges.", 2021, "MAN", ""), (None, "Lost.", 2021, "MAN", ""), ("C", " ", 2021, "MAN", "")], DOC)
    engine = Engine(spark, str(tmp_path / "e"))
    assert engine.ingest(docs).first().asDict() == {"total": 5, "processed": 4, "skipped": 1, "failed": 0, "chunks": 2}
    assert held() == stood
    assert [n for n, t in engine.tables.state()["tables"].items() if "text" in [f["name"] for f in t["schema"]["fields"]]] == ["chunks"]
    # the index still gives the texts, and finds the terms of what it takes out
    want = [("A_0", "A", "Rent was owed."), ("B_0", "B", "Cleaning charges.")]
    assert rows(engine.index.get(spark.createDataFrame([("A_0",), ("B_0",), ("Z",)], "id string")).select("id", "ref", "text")) == want
    monkeypatch.setattr(module, "REPEATED", 0)  # all rows are grouped then
    again = Engine(spark, str(tmp_path / "g"))
    again.ingest(docs)
    assert rows(again.chunks()) == rows(engine.chunks()) and rows(again.index.postings()) == rows(engine.index.postings())


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    docs = spark.createDataFrame([("A", "A deposit was paid.", 2020, "LON", ""), ("B", "Rent was owed.", 2021, "MAN", "")], DOC)
    docs.filter("case_reference = 'A'").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(DOC).parquet(str(tmp_path / "in"))
    run = lambda checkpoint: engine.ingest_stream(source(), str(tmp_path / checkpoint), "files").trigger(availableNow=True).start().awaitTermination()
    run("c")
    docs.filter("case_reference = 'B'").write.mode("append").parquet(str(tmp_path / "in"))
    run("c")
    assert rows(engine.chunks().select("chunk_id")) == [("A_0",), ("B_0",)]
    version = engine.tables.version()
    # a stream that has lost its checkpoint sends batch 0 again
    run("other")
    assert engine.tables.version() == version and engine.index.stats().first()["n_docs"] == 2
    assert engine.ingest(docs, batch=("files", 1)).first()["total"] == 0 and engine.ingest(docs, batch=("else", 0)).first()["chunks"] == 0
