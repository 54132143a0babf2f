"""The ledger's operators over a real SQLite file."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from casemill.operators import ledger
from casemill.sources import sqlite as S


@pytest.fixture
def file(tmp_path):
    path = str(tmp_path / "progress.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE cases (case_reference TEXT PRIMARY KEY, year INTEGER, status TEXT, score REAL, done BOOLEAN, raw BLOB)")
        db.executemany("INSERT INTO cases VALUES (?, ?, ?, ?, ?, ?)", [(f"LON_{i}", 2000 + i % 20, ("pending", "complete", "failed")[i % 3], None if i % 5 == 0 else i / 2, i % 2, b"x") for i in range(1000)])
    return path


def read(spark, path, table="cases", **options):
    S.register(spark)
    return spark.read.format("casemill_sqlite").options(path=path, table=table, **options).load()


def test_ranges_types_and_filters(spark, file):
    cases = read(spark, file, rows=128)
    assert [f.dataType.simpleString() for f in cases.schema] == ["string", "bigint", "string", "double", "boolean", "binary"]
    assert cases.rdd.getNumPartitions() == 8 and cases.count() == 1000
    some = cases.filter("year >= 2015 and status in ('pending', 'failed') and score is not null")
    assert some.count() == sum(1 for i in range(1000) if 2000 + i % 20 >= 2015 and i % 3 != 1 and i % 5)
    assert (cases.filter("case_reference = 'LON_7'").first()["done"], cases.filter("score is null").count()) == (True, 200)
    reader = S.Reader(file, "cases", cases.schema, 128)
    left = list(reader.pushFilters([S.ds.EqualTo(("status",), "pending"), S.ds.StringStartsWith(("status",), "p")]))
    assert len(left) == 1 and reader.where == ['"status" = ?']
    with pytest.raises(Exception, match="no table"):
        read(spark, file, "absent").count()


def test_the_ledger_on_a_file(spark, file):
    cases = read(spark, file)
    assert ledger.pending(cases).count() == 667  # pending and failed ones
    errors = spark.createDataFrame([(f"LON_{i}", "timeout") for i in range(40)], "case_reference string, message string").repartition(4)
    for _ in range(2):
        errors.write.format("casemill_sqlite").options(path=file, table="errors").mode("append").save()
    assert read(spark, file, "errors").count() == 80
    # a key replaces rows, and nothing else of the table
    changed = read(spark, file).filter("status = 'failed'").withColumn("status", F.lit("pending"))
    changed.write.format("casemill_sqlite").options(path=file, table="cases", key="case_reference").mode("append").save()
    assert {r["status"]: r["count"] for r in read(spark, file).groupBy("status").count().collect()} == {"pending": 667, "complete": 333}


def test_a_failed_write_leaves_nothing(spark, file, tmp_path):
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("id").cast("string")).alias("case_reference"), F.lit("m").alias("message"))
    S.register(spark)
    with pytest.raises(Exception, match="lost"):
        bad.write.format("casemill_sqlite").options(path=file, table="errors").mode("append").save()
    with sqlite3.connect(file) as db:
        assert db.execute("SELECT count(*) FROM sqlite_master WHERE name = 'errors'").fetchone() == (0,)
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".part")] == []
