"""Folders of cases: written whole, replaced, read back, and left alone by tasks that fail."""

import json
import os

import pytest
from pyspark.sql import functions as F

from casemill.sources import case_folders, files

SCHEMA = "case_reference string, year int, category string, html string, pdf binary, title string, folder string"
FIELDS = "case_reference string, year int, category string, title string, folder string"


def test_round_trip(spark, tmp_path):
    long = "r" * 400
    rows = [
        ("LON_1", 2020, "deposit", "<p>é</p>", b"%PDF", "one", "x"), ("LON_2", 2020, "adjacent", None, b"\x00\xff", None, None), ("a/b", None, None, "slash", None, "", "y"), ("a_b", 2020, "odd", "p", None, "t", ""),
        ("..", 2021, "deposit", "dots", None, None, None), ("_x", 2021, "deposit", "under", None, None, None), (long, 2021, "deposit", "long", None, None, None), (long + "s", 2021, "deposit", "longer", None, None, None),
        (None, 2021, "deposit", "lost", None, None, None), ("", 2021, "deposit", "lost", None, None, None), ("none", 2021, "deposit", None, None, None, None), ("empty", 2021, "deposit", "", b"", None, None), ("no page", 2021, "deposit", "", b"x", None, None),
        ("twice", 2021, "deposit", "a", None, "t", None), ("twice", 2021, "deposit", "b", None, "t", None), ("twice", 2021, "deposit", "b", None, "t", None),
    ]
    root = f"file://{tmp_path}/cases"
    case_folders.write_cases(spark.createDataFrame(rows, SCHEMA), root)
    got = {r["case_reference"]: r for r in case_folders.read_cases(spark, root, FIELDS).toDF("place", *[f.split()[0] for f in FIELDS.split(", ")], "html", "pdf").collect()}
    want = {r[0]: r for r in rows if r[0] and (r[3] or r[4]) and r[:4] != ("twice", 2021, "deposit", "a")}
    assert got.keys() == want.keys()
    for ref, r in want.items():
        assert tuple(got[ref][c] for c in ("case_reference", "year", "category", "html", "pdf", "title", "folder")) == (*r[:3], r[3] or None, *r[4:])
    assert got["LON_1"]["place"] == "deposit-cases/2020/LON_1" and got["a/b"]["place"] == "other-cases/unknown/a%2Fb"
    assert json.loads((tmp_path / "cases/adjacent-cases/2020/LON_2/metadata.json").read_text()) == {"case_reference": "LON_2", "year": 2020, "category": "adjacent", "title": None, "folder": None}
    assert sorted(os.listdir(tmp_path / "cases")) == ["adjacent-cases", "deposit-cases", "other-cases"]
    # a second run replaces the files that it brings and leaves the rest
    case_folders.write_cases(spark.createDataFrame([("LON_1", 2020, "deposit", "new", None, None, None)], SCHEMA), root)
    again = {r["case_reference"]: r for r in case_folders.read_cases(spark, root, FIELDS.replace(", folder string", "")).collect()}
    assert again.keys() == want.keys() and (again["LON_1"]["html"], again["LON_1"]["pdf"]) == ("new", b"%PDF")
    # the other readers see the same
    assert files.binary_files(spark, root).count() == 3
    assert files.companion_metadata(spark, root, "case_reference string").count() == len(want)
    case_folders.write_cases(spark.createDataFrame([], SCHEMA), root)
    assert case_folders.read_cases(spark, root, FIELDS.replace(", folder string", "")).count() == len(want)


def test_a_failed_task_leaves_whole_cases_only(spark, tmp_path):
    root = f"file://{tmp_path}/cases"
    cases = spark.range(80).select(F.concat(F.lit("R"), "id").alias("case_reference"), F.lit(2020).alias("year"), F.lit("deposit").alias("category"), F.lit("old").alias("html"), F.lit(b"old").alias("pdf"))
    case_folders.write_cases(cases.filter("substr(case_reference, 2) < 40"), root)
    stood = case_folders.read_cases(spark, root, "case_reference string").count()
    made = case_folders.case_files(cases.withColumn("html", F.lit("new")).withColumn("pdf", F.lit(b"new"))).repartition(4)
    broken = made.withColumn("pdf", F.when(F.col("folder").endswith("R17"), F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.col("pdf")))
    with pytest.raises(Exception, match="stop"):
        broken.write.format("casemill_cases").option("path", root).mode("append").save()
    rows = case_folders.read_cases(spark, root, "case_reference string").collect()
    assert len(rows) >= stood > 0 and {v for r in rows for v in (r["html"], bytes(r["pdf"]).decode())} <= {"old", "new"}
    assert {r["html"] for r in rows if r["case_reference"] == "R17"} == {"old"}
    case_folders.write_cases(cases.withColumn("html", F.lit("last")), root)
    rows = case_folders.read_cases(spark, root, "case_reference string").collect()
    assert len(rows) == 80 and {(r["html"], bytes(r["pdf"])) for r in rows} == {("last", b"old")}
    # tasks that the failure ended may leave what they were laying out; no reader lists it
    assert {n for n in os.listdir(tmp_path / "cases") if not n.startswith("_staging-")} == {"deposit-cases"}


def test_a_read_lists_years_and_not_cases_one_by_one(spark, tmp_path):
    """Of 120 cases in four years the plan knows four folders; a listing of files by Spark would have run a job for each that has many."""
    root = f"file://{tmp_path}/cases"
    cases = spark.range(120).select(F.concat(F.lit("R"), "id").alias("case_reference"), (F.col("id") % 4 + 2020).cast("int").alias("year"), F.lit("deposit").alias("category"), F.concat(F.lit("p"), "id").alias("html"), F.lit(None).cast("binary").alias("pdf"))
    case_folders.write_cases(cases, root)
    (tmp_path / "cases/deposit-cases/2020/no-metadata").mkdir()
    (tmp_path / "cases/deposit-cases/2020/no-metadata/decision.html").write_text("x")
    (tmp_path / "cases/deposit-cases/2021/R1/metadata.json").write_text("")  # nothing in it
    (tmp_path / "cases/_staging-x/deposit-cases/2020/R500").mkdir(parents=True)
    (tmp_path / "cases/_staging-x/deposit-cases/2020/R500/metadata.json").write_text("{}")
    spark.sparkContext.setJobGroup("listing", "")
    rows = case_folders.read_cases(spark, root, "case_reference string")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("listing")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "binaryFile" not in rows._jdf.queryExecution().toString()
    assert {(r["case_reference"], r["html"], r["pdf"]) for r in rows.collect()} == {(f"R{k}", f"p{k}", None) for k in range(120) if k != 1}
    assert rows.count() == 119


def test_an_attempt_that_comes_between(tmp_path):
    """Another attempt's folder appears just before the rename: its files are replaced."""
    from pyarrow import fs


    for name, text in (("new", "mine"), ("other", "theirs")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "decision.html").write_text(text)
    system, seen = fs.LocalFileSystem(), []

    class Late:
        def get_file_info(self, path):
            found = system.get_file_info(path)
            if not seen:
                seen.append(path)
                (tmp_path / "other").rename(tmp_path / "goal")
            return found

        def move(self, a, b):
            system.move(a, b)

    case_folders.place(Late(), f"{tmp_path}/new", f"{tmp_path}/goal")
    assert (tmp_path / "goal/decision.html").read_text() == "mine"


def test_wrong_uses(spark, tmp_path):
    spark.dataSource.register(case_folders.CaseFolders)
    with pytest.raises(Exception, match="a case has folder"):
        spark.range(1).write.format("casemill_cases").option("path", f"file://{tmp_path}/x").mode("append").save()
    with pytest.raises(Exception, match="one by one"):
        case_folders.case_files(spark.createDataFrame([], SCHEMA)).write.format("casemill_cases").option("path", f"file://{tmp_path}/x").mode("overwrite").save()
