"""The ledger of collection runs: errors, runs, where files go, what to fetch next, and sums over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.operators.stats import rate

# The folders of the categories, and the statuses that end a case's collection.
FOLDERS = {"deposit": "deposit-cases", "adjacent": "adjacent-cases"}
OTHER_FOLDER = "other-cases"
DONE, SKIPPED = "complete", "skipped"


def errors(attempts: DataFrame, at: Column) -> DataFrame:
    """(case_reference, error_message, occurred_at) of the attempts that have an error; append it to the error log."""
    return attempts.filter("error_message is not null").select("case_reference", "error_message", at.alias("occurred_at"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def open_run(years: DataFrame, run_id: Column, at: Column) -> DataFrame:
    """A row a run: run_id, started_at, completed_at (null), years (sorted)."""
    return years.agg(F.array_sort(F.collect_set("year")).alias("years")).select(run_id.alias("run_id"), at.alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), "years")


def close_run(runs: DataFrame, run_id: str, at: Column) -> DataFrame:
    """runs with the end of one set, where it has none yet."""
    return runs.withColumn("completed_at", F.when((F.col("run_id") == run_id) & F.col("completed_at").isNull(), at).otherwise(F.col("completed_at")))


def output_folder(category: Column, year: Column, ref: Column) -> Column:
    """`{category}-cases/{year}/{ref}`."""
    folder = F.lit(OTHER_FOLDER)
    for name, place in FOLDERS.items():
        folder = F.when(category == name, place).otherwise(folder)
    return F.concat_ws("/", F.coalesce(folder, F.lit(OTHER_FOLDER)), year.cast("string"), ref)


def write_pages(pages: DataFrame, path: str) -> None:
    """Raw pages (case_reference, year, category, html, pdf) by category and year; a case may have one of both alone."""
    pages.filter("html is not null or pdf is not null").write.mode("append").partitionBy("category", "year").parquet(path)


def pending(cases: DataFrame, year: int | None = None) -> DataFrame:
    """Cases that are neither complete nor skipped, latest year first and then by reference."""
    rows = cases.filter(~F.col("status").isin(DONE, SKIPPED))
    return (rows if year is None else rows.filter(F.col("year") == year)).orderBy(F.desc("year"), "case_reference")


def resume_years(cases: DataFrame) -> DataFrame:
    """(year) of the pending cases, latest first."""
    return cases.filter(~F.col("status").isin(DONE, SKIPPED)).select("year").distinct().orderBy(F.desc("year"))


def to_fetch(listed: DataFrame, cases: DataFrame) -> DataFrame:
    """Listed cases that are not complete; skipped ones are tried again."""
    return listed.join(cases.filter(F.col("status") == DONE).select("case_reference").distinct(), "case_reference", "left_anti")


def statistics(cases: DataFrame) -> DataFrame:
    """(dimension, value, n): by status, category and year in one pass over the cases, then total, errors and completion_rate."""
    each = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in ("status", "category", "year")], F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value")))
    per = cases.select(F.explode(each).alias("x"), (F.col("status") == DONE).alias("done"), F.col("error_message").isNotNull().alias("bad")).groupBy("x").agg(F.count("*").alias("n"), F.count_if("done").alias("done"), F.count_if("bad").alias("bad"))
    whole = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value"), F.col("n").cast("double").alias("n")), F.struct(F.lit("errors").alias("dimension"), F.lit("").alias("value"), F.col("bad").cast("double").alias("n")),
        F.struct(F.lit("completion_rate").alias("dimension"), F.lit("").alias("value"), rate(F.col("done"), F.col("n")).alias("n")),
    )
    own = F.array(F.struct(F.col("x.dimension").alias("dimension"), F.col("x.value").alias("value"), F.col("n").cast("double").alias("n")))
    return per.select(F.explode(F.when(F.col("x.dimension") == "total", whole).otherwise(own)).alias("r")).select("r.*")


def run_summary(attempts: DataFrame) -> DataFrame:
    """(year, cases, succeeded, failed, success_rate) by year, with a row of null year over all; a case with either file has succeeded."""
    won = F.col("status").isin(DONE, "html_downloaded", "pdf_downloaded")
    rows = attempts.withColumn("won", won).rollup("year").agg(F.count("*").alias("cases"), F.count_if("won").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))
    return rows.withColumn("success_rate", rate(F.col("succeeded"), F.col("cases")))


def deposit_cases(cases: DataFrame) -> DataFrame:
    """Deposit cases, latest year first and then by reference."""
    return cases.filter(F.col("category") == "deposit").orderBy(F.desc("year"), "case_reference")
