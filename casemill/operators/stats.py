"""Corpus and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.sources.scratch import stored


def share(rows: DataFrame, key: str, bar: float = 3.0) -> DataFrame:
    """(key, n, pct, bar): counts, their percentage and a bar of one block for each `bar` percent; the counts are summed first."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pct = F.col("n") * 100.0 / total
    return counts.select(key, "n", F.round(pct, 2).alias("pct"), F.repeat(F.lit("#"), F.floor(pct / bar).cast("int")).alias("bar"))


def rate(part, whole):
    """Percentage, 0 where there is nothing to divide by."""
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), 2)


def rollup(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by each key alone, in one pass: (dimension, value, n)."""
    each = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys])
    return rows.select(F.explode(each).alias("x")).select("x.*").filter("value is not null and value <> ''").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def most_common(rows: DataFrame, key: str, k: int = 10) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def collection(chunks: DataFrame, ref: str = "case_reference", case_type: str = "case_type", k: int = 10) -> DataFrame:
    """One row: chunks, cases, avg_chunks (2 places, 0 for none), years and regions (sorted, blank ones left out), top_types (the k commonest).

    Years, regions and types are names, few at any size; the cases are counted distinct.
    """
    named = lambda c: F.array_sort(F.collect_set(F.when(F.col(c).cast("string") != "", F.col(c))))
    whole = chunks.agg(F.count("*").alias("chunks"), F.count_distinct(ref).alias("cases"), named("year").alias("years"), named("region").alias("regions"))
    types = chunks.filter(F.col(case_type) != "").groupBy(case_type).agg(F.count("*").alias("n")).orderBy(F.desc("n"), case_type).limit(k)
    top = types.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(case_type).alias("t")))), lambda x: x["t"]).alias("top_types"))
    rows = whole.crossJoin(top)  # one row each
    return rows.withColumn("avg_chunks", F.round(F.coalesce(F.try_divide(F.col("chunks").cast("double"), F.col("cases")), F.lit(0.0)), 2))


def running_mean(log: DataFrame, value: str, order: str, *, tie: str | None = None, parts: int | None = None) -> DataFrame:
    """The log of queries with the mean of a value up to each; nulls of the value do not count.

    Rows of equal order go by the column tie, or by all columns where none is named.  The log is dealt by ranges of that order, so one
    day, or one moment, still spreads over tasks: a range is summed by itself, and only the ranges' totals are summed over.
    parts: the number of ranges; None: by size.
    """
    rows = log.withColumn("_tie", F.col(tie) if tie else F.xxhash64(*log.columns))
    by = [F.col(order), F.col("_tie")]
    rows = (rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)).withColumn("_part", F.spark_partition_id())
    rows = stored(rows, "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))  # a row a range
    totals = totals.select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("_n0") + F.count(value).over(inside)
    mean = (F.col("_s0") + F.coalesce(F.sum(value).over(inside), F.lit(0.0))) / F.when(n > 0, n)
    return rows.join(totals, "_part").withColumn("running_mean", mean).drop("_part", "_tie", "_s0", "_n0")


def usage(log: DataFrame, *metrics: str, key: str = "component") -> DataFrame:
    """(component, calls, failed, and the sum of each metric) of a log of calls; a new log starts the counts anew."""
    return log.groupBy(key).agg(F.count("*").alias("calls"), F.count_if(F.col("error").isNotNull()).alias("failed"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in metrics])


def mean_confidence(scores: Column) -> Column:
    """The mean of a map's values, 0 where it is empty or null."""
    values = F.coalesce(F.map_values(scores), F.array().cast("array<double>"))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)).otherwise(0.0)


def ingestion(status: DataFrame) -> DataFrame:
    """One row: total, processed, skipped, failed, chunks, of rows (status, chunks)."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return status.agg(F.count("*").alias("total"), of("processed"), of("skipped"), of("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
