"""Keyed tables on Parquet: upsert, status updates, incremental skips, deletes, exports; each a frame in and a frame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(rows: DataFrame, key: str, seq: str, keep_first: list[str]) -> DataFrame:
    """One row a key: columns in keep_first have the value of the least seq, all others that of the greatest; ties of seq go by the row."""
    others = [c for c in rows.columns if c not in (key, seq)]
    order = F.struct(seq, *others)
    return rows.groupBy(key).agg(*[(F.min_by if c in keep_first else F.max_by)(c, order).alias(c) for c in others])


def update(rows: DataFrame, changes: DataFrame, key: str, *, stamp: tuple[str, Column] | None = None) -> DataFrame:
    """rows with the non-null values of changes (unique by key) in place of their own; stamp (column, time) is set where the new status is complete."""
    if stamp:
        changes = changes.withColumn(stamp[0], F.when(F.col("status") == "complete", stamp[1]))
    new = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    joined = rows.join(new, rows[key] == new["_k"], "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c) for c in rows.columns])


def unseen(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return unseen(rows, keys, key)


def delete_cascading(keys: DataFrame, key: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the keys; all of them have the key column (a case with its session, a dispute with its indexes, evidence with its metadata)."""
    return {name: delete(rows, keys, key) for name, rows in tables.items()}


def deleted(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, deleted): whether there was anything to delete."""
    return keys.select(key).distinct().join(rows.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left").select(key, F.col("_k").isNotNull().alias("deleted"))


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of only one of both."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left_only")).union(right.join(left, key, "left_anti").withColumn("side", F.lit("right_only")))


def first_wins(*frames: DataFrame, key: str) -> DataFrame:
    """The union of the frames with one row a key, that of the earliest frame."""
    marked = [f.withColumn("_priority", F.lit(i)) for i, f in enumerate(frames)]
    out = marked[0]
    for f in marked[1:]:
        out = out.unionByName(f)
    others = [c for c in out.columns if c not in (key, "_priority")]
    return out.groupBy(key).agg(F.min_by(F.struct(*others), F.struct("_priority", *others)).alias("r")).select(key, "r.*")


def export(rows: DataFrame) -> DataFrame:
    """One JSON string a row, of all its columns."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def export_ordered(rows: DataFrame, exported_at: Column, *, year: str = "year", key: str = "case_reference") -> tuple[DataFrame, DataFrame]:
    """(envelope, lines): one row with exported_at and total, and a JSON line a row, latest year first and then by key.

    The lines are a sorted table, not one value: an export of any size is written by all tasks.
    """
    lines = rows.orderBy(F.desc_nulls_last(year), key).select(F.to_json(F.struct(*rows.columns)).alias("json"))
    return rows.agg(F.count("*").alias("total")).select(exported_at.alias("exported_at"), "total"), lines


def quarantine(rows: DataFrame, rules: dict) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad has the names of the failed rules (name: condition that must hold; null fails)."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    marked = rows.withColumn("failed_rules", failed)
    return marked.filter(F.size("failed_rules") == 0).drop("failed_rules"), marked.filter(F.size("failed_rules") > 0)


def save_json(rows: DataFrame, path: str, key: str) -> None:
    """One folder a key, replaced whole; other keys' folders stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def load_json(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
