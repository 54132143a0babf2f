"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key.  Documents are range-sorted by key within their source: a source's key space is cut
into as many even ranges as its row count asks for, each range is sorted and summed by itself, and range totals are summed
over the ranges of a source.  A document's place in its source's order, counted in words, then follows from its range alone,
so no task ever holds a source.  A source is cut at its exact budget: whole epochs first, then the order's prefix, the last
document in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.shared import written

WEIGHTS = (5, 2, 1)
#: Rows of one key range; a range is what one task must sort.
RANGE_ROWS = 16_384
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(frame: DataFrame, order: list, **sums: Column) -> DataFrame:
    """frame with the sums of all rows before each in a total order: range-sorted, summed within a range, and over the ranges' totals.

    The ranges are a written table, so that the sums are over the same ones whatever runs again; no task holds more than a range.
    """
    ranges = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(frame.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("_range").agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.join(starts, "_range")
    return rows.select(*frame.columns, *[(F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_{k}")).alias(k) for k, v in sums.items()])


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = 1.0, most_epochs: int = 3) -> DataFrame:
    """(source, docs, source_size, place, target) from (source, docs, source_size).

    Targets share the total by weight; a source stops at most_epochs times its size and the excess is reshared by weight among
    the others until none is above.  Solved in closed form: with sources in order of how many epochs a unit of weight costs,
    the capped ones are a prefix, the longest whose members would exceed their caps.  The frame has a row per source; both orders
    are prefix sums over ranges, as sources may be as many as there are domains.
    """
    names = F.array(*[F.lit(float(w)) for w in weights])
    placed = running(sizes, [F.col("source").asc_nulls_last()], place=F.lit(1))
    placed = placed.withColumn("weight", F.element_at(names, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", F.lit(float(most_epochs)) * F.col("source_size"))
    placed = running(placed.withColumn("need", F.col("cap") / F.col("weight")), [F.col("need"), F.col("place")], capped_before=F.col("cap"), weight_before=F.col("weight"))
    whole = placed.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weight")).first()
    total, weight = F.lit(float(share) * float(whole["total"] or 0)), F.lit(float(whole["weight"] or 0))
    placed = placed.withColumn("level", (total - F.col("capped_before")) / (weight - F.col("weight_before"))).withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
    free = placed.filter(~F.col("capped")).agg(F.min(F.struct("need", "place", "level"))["level"].alias("level")).first()["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.lit(free).cast("double") * F.col("weight"))
    return placed.select("source", "docs", "source_size", "place", target.alias("target"))


def mix_sources(
    docs: DataFrame, *, weights=WEIGHTS, share: float = 1.0, most_epochs: int = 3, range_rows: int = RANGE_ROWS, seed: str = "mix", keep=()
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, epochs (whole repeats) and the columns in keep.

    size is the number of words (null text: 0); taken is how many words the mix takes of the document, repeats counted, and the
    sum over a source is its target rounded down.  A null source is a source of its own, the last.  Rows with one doc_id each
    count; those of equal key, id and size may change places, which changes no value but that of such twins.  An empty table
    gives no rows.  Reruns agree: the order depends on the seed and the rows alone.
    """
    used = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *[F.col(c) for c in keep])
    used = used.withColumn("key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    # a third of all rows may share a source: the sizes are summed before they meet
    slim = written(used.select("doc_id", "source", "size", "key"), "mix")  # texts are counted once, not at each use below
    sizes = slim.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights=weights, share=share, most_epochs=most_epochs)
    targets = targets.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "docs", "source_size", "place", "target")
    # sources are names of a collection, not rows: the join side has one row for each
    def placed(frame: DataFrame) -> DataFrame:
        rows = frame.join(targets, (F.coalesce(frame.source, F.lit("")) == targets.s) & (frame.source.isNull() == targets.none)).drop("s", "none")
        # 28 bits of the key tell the range; the product stays within a long
        return rows.withColumn("range", F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * F.ceil(F.col("docs") / range_rows) / F.lit(1 << 28)).cast("long"))

    totals = placed(slim).groupBy("place", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("place", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("place", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed(used if keep else slim).withColumn("until", F.sum("size").over(inside)).join(starts, ["place", "range"])
    start = F.col("range_start") + F.col("until") - F.col("size")
    budget = F.floor("target").cast("long")
    rows = rows.withColumn("epochs", F.coalesce(F.expr("cast(floor(target) as bigint) div nullif(source_size, 0)"), F.lit(0)).cast("long"))
    over = budget - F.col("epochs") * F.col("source_size") - start
    part = F.greatest(F.lit(0), F.least(F.col("size"), over))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "source", "epochs", *[c for c in keep])


MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix' || doc_id::VARCHAR) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), fill(round, place, capped) AS (
  SELECT 0, place, false FROM w
  UNION ALL
  SELECT f.round + 1, f.place, f.capped OR (
      w.weight * (sum(w.source_size) OVER () - sum(CASE WHEN f.capped THEN 3.0 * w.source_size ELSE 0.0 END) OVER ())
        / nullif(sum(CASE WHEN f.capped THEN 0.0 ELSE w.weight END) OVER (), 0) > 3.0 * w.source_size)
  FROM fill f JOIN w USING (place) WHERE f.round < (SELECT count(*) FROM w)
), last AS (
  SELECT w.*, f.capped FROM w JOIN fill f USING (place) WHERE f.round = (SELECT max(round) FROM fill)
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN 3.0 * source_size ELSE weight *
     (sum(source_size) OVER () - sum(CASE WHEN capped THEN 3.0 * source_size ELSE 0.0 END) OVER ())
     / sum(CASE WHEN capped THEN 0.0 ELSE weight END) OVER () END::DOUBLE AS target FROM last
), o AS (
  SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END) * size + greatest(0, least(size,
    budget - (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END) * source_size - start)))::BIGINT AS taken
FROM o
"""
