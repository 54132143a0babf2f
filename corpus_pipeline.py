"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids, and an empty table, which gives no rows;
of its input it reads the columns of documents alone, so others do not clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import minhash, mixing, packing, queries, repeats, toxicity
from casemill.llm.shared import cleared, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long"))


def _numbered(docs: DataFrame, keep) -> DataFrame:
    """docs with `row`, one number a row in the order of doc_id, null ids last: doc_id itself where no id is null or repeated."""
    if not docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").take(1):
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    order = F.asc_nulls_last("doc_id"), F.xxhash64("text", "source", "lang", "n_chars")
    return keep(docs.orderBy(*order).withColumn("row", F.monotonically_increasing_id()), "numbered")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject.

    A text that is null, empty or without a toxic token stays; repeated rows fare alike; a null doc_id has no label and is scored as
    the others are.  Where nothing can be learned (no labels, or one kind of them) nothing is rejected.
    """
    with cleared():
        model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _documents(toxicity.score_documents(docs, model, keep=list(COLUMNS)).filter("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the least doc_id, whatever ids are null or repeated; texts of no words all stay."""
    with cleared() as keep:
        rows = _numbered(docs, keep)
        kept = keep(minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias("kept_row")), "kept")
    return _documents(rows.join(kept, F.col("row") == F.col("kept_row"), "left_semi"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated strings cover; every row stays, its text may become empty."""
    with cleared() as keep:
        rows = _numbered(docs, keep)
        cut = repeats.remove_repeats(rows.select(F.col("row").alias("doc_id"), "text"), with_text=True).filter("n_removed > 0")
        cut = keep(cut.select(F.col("doc_id").alias("cut_row"), "kept_text", "n_removed"), "cut")
    rows = rows.join(cut, F.col("row") == F.col("cut_row"), "left")
    changed = F.col("n_removed").isNotNull()
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    return _documents(rows.withColumn("text", text).withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars"))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each whole repeat of a document, and one with the first words of a part that is taken.

    A document without words, null or empty, takes no part in the mix, as it has no words to take; a null source is a source of its
    own; rows that repeat an id each count; which of two rows with one id and size is cut does not follow from their texts.
    """
    rows = mixing.mix_sources(docs, keep=("text", "lang", "n_chars"))
    part = (F.col("taken") - F.col("epochs") * F.col("size")).cast("int")
    word = r"[^\x20\x09-\x0D]+"
    # the first `part` words with the white space before and between them
    head = F.concat_ws("", F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + word), F.lit(0)), F.lit(1), F.greatest(part, F.lit(0))))
    whole = F.array_repeat(F.col("text"), F.col("epochs").cast("int"))
    taken = F.when(part > 0, F.concat(whole, F.array(F.when(part == F.col("size"), F.col("text")).otherwise(head)))).otherwise(whole)
    rows = rows.filter("taken > 0").withColumn("text", F.explode(taken))
    return _documents(rows.withColumn("n_chars", F.length("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences: a null or empty text is the end id alone, rows that repeat an id are packed one by one, a null id stays null."""
    return packing.pack_documents(docs, queries._tokenizer(), end_id=1)


STAGES = [("toxicity", drop_toxic), ("minhash", drop_near_duplicates), ("repeats", cut_repeats), ("mixing", mix), ("packing", pack)]

#: SQL cannot express learned scores, sketches or a tokenizer's ids; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
