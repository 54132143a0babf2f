"""The thin queries of the training-data operators, one an operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _tokenizer() -> str:
    import public_tokenizers

    return Path(public_tokenizers.path("word_bpe_49k.json")).read_text()


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casemill.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer(), end_id=1)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casemill.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages")).drop("url")


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casemill.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casemill.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), x AS (SELECT doc_id, unnest(s) AS s FROM g),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM g),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * common >= 75 * (na.n + nb.n - common)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casemill.llm.media import media_columns

    return media_columns(_table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casemill.llm.repeats import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casemill.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casemill.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casemill.llm.toxicity import learn, score_documents

    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casemill.llm.langid import learn, predict

    docs = _table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casemill.llm.lexical import rank_documents

    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casemill.llm.codes import compress

    return compress(_table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casemill.llm.quality import learn, score_documents

    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, _table(spark, sf_dir, "labels")))


def queries() -> dict:
    found = [op1_packing, op2_warc, op3_minhash, op4_mixing, op5_media, op6_repeats, op7_nearest, op8_licenses, op9_toxicity, op10_langid, op11_lexical, op12_codes, op13_quality]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from casemill.llm.codes import compress_sql
    from casemill.llm.lexical import RANK_SQL
    from casemill.llm.licenses import license_sql
    from casemill.llm.mixing import MIX_SQL

    return {"op2_warc": WARC_SQL, "op3_minhash": NEAR_SQL, "op4_mixing": MIX_SQL, "op8_licenses": license_sql(), "op11_lexical": RANK_SQL, "op12_codes": compress_sql()}
