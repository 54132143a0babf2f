"""python -m casemill ingest|query|stats|clear: the engine from the command line, for spark-submit too."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from casemill.engine import Engine
from casemill.functions import text as T


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="casemill")
    top.add_argument("--folder", required=True, help="where chunks, vectors and the index are kept")
    actions = top.add_subparsers(dest="action", required=True)
    one = actions.add_parser("ingest")
    one.add_argument("table", help="Parquet of case_reference, text, year, region, case_type")
    one.add_argument("--no-pii-redaction", action="store_true")
    ask = actions.add_parser("query")
    ask.add_argument("query")
    ask.add_argument("--region")
    ask.add_argument("--year", type=int)
    ask.add_argument("--top-k", type=int, default=5)
    actions.add_parser("stats")
    actions.add_parser("clear")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("casemill").getOrCreate()
    engine = Engine(spark, args.folder)
    if args.action == "ingest":
        engine.ingest(spark.read.parquet(args.table), pii=not args.no_pii_redaction).show(truncate=False)
    elif args.action == "query":
        region = (args.region or "").upper()
        where = ({"region": region} if region else {}) | ({"year": args.year} if args.year else {})
        asked = spark.createDataFrame([(1, args.query, region)], "query_id int, query string, query_region string")
        found = engine.retrieve(asked, k=args.top_k, where=where or None)
        found.select("rerank_rank", "case_reference", F.round("rerank_score", 3).alias("score"), "explanation", T.snippet(F.col("text")).alias("text")).orderBy("rerank_rank").show(truncate=False)
        engine.confidence(found, asked).show(truncate=False)
    elif args.action == "stats":
        engine.get_stats().show(truncate=False)
    else:
        engine.clear_index()


if __name__ == "__main__":
    main()
