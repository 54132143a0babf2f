"""Prediction inputs and outputs: context, facts, parsing of a model's JSON answer; providers stand for the model itself."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.records import fenced_json

# The answer's schema, its defaults, and outcomes.
CITATIONS = "array<struct<case_reference:string,year:int,quote:string,relevance:string>>"
ANSWER = (
    "overall_outcome string, overall_confidence double, outcome_summary string, tenant_recovery_amount double, landlord_recovery_amount double, predicted_settlement_range array<double>, "
    f"issue_predictions array<struct<issue_type:string,predicted_outcome:string,predicted_amount:double,confidence:double,reasoning:string,supporting_cases:{CITATIONS}>>, "
    f"reasoning_trace array<struct<step_number:int,category:string,title:string,content:string,confidence:double,citations:{CITATIONS}>>, "
    "key_strengths array<string>, key_weaknesses array<string>, uncertainties array<string>, missing_information array<string>"
)
OUTCOMES = {"tenant_win": "tenant_favored", "landlord_win": "landlord_favored", "tenant_favored": "tenant_favored", "landlord_favored": "landlord_favored", "split": "split", "uncertain": "uncertain"}
OVERALL, STEP, FALLBACK, YEAR, RAW = 0.5, 0.7, 0.3, 2022, 2000
UNPARSED = ("Unable to parse structured prediction. See reasoning trace for analysis.", "Raw Analysis", "Failed to parse structured prediction format")


class Provider(Protocol):
    """A model behind the engine; a deterministic one serves tests, no network is used."""

    def complete(self, prompts: list[str]) -> list[str]: ...


class Canned:
    """Answers every prompt with the same text."""

    def __init__(self, answer: str):
        self.answer = answer

    def complete(self, prompts: list[str]) -> list[str]:
        return [self.answer] * len(prompts)


def generate(rows: DataFrame, provider: Provider, prompt: str = "prompt", *, ledger: str | None = None, batch: int = 50) -> DataFrame:
    """rows with the column answer, in batches; refused calls are repeated after growing pauses.

    With a ledger (a folder of calls.answered) equal prompts are asked once and known ones not at all; a null prompt has then a null answer.
    """
    from casemill.operators import calls  # which needs RateLimited

    if ledger:
        return calls.answered(rows, calls.indexed(provider.complete), ledger, column=prompt, batch=batch)
    back_off, call = calls.BackOff(), calls.indexed(provider.complete)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", answer string"
    at = rows.columns.index(prompt)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            prompts = b.column(at).to_pylist()
            answers = [a for k in range(0, len(prompts), batch) for a in back_off(call, prompts[k : k + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string())], [*b.schema.names, "answer"])

    return rows.mapInArrow(run, schema)


class RateLimited(Exception):
    """A provider's call that another provider may answer."""


class Fallback:
    """Asks the first provider and, where it is rate limited, the second; counts are taken from the answers' rows, not kept here."""

    def __init__(self, first: Provider, second: Provider):
        self.first, self.second = first, second

    def complete(self, prompts: list[str]) -> list[str]:
        try:
            return self.first.complete(prompts)
        except RateLimited:
            return self.second.complete(prompts)


def _outcome(text: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(text)), F.lit("uncertain"))


def _cited(citations: Column) -> Column:
    return F.transform(F.coalesce(citations, F.array()), lambda c: F.struct(F.coalesce(c["case_reference"], F.lit("")).alias("case_reference"), F.coalesce(c["year"], F.lit(YEAR)).alias("year"), F.coalesce(c["quote"], F.lit("")).alias("quote"), F.coalesce(c["relevance"], F.lit("")).alias("relevance")))


def parse(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Adds outcome, confidence, summary, issues, steps, n_steps, n_citations (of steps and issues), low, high, is_fallback.

    What an answer leaves out has its default.  An answer that is no JSON object is uncertain at 0.3, with its first 2000
    characters as the only step.
    """
    body = fenced_json(F.col(column))
    rows = answers.withColumn("_p", F.when(F.get_json_object(body, "$").isNotNull() & body.startswith("{"), F.from_json(body, ANSWER)))
    bad, r = F.col("_p").isNull(), F.col("_p.predicted_settlement_range")
    step = lambda s, k: F.struct(
        F.coalesce(s["step_number"], k + 1).alias("step"), F.coalesce(s["category"], F.lit("analysis")).alias("category"), F.coalesce(s["title"], F.lit("")).alias("title"), F.coalesce(s["content"], F.lit("")).alias("content"),
        F.coalesce(s["confidence"], F.lit(STEP)).alias("confidence"), _cited(s["citations"]).alias("citations"))
    raw = F.struct(F.lit(1).alias("step"), F.lit("analysis").alias("category"), F.lit(UNPARSED[1]).alias("title"), F.substring(F.col(column), 1, RAW).alias("content"), F.lit(FALLBACK).alias("confidence"), F.array().cast(CITATIONS).alias("citations"))
    issue = lambda i: F.struct(
        F.coalesce(i["issue_type"], F.lit("")).alias("issue"), _outcome(i["predicted_outcome"]).alias("outcome"), i["predicted_amount"].alias("amount"), F.coalesce(i["confidence"], F.lit(OVERALL)).alias("confidence"),
        F.coalesce(i["reasoning"], F.lit("")).alias("reasoning"), _cited(i["supporting_cases"]).alias("citations"))
    count = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.size(x["citations"]))
    rows = rows.withColumns({
        "is_fallback": bad, "outcome": _outcome(F.col("_p.overall_outcome")), "confidence": F.when(bad, FALLBACK).otherwise(F.coalesce("_p.overall_confidence", F.lit(OVERALL))),
        "summary": F.when(bad, UNPARSED[0]).otherwise(F.coalesce("_p.outcome_summary", F.lit(""))),
        "issues": F.transform(F.coalesce("_p.issue_predictions", F.array()), issue), "steps": F.when(bad, F.array(raw)).otherwise(F.transform(F.coalesce("_p.reasoning_trace", F.array()), step)),
        "low": F.when(F.size(r) == 2, r[0]), "high": F.when(F.size(r) == 2, r[1]),
    })
    return rows.withColumns({"n_steps": F.size("steps"), "n_citations": count(F.col("steps")) + count(F.col("issues"))}).drop("_p")


def structured(answers: DataFrame, schema: str, required: tuple[str, ...] = (), column: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(good, bad): good has the answer's JSON as the columns of schema; bad, for a retry or a report, why it was refused."""
    body = fenced_json(F.col(column))
    rows = answers.withColumn("_p", F.from_json(body, schema))
    lacks = F.array_compact(F.array(*[F.when(F.col(f"_p.{f}").isNull(), f) for f in required]))
    why = F.when(F.get_json_object(body, "$").isNull(), "not JSON").when(F.size(lacks) > 0, F.concat(F.lit("missing: "), F.array_join(lacks, ", ")))
    rows = rows.withColumn("problem", why)
    return rows.filter("problem is null").select(*answers.columns, "_p.*"), rows.filter("problem is not null").select(*answers.columns, "problem")


def prompt_with_schema(prompt: Column, schema: str) -> Column:
    """A prompt that asks for JSON of a schema."""
    return F.concat(prompt, F.lit(f"\n\nAnswer with JSON of this schema only: {schema}"))


def uncertain(cases: DataFrame, reason: Column) -> DataFrame:
    """(case_id, outcome, confidence, reason, missing_information) of cases whose gate was shut."""
    from casemill.operators.intake import missing_fields

    return cases.select("case_id", F.lit("uncertain").alias("outcome"), F.lit(0.0).alias("confidence"), reason.alias("reason"), missing_fields().alias("missing_information"))


def predict(cases: DataFrame, retrieved: DataFrame, provider: Provider) -> DataFrame:
    """(case_id, outcome, confidence, n_citations, reason) of case rows with what was retrieved for them (case_id, gate, context).

    A case whose gate is shut is uncertain without a call; a case without retrieval goes to the model with its facts alone.
    """
    rows = cases.join(retrieved.select("case_id", "gate", "context"), "case_id", "left").withColumn("gate", F.coalesce("gate", F.lit("proceed")))
    told = rows.filter("gate = 'proceed'").select("case_id", F.concat_ws("\n\n", F.col("facts"), F.col("context")).alias("prompt"))
    made = parse(generate(told, provider)).select("case_id", "outcome", "confidence", "n_citations", F.lit(None).cast("string").alias("reason"))
    shut = uncertain(rows.filter("gate <> 'proceed'"), F.col("gate")).select("case_id", "outcome", "confidence", F.lit(0).alias("n_citations"), "reason")
    return made.unionByName(shut)


def predict_and_store(asked: DataFrame, cases: DataFrame, retrieved: DataFrame, provider: Provider, folder: str, at: Column) -> DataFrame:
    """Graphs and predictions of the asked cases (case_id) in folder; returns the predictions as stored.  A case that is not there is an error."""
    from casemill.operators import graph

    known = F.when(F.col("_known"), F.col("case_id")).otherwise(F.raise_error(F.concat(F.lit("no such case: "), F.col("case_id").cast("string"))).cast(cases.schema["case_id"].dataType))
    checked = asked.select("case_id").distinct().join(cases.select("case_id", F.lit(True).alias("_known")), "case_id", "left").select(known.alias("case_id"))
    wanted = cases.join(checked, "case_id", "left_semi")
    graph.save_graphs(graph.nodes(wanted), graph.edges(wanted), f"{folder}/graphs")
    made = predict(wanted, retrieved, provider).withColumn("created_at", at)
    made.write.mode("append").parquet(f"{folder}/predictions")
    return asked.sparkSession.read.parquet(f"{folder}/predictions").join(checked, "case_id", "left_semi")


def context(results: DataFrame, *, rank: str = "rank", size: int = 1500) -> DataFrame:
    """(query_id, context): the numbered extracts of a query's few results, in order of rank."""
    block = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.col("id").cast("string"), F.lit(": "), F.substring("text", 1, size), F.lit("..."))
    return results.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def lines(**fields: Column) -> Column:
    """`label: value` lines of the fields that are there."""
    return F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{k.replace('_', ' ').capitalize()}: "), v.cast("string"))) for k, v in fields.items()])), "\n")


def cost(tokens: Column, price_per_million: Column) -> Column:
    """Null for a model without a price."""
    return F.round(tokens / 1e6 * price_per_million, 6)
