"""Conversations folded into case records, stages, readiness, and disputes of two parties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions.lexicons import EVIDENCE_WORDS, ISSUE_WORDS, first_match
from casemill.functions.records import fenced_json, unwrap, unwrap_confidence
from casemill.sources.scratch import stored

# Stages in order, what each needs, tries before it is left anyway, and words that confirm.
STAGES = ("greeting", "role_identification", "basic_details", "tenancy_details", "deposit_details", "issue_identification", "evidence_collection", "claim_amounts", "narrative", "confirmation", "complete")
NEEDS = {"basic_details": ("address",), "tenancy_details": ("start_date",), "deposit_details": ("deposit_amount", "deposit_protected"), "issue_identification": ("issues",)}
MAX_TRIES = 3
CONFIRM = ("yes", "correct", "right", "confirm", "looks good", "that's right")
REQUIRED = (("address", "property address"), ("start_date", "tenancy start date"), ("deposit_amount", "deposit amount"), ("deposit_protected", "deposit protection status"), ("issues", "dispute issues"))


def next_stage(stage: str, tries: int, known: set[str], message: str, role_set: bool, *, carry_tries: bool = False) -> tuple[str, int]:
    """The stage after a message, and the tries spent in it.

    Leaving a stage starts its tries anew.  The reference raises its counter and shows no reset (the method that leaves a stage is
    missing from its tree); carry_tries keeps counting over stages, in case it has none.
    """
    fresh = tries if carry_tries else 0
    if stage in ("role_identification", "greeting"):
        return ("basic_details", fresh) if role_set else (stage, tries)
    if stage in NEEDS:
        if known.issuperset(NEEDS[stage]):
            return STAGES[STAGES.index(stage) + 1], fresh
        if tries + 1 >= MAX_TRIES:
            return STAGES[STAGES.index(stage) + 1], tries + 1 if carry_tries else 0
        return stage, tries + 1
    if stage in ("evidence_collection", "claim_amounts", "narrative"):
        return STAGES[STAGES.index(stage) + 1], fresh
    if stage == "confirmation" and any(w in message.lower() for w in CONFIRM):
        return "complete", fresh
    return stage, tries


def stage_fold(messages: DataFrame, *, carry_tries: bool = False) -> DataFrame:
    """(session_id, seq, stage, tries) after each user message (session_id, seq, text, fields array<string>: what becomes known, role).

    role is what the message sets (null: nothing; without the column the role is known from the start).  A session starts in the
    greeting, which a set role leaves before its message is judged.  A session's messages, a conversation's length, meet in one task.
    """

    def fold(pdf):
        import pandas as pd

        role_set, tries, known, out = not has_role, 0, set(), []
        stage = "basic_details" if role_set else "greeting"
        for seq, text, fields, role in pdf.sort_values("seq")[["seq", "text", "fields", "role"]].itertuples(index=False):
            known |= set(fields if fields is not None else ())
            if role is not None and role == role:
                role_set = True
            if stage == "greeting" and role_set:
                stage = "basic_details"
            stage, tries = next_stage(stage, tries, known, text or "", role_set, carry_tries=carry_tries)
            out.append((pdf["session_id"].iloc[0], seq, stage, tries))
        return pd.DataFrame(out, columns=["session_id", "seq", "stage", "tries"])

    has_role = "role" in messages.columns
    role = F.col("role") if has_role else F.lit(None).cast("string")
    rows = messages.select(F.col("session_id").cast("long"), F.col("seq").cast("long"), "text", "fields", role.alias("role"))
    return rows.groupBy("session_id").applyInPandas(fold, "session_id long, seq long, stage string, tries int")


def merge_extractions(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows (session_id, seq, one column a field, issues array, narrative): the last non-null value of each field, distinct issues, joined narrative."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("narrative").isNotNull(), F.struct("seq", "narrative")))), lambda x: x["narrative"]), "\n")
    return rows.groupBy("session_id").agg(*last, F.array_sort(F.array_distinct(F.flatten(F.collect_list("issues")))).alias("issues"), said.alias("narrative"))


def missing_fields() -> Column:
    """Labels of the required fields a case lacks, in order."""
    lacks = {name: (F.size(F.coalesce(F.col(name), F.array())) <= 0) if name == "issues" else F.col(name).isNull() for name, _ in REQUIRED}
    return F.array_compact(F.array(*[F.when(lacks[name], label) for name, label in REQUIRED]))


def readiness(cases: DataFrame) -> DataFrame:
    """(case_id, missing, is_ready, completeness, actions); completeness is our own: the share of required fields present."""
    rows = cases.select("case_id", missing_fields().alias("missing"))
    n = F.size("missing")
    actions = F.when(n == 0, F.array(F.lit("Generate prediction"), F.lit("Upload additional evidence"))).otherwise(F.array(F.concat(F.lit("Complete required info: "), F.array_join("missing", ", "))))
    return rows.select("case_id", "missing", (n == 0).alias("is_ready"), F.round(1 - n / len(REQUIRED), 2).alias("completeness"), actions.alias("actions"))


def issue_of(text: Column) -> Column:
    return first_match(F.lower(text), ISSUE_WORDS)


def evidence_of(text: Column) -> Column:
    return first_match(F.lower(text), EVIDENCE_WORDS)


def invite_code(dispute_id: Column) -> Column:
    """Eight upper-case hexadecimal places that follow from the id."""
    return F.upper(F.substring(F.sha2(dispute_id.cast("string"), 256), 1, 8))


def open_role() -> Column:
    """Of a dispute row: the slot that an invitation fills, or why there is none."""
    return F.when(F.col("dispute_id").isNull(), "invalid").when(F.col("tenant_session_id").isNull(), "tenant").when(F.col("landlord_session_id").isNull(), "landlord").otherwise("both_joined")


def dispute_status(disputes: DataFrame, sessions: DataFrame) -> DataFrame:
    """(dispute_id, status) from both sides' sessions (session_id, is_complete); the sides are one column before the join."""
    sides = disputes.select("dispute_id", F.explode(F.array(F.struct(F.lit("tenant").alias("side"), F.col("tenant_session_id").alias("session_id")), F.struct(F.lit("landlord").alias("side"), F.col("landlord_session_id").alias("session_id")))).alias("s")).select("dispute_id", "s.*")
    joined = sides.join(sessions, "session_id", "left")
    per = joined.groupBy("dispute_id").agg(F.count("session_id").alias("n"), F.bool_and(F.coalesce("is_complete", F.lit(False))).alias("done"), F.max(F.when(F.col("session_id").isNull(), F.col("side"))).alias("absent"))
    status = F.when(F.col("n") < 2, F.concat(F.lit("waiting_for_"), F.col("absent"))).when(F.col("done"), "both_complete").otherwise("in_progress")
    return per.select("dispute_id", status.alias("status"))


def case_summary() -> Column:
    """Lines of what is known of a case row."""
    from casemill.operators.predict import lines

    return lines(role=F.col("user_role"), property=F.col("address"), tenancy_start=F.col("start_date"), deposit=F.col("deposit_amount"), protected=F.col("deposit_protected"), issues=F.when(F.size("issues") > 0, F.array_join("issues", ", ")))


def create_disputes(requests: DataFrame, taken: DataFrame, *, rounds: int = 8) -> DataFrame:
    """(dispute_id, code, tenant_session_id, landlord_session_id, status) of requests (dispute_id, session_id, role; ids are unique).

    A request whose code is in use (taken: code), or wanted by a smaller id, gets the code of its next round; of eight hexadecimal
    places a code is free with near certainty in the first.  Only requests that have no code yet ask in a round, and the rounds end once
    all have one.  A request that finds none in all rounds is an error, not a lost row.
    """
    left, used, codes = requests.select("dispute_id"), taken.select("code"), None
    for k in range(rounds):
        offer = invite_code(F.col("dispute_id") if k == 0 else F.concat_ws("#", F.col("dispute_id").cast("string"), F.lit(str(k))))
        free = left.select("dispute_id", offer.alias("code")).join(used, "code", "left_anti")
        won = stored(free.groupBy("code").agg(F.min("dispute_id").alias("dispute_id")).select("dispute_id", "code"), "codes")
        codes = won if codes is None else codes.unionByName(won)
        left = stored(left.join(won, "dispute_id", "left_anti"), "codeless")
        if left.isEmpty():
            break
        used = used.unionByName(won.select("code"))
    rows = requests.join(codes, "dispute_id", "left").withColumn("code", F.coalesce("code", F.raise_error(F.lit("no free invite code")).cast("string")))
    slot = lambda role: F.when(F.col("role") == role, F.col("session_id"))
    status = F.when(F.col("role") == "tenant", "waiting_for_landlord").otherwise("waiting_for_tenant")
    return rows.select("dispute_id", "code", slot("tenant").alias("tenant_session_id"), slot("landlord").alias("landlord_session_id"), status.alias("status"))


def _code(column: str) -> Column:
    return F.upper(F.trim(F.col(column)))


def _addressed(disputes: DataFrame, requests: DataFrame) -> DataFrame:
    """requests as (code, dispute_id, session_id, role): the dispute that a request names, else the one of the least id that has its code."""
    named = F.col("dispute_id") if "dispute_id" in requests.columns else F.lit(None)
    kind = disputes.schema["dispute_id"].dataType
    asked = requests.select(_code("code").alias("code"), named.cast(kind).alias("_named"), "session_id", "role")
    owners = disputes.groupBy("code").agg(F.min("dispute_id").alias("_owner"))
    return asked.join(owners, "code", "left").select("code", F.coalesce("_named", "_owner").alias("dispute_id"), "session_id", "role")


def join_outcomes(disputes: DataFrame, requests: DataFrame) -> DataFrame:
    """(code, session_id, role, outcome) of requests: joined, taken (the slot was filled, or an earlier request fills it) or unknown (no such code).

    Of several requests for one slot the one of the least session_id is first.  A row a request: it is for one dispute, which it may name
    by dispute_id beside the code, where a code is not of one dispute alone; without, that of the least id that has the code is meant.
    """
    known = disputes.select("code", "dispute_id", "tenant_session_id", "landlord_session_id", F.lit(True).alias("_known"))
    rows = _addressed(disputes, requests).join(known, ["code", "dispute_id"], "left")
    filled = F.when(F.col("role") == "tenant", F.col("tenant_session_id")).otherwise(F.col("landlord_session_id")).isNotNull()
    first = F.row_number().over(Window.partitionBy("code", "dispute_id", "role").orderBy("session_id")) == 1
    outcome = F.when(F.col("_known").isNull(), "unknown").when(filled | ~first, "taken").otherwise("joined")
    return rows.select("code", "session_id", "role", outcome.alias("outcome"))


def join_disputes(disputes: DataFrame, requests: DataFrame) -> DataFrame:
    """disputes after requests (code, session_id, role): a free slot is filled, a taken one is left; codes are compared upper-case and trimmed.

    A row a dispute, however many ask for it; join_outcomes() tells what became of each request, and which dispute one is for.
    """
    first = lambda role: F.min(F.when(F.col("role") == role, F.col("session_id"))).alias(f"_{role}")
    asked = _addressed(disputes, requests).groupBy(F.col("code").alias("_c"), F.col("dispute_id").alias("_d")).agg(first("tenant"), first("landlord"))
    rows = disputes.join(asked, (F.col("code") == F.col("_c")) & (F.col("dispute_id") == F.col("_d")), "left")
    fill = lambda role: F.coalesce(F.col(f"{role}_session_id"), F.col(f"_{role}")).alias(f"{role}_session_id")
    return rows.select("dispute_id", "code", fill("tenant"), fill("landlord"))


def sync_disputes(disputes: DataFrame, cases: DataFrame, shared: tuple[str, ...] = ("property_address", "property_postcode", "deposit_amount")) -> DataFrame:
    """disputes with shared fields that are still empty (null, "" or 0) taken from cases, a row a session: dispute_id, role, intake_complete and
    the fields.  Of several sessions the tenant's value is first.  A side that is complete marks its flag, and both the status."""
    empty = lambda c: F.col(c).isNull() | F.col(c).cast("string").isin("", "0", "0.0")
    first = [F.min_by(c, F.when(~empty(c), F.when(F.col("role") == "tenant", 0).otherwise(1))).alias(f"_{c}") for c in shared]
    done = [F.bool_or((F.col("role") == r) & F.coalesce("intake_complete", F.lit(False))).alias(f"_{r}_complete") for r in ("tenant", "landlord")]
    rows = disputes.join(cases.groupBy(F.col("dispute_id").alias("_d")).agg(*first, *done), disputes.dispute_id == F.col("_d"), "left")
    flag = lambda r: F.coalesce(F.col(f"{r}_complete"), F.lit(False)) | F.coalesce(F.col(f"_{r}_complete"), F.lit(False))
    status = F.when(flag("tenant") & flag("landlord"), "both_complete").otherwise(F.col("status"))
    new = {c: F.when(empty(c), F.col(f"_{c}")).otherwise(F.col(c)) for c in shared} | {"tenant_complete": flag("tenant"), "landlord_complete": flag("landlord"), "status": status}
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in disputes.columns])


def force_ready(disputes: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, dispute_id, old_status, new_status) of asked sessions (session_id): ready_for_mediation once both have joined, whatever is complete.

    A session without a dispute stays, with nulls.
    """
    side = F.array(F.col("tenant_session_id"), F.col("landlord_session_id"))
    linked = disputes.select(F.explode(F.array_compact(side)).alias("session_id"), "dispute_id", F.col("status").alias("old_status"), (F.size(F.array_compact(side)) == 2).alias("both"))
    rows = sessions.select("session_id").join(linked, "session_id", "left")
    return rows.select("session_id", "dispute_id", "old_status", F.when(F.col("both"), "ready_for_mediation").otherwise(F.col("old_status")).alias("new_status"))


# The lines of the response's context.
COLLECTED, ASK = "INFORMATION COLLECTED SO FAR:", "INSTRUCTION: Proactively ask for ONE of the missing required fields in your next question."
STILL_MISSING, ALL_THERE = "\n⚠️ REQUIRED INFO STILL MISSING (must collect before prediction): ", "\n✓ ALL REQUIRED INFORMATION COLLECTED - User can now generate prediction!"
NATURALLY = "Continue the conversation naturally, collecting relevant information."
GREETING = "Welcome. I help with tenancy deposit disputes. Are you a tenant or a landlord? Please describe your situation briefly."


def response_context(guidance: dict[str, dict[str, str]]) -> Column:
    """What a model is told before it answers, of a case row with user_role and stage: guidance by role and stage, facts, what is missing, completeness."""
    texts = F.create_map(*[F.lit(x) for role, per in guidance.items() for stage, said in per.items() for x in (f"{role}/{stage}", said)]) if guidance else None
    role = F.when(F.col("user_role") == "landlord", "landlord").otherwise("tenant")
    said = F.coalesce(F.try_element_at(texts, F.concat_ws("/", role, "stage")), F.lit(NATURALLY)) if guidance else F.lit(NATURALLY)
    fact = lambda label, value: F.when(value.isNotNull() & (value.cast("string") != ""), F.concat(F.lit(f"- {label}: "), value.cast("string")))
    kinds = F.array_join(F.transform("evidence", lambda e: e["type"]), ", ")
    missing = missing_fields()
    facts = [
        fact("Property", F.col("address")), fact("Tenancy start", F.col("start_date")), fact("Tenancy end", F.col("end_date")), F.when(F.col("deposit_amount") != 0, F.concat(F.lit("- Deposit: £"), F.col("deposit_amount").cast("string"))),
        fact("Deposit protection", F.when(F.col("deposit_protected"), "Protected").when(~F.col("deposit_protected"), "NOT PROTECTED")),
        fact("Issues", F.array_join("issues", ", ")), fact("Evidence mentioned", kinds),
    ]
    need = F.when(F.size(missing) > 0, F.concat(F.lit(STILL_MISSING), F.array_join(missing, ", "), F.lit("\n" + ASK))).otherwise(F.lit(ALL_THERE))
    done = F.concat(F.lit("\nCompleteness: "), F.round((1 - F.size(missing) / len(REQUIRED)) * 100, 0).cast("int").cast("string"), F.lit("%"))
    return F.array_join(F.array_compact(F.array(said, F.lit(""), F.lit(COLLECTED), *facts, need, done)), "\n")


def extraction(answer: Column) -> Column:
    """The JSON of an extractor's answer, or null where there is nothing to apply: no_new_info, no JSON at all, or no answer."""
    body = fenced_json(answer)
    return F.when(F.get_json_object(body, "$").isNotNull() & ~F.coalesce(F.get_json_object(body, "$.no_new_info") == "true", F.lit(False)), body)


def extracted_fields(answers: DataFrame, fields: dict[str, str]) -> DataFrame:
    """answers (session_id, seq, answer) with each field (name: type) unwrapped, no_new_info and avg_confidence (0 where nothing was extracted).

    An answer that cannot be read changes nothing, as one that says so itself.
    """
    rows = answers.withColumn("_x", extraction(F.col("answer")))
    sure = F.array_compact(F.array(*[unwrap_confidence(F.col("_x"), f) for f in fields]))
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda s, x: s + x) / F.size(sure)).otherwise(0.0)
    return rows.select("session_id", "seq", *[unwrap(F.col("_x"), f).cast(kind).alias(f) for f, kind in fields.items()], F.col("_x").isNull().alias("no_new_info"), mean.alias("avg_confidence"))


def message_step(messages: DataFrame, answers: DataFrame, fields: dict[str, str], **options) -> DataFrame:
    """(session_id, seq, stage, tries, is_complete, and each field as known by then) after each user message (session_id, seq, text, role).

    answers are the extractor's (session_id, seq, answer).  Fields keep their last value; the stages fold over what is known.
    """
    found = extracted_fields(answers, fields)
    rows = messages.join(found, ["session_id", "seq"], "left")
    upto = Window.partitionBy("session_id").orderBy("seq")
    known = rows.select("session_id", "seq", "text", "role", *[F.last(f, True).over(upto).alias(f) for f in fields])
    names = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), f) for f in fields]))
    stages = stage_fold(known.select("session_id", "seq", "text", "role", names.alias("fields")), **options)
    return known.join(stages, ["session_id", "seq"]).select("session_id", "seq", "stage", "tries", (F.col("stage") == "complete").alias("is_complete"), *fields)


def respond(rows: DataFrame, provider, guidance: dict[str, dict[str, str]]) -> DataFrame:
    """Case rows with the context a model is given and its answer; a case that has not left the greeting without a role gets the fixed greeting."""
    from casemill.operators.predict import generate

    greeted = F.col("user_role").isNull() & (F.col("stage") == "greeting")
    told = rows.withColumn("context", F.when(greeted, F.lit("Start the conversation")).otherwise(response_context(guidance)))
    return generate(told, provider, "context").withColumn("answer", F.when(greeted, F.lit(GREETING)).otherwise(F.col("answer")))
