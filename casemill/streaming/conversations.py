"""Conversations as a stream: the state of each session lives between its messages, and idle sessions end by themselves.

The state of a session is its stage, the tries spent in it, the last value of each field and the last message's number; Spark keeps it in
the stream's checkpoint, so a query that is started again goes on where the last one was.  A batch of messages gives what
intake.message_step gives over the whole conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from casemill.functions.records import unwrap
from casemill.operators.intake import extraction, next_stage

STATE = "stage string, tries int, role_set boolean, seq long, known map<string,string>"


def message_stream(messages: DataFrame, fields: dict[str, str], *, idle_seconds: int = 7200, delay: str = "10 minutes", carry_tries: bool = False) -> DataFrame:
    """(session_id, seq, stage, tries, is_complete, ended, and each field) after each message of a stream (session_id, seq, at, text, role, answer).

    answer is the extractor's, null where it gave none; role is what the message sets.  A session begins with its first message, in the
    greeting.  Its messages come in the order of seq; one whose number is not above the last one's was seen before and gives no row, so
    a message that is sent twice counts once.  A session without a message for idle_seconds of event time gives one last row with ended set
    and its state is dropped; a later message begins a new one.  A session that is complete is dropped in the same way.
    """
    names = list(fields)
    x = extraction(F.col("answer"))
    found = F.map_filter(F.create_map(*[c for f in names for c in (F.lit(f), unwrap(x, f).cast("string"))]), lambda _, v: v.isNotNull())
    rows = messages.select(F.col("session_id").cast("long"), F.col("seq").cast("long"), "at", F.unix_millis("at").alias("ms"), "text", "role", F.to_json(found).alias("found"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", delay)

    def step(key, batches, state: GroupState):
        import json

        import pandas as pd

        columns = ["session_id", "seq", "stage", "tries", "is_complete", "ended", "known"]
        if state.hasTimedOut:
            stage, tries, _, seq, known = state.get
            state.remove()
            yield pd.DataFrame([(key[0], seq, stage, tries, stage == "complete", True, dict(known))], columns=columns)
            return
        stage, tries, role_set, last, known = state.get if state.exists else ("greeting", 0, False, -1, {})
        known, out, latest = dict(known), [], 0
        pdf = pd.concat(list(batches)).drop_duplicates("seq").sort_values("seq")
        for seq, ms, text, role, new in pdf[["seq", "ms", "text", "role", "found"]].itertuples(index=False):
            latest = max(latest, int(ms))
            if seq <= last:
                continue
            known |= json.loads(new)
            role_set = role_set or (role is not None and role == role)
            if stage == "greeting" and role_set:
                stage = "basic_details"
            stage, tries = next_stage(stage, tries, set(known), text or "", role_set, carry_tries=carry_tries)
            last = int(seq)
            out.append((key[0], last, stage, tries, stage == "complete", False, dict(known)))
        state.update((stage, int(tries), bool(role_set), last, known))
        # never before the watermark, which Spark refuses
        state.setTimeoutTimestamp(max(latest + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    schema = "session_id long, seq long, stage string, tries int, is_complete boolean, ended boolean, known map<string,string>"
    done = rows.groupBy("session_id").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return done.select("session_id", "seq", "stage", "tries", "is_complete", "ended", *[F.try_element_at("known", F.lit(f)).cast(kind).alias(f) for f, kind in fields.items()])
