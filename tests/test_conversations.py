"""Stored conversation state: a stream over several micro-batches and restarts equals the fold over whole conversations."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from casemill.operators import intake
from casemill.streaming.conversations import message_stream

FIELDS = {"address": "string", "start_date": "string", "deposit_amount": "double", "deposit_protected": "boolean", "issues": "string"}
MESSAGE = "session_id long, seq long, at timestamp, text string, role string, answer string"
START = dt.datetime(2024, 1, 1, 10)


def conversations():
    rng, out = random.Random(4), []
    for s in range(12):
        for i in range(rng.randint(3, 14)):
            found = {f: {"value": v, "confidence": 0.5} for f, v in (("address", f"a{i}"), ("start_date", "2020-01-01"), ("deposit_amount", 100 + i), ("deposit_protected", True), ("issues", "x")) if rng.random() < 0.3}
            answer = rng.choice([json.dumps(found), json.dumps({"no_new_info": True}), "no JSON", None]) if rng.random() < 0.3 else json.dumps(found)
            out.append((s, i, START + dt.timedelta(minutes=i), rng.choice(["yes", "hm", None]), "tenant" if i == 1 else None, answer))
    return out


def test_a_stream_equals_the_fold(spark, tmp_path):
    rows = conversations()
    frame = spark.createDataFrame(rows, MESSAGE)
    want = intake.message_step(frame.select("session_id", "seq", "text", "role"), frame.filter("answer is not null").select("session_id", "seq", "answer"), FIELDS)
    columns = ["session_id", "seq", "stage", "tries", "is_complete", *FIELDS]
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")

    def run():
        stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 2).parquet(source)
        message_stream(stream, FIELDS).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    frame.filter("seq < 3").coalesce(1).write.parquet(source)
    run()
    # a restart goes on from the checkpoint; the first messages come again and count once
    for low, high in ((1, 6), (6, 9), (9, 99)):
        frame.filter(f"seq >= {low} and seq < {high}").coalesce(1).write.mode("append").parquet(source)
        run()
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.filter("not ended").select(*columns).collect()), key=str) == sorted(map(tuple, want.select(*columns).collect()), key=str)
    # hours later other sessions go on, and the idle ones end
    spark.createDataFrame([(99, i, START + dt.timedelta(hours=h), "hello", None, None) for i, h in ((0, 5), (1, 9), (2, 9))], MESSAGE).coalesce(1).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([(99, 3, START + dt.timedelta(hours=9), "hello", None, None)], MESSAGE).coalesce(1).write.mode("append").parquet(source)
    run()
    ended = spark.read.parquet(out).filter("ended")
    last = want.groupBy("session_id").agg(F.max("seq").alias("seq")).join(want, ["session_id", "seq"])
    assert sorted(map(tuple, ended.select(*columns).collect()), key=str) == sorted(map(tuple, last.select(*columns).collect()), key=str)
