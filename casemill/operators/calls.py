"""Calls of a paid provider: repeated with growing pauses, put in the order of what was asked, and written down so that none is paid twice."""

from __future__ import annotations

import hashlib
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casemill.operators.predict import RateLimited

#: What a later attempt may mend.
PASSING = (RateLimited, ConnectionError, TimeoutError)
#: call(texts) gives (index, answer) pairs in any order.
Call = Callable[[list[str]], list[tuple[int, object]]]


@dataclass(frozen=True)
class BackOff:
    """Up to `tries` attempts; the pause doubles from `first` seconds to `most`, less a random part so that tasks do not meet again."""

    tries: int = 5
    first: float = 1.0
    most: float = 60.0

    def __call__(self, call: Call, texts: list[str]) -> list:
        for k in range(self.tries):
            try:
                return in_order(call(texts), len(texts))
            except PASSING:
                if k + 1 == self.tries:
                    raise
                time.sleep(min(self.most, self.first * 2**k) * random.uniform(0.5, 1))
        raise ValueError("a call needs at least one try")


def in_order(pairs: list[tuple[int, object]], n: int) -> list:
    """The answers by their index; an index that is missing, repeated or too large is an error, never a shifted answer."""
    if sorted(i for i, _ in pairs) != list(range(n)):
        raise ValueError(f"{n} texts gave answers for {sorted(i for i, _ in pairs)}")
    return [answer for _, answer in sorted(pairs, key=lambda p: p[0])]


def indexed(answer: Callable[[list[str]], list]) -> Call:
    """A Call of a provider that answers in order."""
    return lambda texts: list(enumerate(answer(texts)))


def ledger(rows: DataFrame, folder: str, kind: str) -> DataFrame:
    """(call, answer): all answers written down in folder, by the SHA-256 of what was asked; one row a call."""
    return rows.sparkSession.read.schema(f"call string, answer {kind}").parquet(folder).dropDuplicates(["call"])


def answered(rows: DataFrame, call: Call, folder: str, *, column: str = "prompt", kind: str = "string", batch: int = 50, back_off: BackOff | None = None) -> DataFrame:
    """rows with the column answer of type kind, in place of one they have: call's answer to the text of column.

    Equal texts are asked once; texts that folder knows are not asked at all; null texts are not asked and have a null answer.  Each
    batch's answers become a file of folder before the next batch is asked, so a task that runs again, or a job after one that failed,
    asks only what is left.  folder is the URI of a place that driver and executors share, for one model and one kind of answer.
    A speculative copy of a task may pay for a batch that the other one is asking.
    """
    from pyarrow import fs

    back_off = back_off or BackOff()
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    key = F.sha2(F.col(column).cast("binary"), 256)
    asked = rows.filter(F.col(column).isNotNull()).select(key.alias("call"), F.col(column).alias("text")).distinct()
    asked = asked.join(ledger(rows, folder, kind).select("call"), "call", "left_anti").repartition("call").sortWithinPartitions("call")
    schema = StructType.fromDDL(f"call string, answer {kind}")

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        system, root = fs.FileSystem.from_uri(folder)
        made = to_arrow_schema(schema)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                calls, texts = (c.to_pylist() for c in b.slice(at, batch).columns)
                name = f"{root}/{hashlib.sha256(''.join(calls).encode()).hexdigest()}.parquet"
                if system.get_file_info(name).type == fs.FileType.NotFound:
                    table = pa.table([pa.array(calls, pa.string()), pa.array(back_off(call, texts), made.field(1).type)], schema=made)
                    part = f"{root}/_{uuid.uuid4().hex}"  # Spark does not read names that begin so
                    pq.write_table(table, part, filesystem=system)
                    system.move(part, name)
                yield pa.RecordBatch.from_arrays([pa.array([len(calls)], pa.int64())], ["n"])

    asked.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
    known = ledger(rows, folder, kind)
    return rows.withColumn("_call", key).drop("answer").join(known.withColumnRenamed("call", "_call"), "_call", "left").drop("_call")
