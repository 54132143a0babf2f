"""Files that every executor and the driver can reach, and small helpers for Python stages.

All scratch lies below the folder that the cluster names in spark.checkpoint.dir.  Only where that setting is absent and the
master is one process (tests, one machine) a folder of our own takes its place; on a cluster its absence is an error.  Files are written under a temporary name and renamed, so a task that is
run again replaces a file whole.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20

_own: list[str] = []
_made: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="casemill-shared-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """The URI of a new folder in the shared place; it is made by the first write."""
    path = f"{shared_root(spark)}/casemill/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


@contextmanager
def cleared():
    """Removes, at its end, the scratch folders made inside it; gives a function that writes a frame to a folder that stays."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        _made[-1].pop()
        return out

    _made.append([])
    try:
        yield keep
    finally:
        for path in _made.pop():
            fs, place = filesystem(path)
            with suppress(FileNotFoundError, OSError):
                fs.delete_dir(place)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared place: cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those of least key hash.

    A share of the hash range that holds about twice as many is cut out first, so that no task meets the best of every partition.
    """
    from pyspark.sql import functions as F

    n = rows.count()
    if n > 4 * most:
        rows = rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * 2 * most / n))
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def slices(batch, column: int = 1, *, rows: int = 512, size: int = 4 << 20):
    """Parts of an Arrow batch of at most `rows` rows and `size` bytes of text in a column; a row that is larger stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        before = int(ends[at - 1]) if at else 0
        end = min(at + rows, n, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Gives memory that a task's arrays held back to the system: a worker process serves many tasks, and idle ones keep theirs otherwise."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), with batches of bounded bytes and memory given back at the end of each task.

    Spark cuts batches by rows, and by bytes only at 64 MB, which rows of long texts do reach; so the session's
    spark.sql.execution.arrow.maxBytesPerBatch is lowered to BATCH_BYTES where it is larger or absent.
    """
    conf = df.sparkSession.conf
    now = int(re.sub(r"\D*$", "", conf.get(BATCH_SETTING, None) or "0"))
    if not 0 < now <= BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def whole(fs, path: str):
    """A stream under a temporary name that is renamed to path once the block has ended well; a second attempt replaces the first."""
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part, compression=None) as out:
        yield out
    fs.move(part, path)


def put_whole(fs, path: str, write) -> None:
    """Calls write(stream) on a temporary name, then renames it to path."""
    with whole(fs, path) as out:
        write(out)


def drop(fs, path: str) -> None:
    with suppress(FileNotFoundError, OSError):
        fs.delete_file(path)


def groups(batches, keys: int):
    """Tables of equal values in the first `keys` (integer) columns, from batches sorted by them; one group is held at a time."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(cuts[-2], cuts[-1] - cuts[-2]))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def blocks(batches, size: int):
    """Tables of whole runs of equal values in the first (integer) column, from batches sorted by it, cut once they pass `size` bytes."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    held_bytes = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes < size:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut).combine_chunks()
        held, held_bytes = rest.to_batches(), rest.nbytes
    if held:
        yield pa.Table.from_batches(held)
