"""Media columns: payloads as image members of archives, and a data source that reads them by byte range.

Every payload is stored as an 8-bit greyscale PNG, 64 samples a row, which is lossless.  Members lie one after the other in
archive files; a sidecar of fixed-width entries tells where each begins.  The data source lists the archive directory, cuts
every archive into byte ranges (one input partition each) and a partition reads the members that begin in its range: it finds
them by binary search in the sidecar, streams them through Arrow in batches of bounded bytes, and when a member fails to read
or decode opens the archive anew and tries that member alone, by its offset, before it gives up on it.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from casemill.llm.shared import filesystem, mapped, put_whole, scratch, slices, written

WIDTH = 64
LEVEL = 1
#: Bytes of a range, at least; ranges grow with the archives so that there are no more than MAX_RANGES to plan.
RANGE_BYTES = 8 << 20
MAX_RANGES = 50_000
BATCH_BYTES = 8 << 20
TRIES = 4
#: offset, length, whether there is an id, id
ENTRY = struct.Struct("<qqqq")
ENTRY_BYTES = ENTRY.size
MAGIC = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, error string"


def padded(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of the row width."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _entry(offset: int, length: int, doc_id: int | None) -> bytes:
    return ENTRY.pack(offset, length, doc_id is not None, doc_id or 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """A greyscale PNG of the payload (a positive multiple of 64 bytes); its private chunk carries the unpadded length."""
    import numpy as np

    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # filter 0 and the samples
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"laNg", struct.pack(">Q", n_bytes)) + _chunk(b"IDAT", zlib.compress(rows, LEVEL)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length); raises ValueError where a checksum or the form is wrong."""
    import numpy as np

    if media[:8] != MAGIC:
        raise ValueError("not a PNG member")
    at, found = 8, {}
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))):
            raise ValueError(f"chunk {kind!r} does not match its checksum")
        found[kind] = found.get(kind, b"") + data
        at += 12 + n
    width, height = struct.unpack_from(">II", found[b"IHDR"])
    rows = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes(), struct.unpack(">Q", found[b"laNg"])[0]


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """Writes every row's text (doc_id, text; null: empty) as a member, an archive and a sidecar a partition; returns the manifest, computed."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        name, index = f"{root}/part-{TaskContext.get().partitionId():06d}.media", bytearray()

        def fill(out):
            at = 0
            for batch in batches:
                for some in slices(batch, rows=256):
                    for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                        data = (text or "").encode()
                        media = encode_png(padded(data), len(data))
                        out.write(media)
                        index.extend(_entry(at, len(media), doc_id))
                        at += len(media)

        put_whole(fs, name, fill)
        put_whole(fs, name + ".idx", lambda out: out.write(bytes(index)))
        yield pa.RecordBatch.from_pydict({"archive": [name], "members": [len(index) // ENTRY_BYTES]})

    return written(mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "archive string, members long"), "media-manifest")


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class MediaReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, tries: int):
        self.folder, self.range_bytes, self.tries = folder, range_bytes, tries

    def partitions(self):
        from pyarrow.fs import FileSelector

        fs, root = filesystem(self.folder)
        files = [f for f in fs.get_file_info(FileSelector(root, allow_not_found=True)) if f.path.endswith(".media")]
        step = max(self.range_bytes, -(-sum(f.size for f in files) // MAX_RANGES))
        found = [ByteRange(f.path, at, min(at + step, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, step)]
        return found or [ByteRange("", 0, 0)]

    def read(self, partition):
        import pyarrow as pa

        if not partition.path:
            return
        fs, _ = filesystem(self.folder)
        kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("error", pa.string())])
        rows, size = [], 0
        with fs.open_input_file(partition.path) as data, fs.open_input_file(partition.path + ".idx") as index:
            for offset, length, has_id, doc_id in self._entries(index, partition):
                row = self._member(fs, partition.path, data, offset, length)
                rows.append({"doc_id": doc_id if has_id else None} | row)
                size += length + len(row["payload"] or b"")
                if size >= BATCH_BYTES or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    @staticmethod
    def _entries(index, partition) -> Iterator[tuple]:
        """The sidecar's entries of members that begin in the range."""

        def entry(k: int) -> tuple:
            index.seek(k * ENTRY.size)
            return ENTRY.unpack(index.read(ENTRY.size))

        total = index.size() // ENTRY.size
        low, high = 0, total
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if entry(middle)[0] < partition.start else (low, middle)
        index.seek(low * ENTRY.size)
        while low < total:
            block = index.read(ENTRY.size * min(4096, total - low))
            for found in ENTRY.iter_unpack(block):
                if found[0] >= partition.end:
                    return
                yield found
            low += len(block) // ENTRY.size

    def _member(self, fs, path: str, data, offset: int, length: int) -> dict:
        """One member; after a failure it is read again by itself from a fresh handle, and its error is returned when all tries fail."""
        error = None
        for k in range(self.tries):
            try:
                if k:
                    time.sleep(0.05 * 2**k)
                    with fs.open_input_file(path) as fresh:
                        fresh.seek(offset)
                        media = fresh.read(length)
                else:
                    data.seek(offset)
                    media = data.read(length)
                payload, n = decode_png(media)
                return {"n_bytes": n, "media": media, "payload": payload, "error": None}
            except (OSError, ValueError, KeyError, struct.error, zlib.error) as problem:
                error = f"{type(problem).__name__}: {problem}"
        return {"n_bytes": None, "media": None, "payload": None, "error": error}


class MediaSource(DataSource):
    """spark.read.format("casemill_media").option("path", folder); options rangeBytes and tries.

    A row per member: doc_id, n_bytes (unpadded), media (the stored form), payload (decoded), error (null, or why the member
    could not be read; the others of its archive are not touched by that).
    """

    @classmethod
    def name(cls) -> str:
        return "casemill_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)), int(self.options.get("tries", TRIES)))


def feature(payload: bytes) -> str:
    """Mean, deviation and an average hash: 64 bits that tell which of 64 stretches of rows are brighter than the whole."""
    import numpy as np

    data = np.frombuffer(payload, np.uint8)
    sums = np.concatenate(([0], np.cumsum(data, dtype=np.int64)))
    cuts = np.arange(65) * len(data) // 64
    bright = (sums[cuts[1:]] - sums[cuts[:-1]]) * len(data) > sums[-1] * (cuts[1:] - cuts[:-1])
    bits = int.from_bytes(np.packbits(bright).tobytes(), "big")
    return f"{data.mean():.4f}:{data.std():.4f}:{bits:016x}"


def read_media(spark: SparkSession, folder: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("casemill_media").option("rangeBytes", str(range_bytes)).load(folder)


def describe(members: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes, media_sha256, feature, error."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = pa.schema([(x, pa.string() if x.endswith("256") or x in ("feature", "error") else pa.int64()) for x in names])
        for batch in (part for b in batches for part in slices(b, 2, rows=256)):
            rows = []
            for r in batch.to_pylist():
                row = {"doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "error": r["error"]}
                if r["error"] is None:
                    payload, media = r["payload"], r["media"]
                    row |= {
                        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
                        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(payload),
                    }
                rows.append({k: row.get(k) for k in names})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return mapped(members, run, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text (doc_id, text) and describes what the data source reads back.

    Null and empty texts are 64 zero bytes; a null doc_id stays null; repeated rows are members of their own; other columns are
    ignored; an empty table gives no rows.  A member that cannot be read after all tries fails the query: no row is lost silently.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "media")
    write_archives(docs, folder)
    rows = describe(read_media(spark, folder))
    return rows.filter(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.col("error")).cast("boolean"))).drop("error")
