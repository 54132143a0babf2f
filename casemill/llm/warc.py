"""WARC archives: writing them as one gzip stream a file, and the normaliser that makes such files seekable.

The normaliser inflates a whole-file stream once, front to back, rewrites every record as a gzip member of its own and writes a
sidecar with each member's offset and length.  Later reads seek: byte ranges of the sidecar are dealt to tasks and a task opens
only its members.  All files lie in the shared folder and are renamed into place; the whole-file archive goes once its
normalised form and sidecar stand, and a repeated attempt that finds those uses them.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.shared import drop, filesystem, mapped, put_whole, scratch, written

MIN_REVISIT_BYTES = 1000
#: Uncompressed bytes after which a writer starts its next archive.
ARCHIVE_BYTES = 32 << 20
#: Compressed bytes of members that one read task takes.
RANGE_BYTES = 4 << 20
CHUNK = 1 << 18
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # zlib's window bits for a gzip wrapper


def _record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "about:blank")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"] if revisit else []
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds payload (null html: empty), digest and keeper: the largest page_id of the equal payloads, null where it has no twin or is short.

    Copies are counted before they meet; the join back is one that Spark can split at a hot digest, as both its sides are
    dealt for it alone.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long_ones = rows.filter(F.octet_length("payload") >= min_bytes)
    groups = long_ones.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    groups = groups.select(F.col("digest").alias("d"), "keeper").repartition("keeper")
    return rows.join(groups, (rows.digest == groups.d) & (F.octet_length("payload") >= min_bytes), "left").drop("d")


def write_monolithic(records: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the planned records as archives of one gzip stream each; returns (archive, records, bytes), already computed."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        rows = ((r["page_id"], r["url"], r["payload"], r["digest"], r["keeper"]) for b in batches for at in range(0, b.num_rows, 256) for r in b.slice(at, 256).to_pylist())
        here, k, pending = TaskContext.get().partitionId(), 0, next(rows, None)
        while pending is not None:
            count = 0

            def fill(out):
                nonlocal pending, count
                z, size = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0
                while pending is not None and (not count or size < archive_bytes):
                    page, url, text, digest, keeper = pending
                    data = _record(page, url, text.encode(), digest, keeper, keeper is not None and page != keeper)
                    out.write(z.compress(data))
                    count, size, pending = count + 1, size + len(data), next(rows, None)
                out.write(z.flush())

            name = f"part-{here:06d}-{k:04d}.warc.gz"
            put_whole(fs, f"{root}/{name}", fill)
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [count], "bytes": [fs.get_file_info(f"{root}/{name}").size]})
            k += 1

    return written(mapped(records, run, "archive string, records long, bytes long"), "warc-manifest")


def inflate(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The uncompressed stream in bounded pieces, of a file of one gzip member or many."""
    z = zlib.decompressobj(GZIP)
    while data := read(CHUNK):
        while data:
            if z.eof:
                z = zlib.decompressobj(GZIP)
            yield z.decompress(data, CHUNK)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, CHUNK)
            data = z.unused_data
    if not z.eof:
        raise EOFError("the gzip stream ends early")


class Records:
    """Walks an uncompressed WARC stream record by record without holding one: head, then pieces of the block and its end."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.kept = pieces, b""

    def heads(self) -> Iterator[tuple[bytes, int]]:
        while self._until(b"\r\n\r\n"):
            head, _, self.kept = self.kept.partition(b"\r\n\r\n")
            head = head.lstrip(b"\r\n")
            fields = dict(line.lower().split(b":", 1) for line in head.split(b"\r\n")[1:])
            yield head + b"\r\n\r\n", int(fields[b"content-length"])

    def _until(self, mark: bytes) -> bool:
        while mark not in self.kept:
            piece = next(self.pieces, None)
            if piece is None:
                if self.kept.strip():
                    raise EOFError("a WARC record ends early")
                return False
            self.kept += piece
        return True

    def block(self, length: int) -> Iterator[bytes]:
        left = length + 4
        while left:
            if not self.kept:
                self.kept = next(self.pieces, None)
                if self.kept is None:
                    raise EOFError("a WARC record ends early")
            piece, self.kept = self.kept[:left], self.kept[left:]
            left -= len(piece)
            yield piece


def normalise_file(source: str, target: str, *, remove: bool = False) -> list[tuple[int, int]]:
    """Rewrites one archive with a gzip member a record and a sidecar `target + .idx` of `offset length` lines; returns them."""
    fs, path = filesystem(source)
    to, place = filesystem(target)
    from pyarrow import fs as pafs

    if to.get_file_info(place + ".idx").type == pafs.FileType.NotFound:
        index: list[tuple[int, int]] = []

        def rewrite(out):
            at = 0
            with fs.open_input_stream(path, compression=None) as data:
                records = Records(inflate(data.read))
                for head, length in records.heads():
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                    size = out.write(z.compress(head))
                    for piece in records.block(length):
                        size += out.write(z.compress(piece))
                    size += out.write(z.flush())
                    index.append((at, size))
                    at += size

        put_whole(to, place, rewrite)
        put_whole(to, place + ".idx", lambda out: out.write("".join(f"{a} {n}\n" for a, n in index).encode()))
    if remove:
        drop(fs, path)
    return read_index(target)


def read_index(archive: str) -> list[tuple[int, int]]:
    fs, path = filesystem(archive)
    with fs.open_input_stream(path + ".idx", compression=None) as f:
        return [tuple(map(int, line.split())) for line in f.read().decode().splitlines()]


def normalise(spark: SparkSession, archives: DataFrame, folder: str, *, range_bytes: int = RANGE_BYTES, remove: bool = False) -> DataFrame:
    """Normalises every archive (column archive) into folder; returns (archive, first, last, bytes): runs of members for read tasks."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{folder}/{os.path.basename(source)}"
                index = normalise_file(source, target, remove=remove)
                first, size = 0, 0
                for k, (_, n) in enumerate(index):
                    size += n
                    if size >= range_bytes or k == len(index) - 1:
                        yield pa.RecordBatch.from_pydict({"archive": [target], "first": [first], "last": [k], "bytes": [size]})
                        first, size = k + 1, 0

    n = max(1, archives.count())
    return written(mapped(archives.select("archive").repartition(min(n, 10_000), "archive"), run, "archive string, first long, last long, bytes long"), "warc-ranges")


def _parse(member: bytes) -> dict:
    head, _, rest = zlib.decompress(member, GZIP).partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in head.decode().split("\r\n")[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    number = lambda x: None if x is None or x == "<urn:x-page:None>" else int(x[12:-1])
    length = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['warc-record-id']} does not hold its payload")
    return {
        "page_id": number(fields["warc-record-id"]), "payload_bytes": length, "payload_digest": digest, "record_type": fields["warc-type"],
        "refers_to": number(fields.get("warc-refers-to")), "url": fields["warc-target-uri"], "payload": payload if fields["warc-type"] == "response" else None,
    }


def read_members(ranges: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """The records of the runs of members: page_id, payload_bytes, payload_digest, record_type, refers_to, url and the payload (null for a revisit).

    Digests of response payloads are computed again from what is read.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    schema += ", payload binary" if with_payload else ""

    def run(batches) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        kinds = kinds.append(pa.field("payload", pa.binary())) if with_payload else kinds
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = filesystem(r["archive"])
                members = read_index(r["archive"])[r["first"] : r["last"] + 1]
                with fs.open_input_file(path) as f:
                    f.seek(members[0][0])
                    rows = []
                    for _, n in members:
                        rows.append(_parse(f.read(n)))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, kinds)

    n = max(1, ranges.count())
    return mapped(ranges.select("archive", "first", "last").repartition(min(n, 100_000)), run, schema)


def archive_pages(pages: DataFrame, *, min_bytes: int = MIN_REVISIT_BYTES, with_payload: bool = False) -> DataFrame:
    """Writes a record per page, normalises the archives and reads them back.

    pages has page_id, url, html; null html is an empty payload, a null url becomes about:blank, a null page_id comes back
    null; rows that repeat a page_id are records of their own (all rows with a group's largest page_id are responses); other
    columns are ignored; an empty table gives no rows.  The files stay in the shared folder.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    manifest = write_monolithic(plan_records(pages, min_bytes), f"{folder}/whole")
    ranges = normalise(spark, manifest, f"{folder}/members", remove=True)
    return read_members(ranges, with_payload=with_payload)
