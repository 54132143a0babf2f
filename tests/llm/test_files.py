"""WARC and media: exact round trips, odd rows, damaged members."""

import gzip
import hashlib
import os
import struct
import zlib

import pytest

from casemill.llm import media, warc
from casemill.llm.shared import filesystem, scratch

PAGES = "page_id long, url string, html string, digest string, keeper int, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1, "p") for i, u, h in rows], PAGES)


def test_warc_round_trip(spark):
    big = "é<b>" * 400
    rows = [(1, "http://a/\r\n b", big), (2, None, big), (5, "http://c", big), (3, "x", None), (4, "y", "short"), (6, "z", "short"), (None, "n", "WARC/1.1\r\n\r\n"), (7, "q", "u" * 999), (8, "q", "u" * 999), (9, "v", "w" * 3_000_000)]
    out = {r["page_id"]: r for r in warc.archive_pages(pages(spark, rows), with_payload=True).collect()}
    assert len(out) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert out[i]["payload_bytes"] == len(data) and out[i]["payload_digest"] == hashlib.sha1(data).hexdigest()
        assert out[i]["payload"] is None or bytes(out[i]["payload"]) == data
    assert [(out[i]["record_type"], out[i]["refers_to"]) for i in (1, 2, 5, 4, 7)] == [("revisit", 5), ("revisit", 5), ("response", None), ("response", None), ("response", None)]


def test_warc_repeated_ids_and_empty(spark):
    rows = warc.archive_pages(pages(spark, [(1, "a", "x" * 2000), (1, "a", "x" * 2000)])).collect()
    assert [r["record_type"] for r in rows] == ["response"] * 2
    assert warc.archive_pages(pages(spark, [])).collect() == []


def test_normaliser_reads_whole_streams_and_members(tmp_path):
    records = [warc._record(i, "http://x", bytes([65 + i]) * (i * 70_000), "d" * 40, None, False) for i in range(5)]
    whole, members = tmp_path / "a.warc.gz", tmp_path / "b.warc.gz"
    whole.write_bytes(gzip.compress(b"".join(records)))
    members.write_bytes(b"".join(map(gzip.compress, records)))
    for source in (whole, members):
        index = warc.normalise_file(str(source), f"{source}.out")
        data = (tmp_path / f"{source.name}.out").read_bytes()
        assert [gzip.decompress(data[a : a + n]) for a, n in index] == records
    whole.write_bytes(gzip.compress(b"".join(records))[:-200])
    with pytest.raises((EOFError, OSError)):
        warc.normalise_file(str(whole), f"{whole}.cut")


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 64, os.urandom(1000), bytes(200)])
def test_png_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and payload and media.decode_png(media.encode_png(payload, len(data))) == (payload, len(data))


def payload_of(text):
    data = (text or "").encode()
    return data + bytes(64 * max(1, -(-len(data) // 64)) - len(data))


def brute_media(doc_id, text):
    """What a row must hold, by an image made with zlib and struct alone."""
    n, payload = len((text or "").encode()), payload_of(text)
    rows = b"".join(b"\0" + payload[at : at + 64] for at in range(0, len(payload), 64))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(payload) // 64, 8, 0, 0, 0, 0)) + chunk(b"laNg", struct.pack(">Q", n)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")
    return {
        "doc_id": doc_id, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
        "media_bytes": len(png), "media_sha256": hashlib.sha256(png).hexdigest(),
    }


def brute_feature(payload):
    mean = sum(payload) / len(payload)
    dev = (sum((x - mean) ** 2 for x in payload) / len(payload)) ** 0.5
    bits = 0
    for k in range(64):
        part = payload[k * len(payload) // 64 : (k + 1) * len(payload) // 64]
        bits = bits << 1 | (sum(part) * len(payload) > sum(payload) * len(part))
    return f"{mean:.4f}:{dev:.4f}:{bits:016x}"


def test_media_rows(spark, odd, none):
    rows = media.media_columns(odd).collect()
    assert len(rows) == 10
    for r in rows:
        if r["doc_id"] in (1, 2):
            assert r["n_bytes"] == 0 and r["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest()
    fives = [r.asDict() for r in rows if r["doc_id"] == 5]
    assert fives[0] == fives[1]
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in rows:
        assert {k: r[k] for k in r.asDict() if k != "feature"} == brute_media(r["doc_id"], texts[r["doc_id"]])
        assert r["feature"] == brute_feature(payload_of(texts[r["doc_id"]]))
    assert media.media_columns(none).collect() == []


def test_a_damaged_member_leaves_the_others(spark, odd):
    folder = scratch(spark, "damaged")
    media.write_archives(odd.coalesce(1), folder)
    fs, root = filesystem(folder)
    name = next(f"{root}/{f}" for f in os.listdir(root) if f.endswith(".media"))
    data = bytearray(open(name, "rb").read())
    data[40] ^= 255
    open(name, "wb").write(bytes(data))
    rows = media.read_media(spark, folder, range_bytes=100).collect()
    assert len(rows) == 10 and sum(r["error"] is not None for r in rows) == 1
    with pytest.raises(Exception, match="checksum"):
        from pyspark.sql import functions as F

        media.describe(media.read_media(spark, folder)).filter(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.col("error")).cast("boolean"))).collect()
