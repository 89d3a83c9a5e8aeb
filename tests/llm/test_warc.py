"""WARC archives: exact round trip, revisits, and records that are broken on purpose."""

import hashlib
import io
import struct

import zstandard
from pyspark.sql import functions as F
from weekwise.llm import warc
from weekwise.llm.registry import QUERIES, SQL


def plain(pages):
    groups = {}
    for i, _, h in pages:
        if len((h or "").encode()) >= 1000:
            groups.setdefault(h, []).append(i)
    out = []
    for i, _, h in pages:
        raw = (h or "").encode()
        known = [x for x in groups.get(h, []) if x is not None]
        other = max(known) if known and (i is None or i < max(known)) else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if other is None else "revisit", other))
    return sorted(out, key=str)


def test_round_trip(spark):
    long, cut = "é <p>" * 400, "a" * 999
    pages = [(1, "http://a/é b\r\nX: y", long), (2, None, long), (3, "", None), (4, "u", ""), (5, "u", cut), (6, "u", cut), (-7, "u", long), (None, "u", long),
             (8, "u", "x" * 3_000_000), (9, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 90), (9, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 90), (None, "u", "once " * 300)]
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id bigint, url string, html string, digest string, leader int")
    rows = warc.round_trip(spark, frame).withColumn("other", warc.page_of(F.col("refers_to_id"))).collect()
    assert all(r.error is None for r in rows) and len(rows) == len(pages)
    stored = {r.payload.decode() for r in rows if r.record_type == "response"}
    assert stored == {h or "" for _, _, h in pages}
    got = [(r.payload_bytes, r.payload_digest, r.record_type, r.other) for r in rows]
    assert sorted(map(str, got)) == sorted(str(x[1:]) for x in plain(pages))
    assert warc.round_trip(spark, frame.limit(0)).count() == 0


def test_record_ids_carry_the_page(spark):
    ids = [0, 1, -1, 1 << 62, -(1 << 63), None]
    frame = spark.createDataFrame([(warc._urn(i, "0" * 40),) for i in ids], "urn string")
    assert [r[0] for r in frame.select(warc.page_of(F.col("urn"))).collect()] == ids


def archive(records, dictionary=b"", packed=False):
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(dict_data=known)
    inner = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
    head = struct.pack("<II", warc.DICTIONARY_FRAME, len(inner)) + inner if dictionary else b""
    return head + b"".join(packer.compress(r) for r in records)


def read(data):
    return [warc.parse(raw) if not error else {"error": error} for raw, error in warc.frames(io.BytesIO(data).read, 100)]


def test_reader_validates():
    digest = hashlib.sha1(b"hello").hexdigest()
    good = warc.record(1, "u", b"hello", digest, None, "2020-01-01T00:00:00Z")
    words = [f"<p>word{i} number {i * 7919 % 1000}</p>".encode() * 3 for i in range(2000)]
    dictionary = zstandard.train_dictionary(4096, words).as_bytes()
    for packed in (False, True):
        assert [r["payload"] for r in read(archive([good, good], dictionary, packed))] == [b"hello"] * 2
    assert read(archive([good]))[0]["payload_digest"] == digest and read(b"") == []
    bad = {
        "length of the block": good[:-1], "no record header": good.replace(b"WARC/1.1", b"WARK/1.1"), "missing warc-date": good.replace(b"WARC-Date", b"WARC-Data"),
        "digest of the payload": good.replace(b"hello", b"jello"), "length of the payload": good.replace(b"Length: 5", b"Length: 4"), "bad header line": good.replace(b"WARC-Type:", b"WARC-Type"),
    }
    for error, raw in bad.items():
        assert read(archive([raw, good]))[0]["error"] == error and read(archive([raw, good]))[1]["error"] is None
    assert read(archive([good])[:-3])[0]["error"] == "frame cut short"
    assert read(archive([good], dictionary)[:50])[0]["error"] == "dictionary cut short"
    assert read(archive([good]) + b"junk junk junk")[1]["error"].startswith("broken frame")


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, QUERIES["op9_warc_round_trip"](spark, sf).collect()), key=str) == plain(pages)
    assert "op9_warc_round_trip" in SQL
