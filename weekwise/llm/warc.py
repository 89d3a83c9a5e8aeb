"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Tasks write archives of bounded size into the shared folder and report them; the list of reports, written as a table,
says which files count, so a repeated or lost attempt leaves at most a file that nobody reads. The reader decodes frame by frame
and checks versions, headers and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weekwise.session import shared_dir

from ._common import as_bytes, shared_table, slices

# fixed values of the formats
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

MIN_REVISIT = 1000  # payloads of fewer bytes are always stored
ARCHIVE_BYTES = 32 << 20  # a task begins a new archive once one has so many bytes
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 65_536  # bounds of what the dictionary is trained on
RECORDS = (
    "archive STRING, record_id STRING, record_type STRING, target_uri STRING, refers_to_id STRING, payload BINARY, "
    "payload_bytes BIGINT, payload_digest STRING, error STRING"
)


def train_dictionary(payloads: DataFrame, column: str) -> bytes:
    """A compression dictionary from at most SAMPLES payloads, SAMPLE_BYTES of each; empty if there is too little.

    About half of SAMPLES rows pass a filter on a hash of the row, so what tasks send does not grow with their number.
    """
    every = max(1, 2 * payloads.count() // SAMPLES)
    picked = payloads.where(F.pmod(F.xxhash64(*payloads.columns), F.lit(every)) == 0)
    rows = picked.select(F.substring(column, 1, SAMPLE_BYTES).alias("t")).where(F.length("t") > 0).limit(SAMPLES).collect()
    samples = [r.t.encode() for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) > 8 else b""
    except zstandard.ZstdError:
        return b""


PREFIX = 0x7765656B77694000  # first half of the ids of records that carry a page id in the second


def _urn(page_id: int | None, digest: str) -> str:
    if page_id is None:
        return uuid.uuid5(uuid.NAMESPACE_OID, digest).urn
    return uuid.UUID(int=PREFIX << 64 | page_id & (1 << 64) - 1).urn


def page_of(urn: Column) -> Column:
    """The page id that a record id carries, NULL if none."""
    digits = F.replace(F.substring(urn, 10, 36), F.lit("-"), F.lit(""))
    return F.when(F.substring(digits, 1, 16) == f"{PREFIX:016x}", F.conv(F.substring(digits, 17, 16), 16, -10).cast("bigint"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One response or revisit record. A revisit has the HTTP header alone, which still tells the full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_urn(page_id, digest)}>",
        f"WARC-Date: {date}", "Content-Type: application/http;msgtype=response",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), f"Content-Length: {len(block)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_urn(refers_to, digest)}>", f"WARC-Profile: {IDENTICAL}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, dictionary: bytes, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write (page_id, url, html, digest, refers_to) rows as archives; returns the table of (archive, records)."""
    folder = f"{shared_dir(pages.sparkSession)}/llm/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=6, dict_data=known, write_content_size=True)
        out, name, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                ids, urls, digests, refers = (part.column(i).to_pylist() for i in (0, 1, 3, 4))
                for page_id, url, payload, digest, refers_to in zip(ids, urls, as_bytes(part.column(2)), digests, refers, strict=True):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        out, size, count = files.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                        if dictionary:
                            out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                    frame = packer.compress(record(page_id, url, payload, digest, refers_to, date))
                    out.write(frame)
                    size, count = size + len(frame), count + 1
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        done.append((f"{folder}/{name}", count))
                        out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])

    rows = pages.select("page_id", "url", "html", "digest", "refers_to")
    return shared_table(rows.mapInArrow(run, "archive STRING, records BIGINT"), "warc-list")


def frames(read, chunk: int = 1 << 20) -> Iterator[tuple[bytes, str | None]]:
    """(decoded frame, error) for each frame of an archive; ``read(n)`` gives its next bytes. A broken frame ends the archive."""
    data = read(8)
    known = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_FRAME:
        want = struct.unpack("<I", data[4:])[0]
        raw = b""
        while len(raw) < want and (more := read(want - len(raw))):
            raw += more
        if len(raw) < want:
            yield b"", "dictionary cut short"
            return
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw)
        data = b""
    unpacker = zstandard.ZstdDecompressor(dict_data=known)
    while True:
        data = data or read(chunk)
        if not data:
            return
        frame, parts = unpacker.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                yield b"", f"broken frame: {e}"
                return
            if frame.eof:
                data = frame.unused_data
                break
            data = read(chunk)
            if not data:
                yield b"", "frame cut short"
                return
        yield b"".join(parts), None


def parse(raw: bytes) -> dict:
    """Fields of one record, or an error that says what is wrong with it."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", VERSION):
        return {"error": "no record header"}
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return {"error": "bad header line"}
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if missing := [x for x in REQUIRED if x not in fields]:
        return {"error": "missing " + ", ".join(missing)}
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        return {"error": "length of the block"}
    out = {
        "record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"),
        "refers_to_id": fields.get("warc-refers-to", "").strip("<>") or None, "error": None,
    }
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    lengths = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    kind, _, digest = fields.get("warc-payload-digest", "").partition(":")
    try:
        told = base64.b32decode(digest).hex() if kind == "sha1" else None
    except ValueError:
        return out | {"error": "digest cannot be read"}
    out |= {"payload_digest": told, "payload_bytes": lengths[0] if lengths else None}
    if out["record_type"] == "revisit":
        return out if out["refers_to_id"] else out | {"error": "revisit without the record it refers to"}
    if not gap or lengths and lengths[0] != len(payload):
        return out | {"error": "length of the payload"}
    found = hashlib.sha1(payload).hexdigest()
    if told is not None and told != found:
        return out | {"error": "digest of the payload"}
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": found}


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the files named in column ``archive``; a broken record has its ``error`` set and nothing is raised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in RECORDS.split(", ")]
        kinds = [pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string() for n in names]
        rows, held = [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                files, path = pafs.FileSystem.from_uri(archive)
                with files.open_input_stream(path, compression=None) as source:
                    for raw, error in frames(source.read):
                        found = {"error": error} if error else parse(raw)
                        if not with_payload:
                            found.pop("payload", None)
                        rows.append(found | {"archive": archive})
                        held += len(found.get("payload") or b"") + 200
                        if held > 4 << 20:
                            yield batch_of()
                            rows, held = [], 0
        if rows:
            yield batch_of()

    # one row per archive, and each an equal share of work: spread them over the cores
    spread = archives.select("archive").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism))
    return spread.mapInArrow(run, RECORDS)


def deduplicated(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to): of equal payloads of MIN_REVISIT bytes or more the largest page_id is stored.

    NULL html is an empty payload. A NULL page_id never names a group but may refer to it; rows that repeat the stored page_id are stored too.
    """
    rows = pages.select(
        pages[page_id].cast("bigint").alias("page_id"), pages[url].cast("string").alias("url"), F.coalesce(pages[html], F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    leaders = (
        rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    )
    other = F.coalesce(F.col("page_id") < F.col("leader"), F.col("page_id").isNull() & F.col("leader").isNotNull())
    # copies are many rows of one key: the skew split of the join spreads them
    return rows.join(leaders, "digest", "left").select("page_id", "url", "html", "digest", F.when(other, F.col("leader")).alias("refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages as archives, then read the archives back."""
    dictionary = train_dictionary(pages, "html")
    return read_archives(write_archives(deduplicated(pages), dictionary))
