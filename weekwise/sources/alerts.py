"""Alert documents: archives of XML -> one row per alert and info block."""

from __future__ import annotations

import gzip
import io
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weekwise.functions.text import clean_xml_text, decode_bytes
from weekwise.operators._util import col

# The parts of an alert document that are kept.
ALERT_FIELDS = ("identifier", "sender", "sent", "status", "msgType", "scope")
INFO_FIELDS = ("event", "urgency", "severity", "certainty", "onset", "expires", "headline", "description")

_INFO = ", ".join(f"{f}: STRING" for f in INFO_FIELDS)
ALERT_SCHEMA = (
    ", ".join(f"{f} STRING" for f in ALERT_FIELDS)
    + f", info ARRAY<STRUCT<{_INFO}, area: ARRAY<STRUCT<areaDesc: STRING>>>>"
)


def strip_namespaces(c: Column) -> Column:
    """Remove prefixes from element names, so that one schema fits every namespace spelling."""
    return F.regexp_replace(c, r"(</?)[A-Za-z_][\w.-]*:", "$1")


def flatten_alerts(df: DataFrame, xml: str = "xml", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row per info block with its areas joined by " | ".

    An alert without info blocks gives one row with blanks; text that is no alert gives none.
    ``info_pos`` numbers the blocks within their document.
    """
    doc = F.from_xml(clean_xml_text(strip_namespaces(col(xml))), F.lit(ALERT_SCHEMA), {"mode": "PERMISSIVE"})
    # the generator keeps the document parsed once; a plain projection would parse it for every field
    parsed = df.select(*map(col, keep), F.inline(F.array(doc)))
    known = F.coalesce(*ALERT_FIELDS).isNotNull() | F.col("info").isNotNull()
    blocks = parsed.where(known).select(
        *map(col, keep), *ALERT_FIELDS, F.posexplode_outer("info").alias("info_pos", "i")
    )

    def text(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c)), F.lit(""))

    areas = F.transform(F.coalesce(F.col("i.area"), F.array()), lambda a: F.trim(a["areaDesc"]))
    named = F.filter(areas, lambda a: a != "")
    return blocks.select(
        *map(col, keep), F.coalesce("info_pos", F.lit(0)).alias("info_pos"),
        *[text(f).alias(f) for f in ALERT_FIELDS], *[text(f"i.{f}").alias(f) for f in INFO_FIELDS],
        F.array_join(named, " | ").alias("areaDesc"),
    )


def _members(payload: bytes) -> Iterator[tuple[str, bytes, str | None]]:
    """Documents inside a tar/gzip payload of any depth, with ``outer::inner`` names.

    A member that cannot be read gives one row with its error; the rest of the archive goes on.
    """
    waiting = [("", payload)]
    while waiting:
        name, data = waiting.pop()
        try:
            while data[:2] == b"\x1f\x8b":
                data = gzip.decompress(data)
            if not tarfile.is_tarfile(io.BytesIO(data)):
                yield name, data, None
                continue
            found = []
            with tarfile.open(fileobj=io.BytesIO(data)) as archive:
                for member in archive:
                    handle = archive.extractfile(member) if member.isfile() else None
                    if handle is not None:
                        found.append((f"{name}::{member.name}" if name else member.name, handle.read()))
            waiting += reversed(found)
        except (OSError, EOFError, zlib.error, tarfile.TarError) as error:
            yield name, b"", f"{type(error).__name__}: {error}"


def unpack_archives(df: DataFrame, batch_bytes: int = 16 << 20) -> DataFrame:
    """``binaryFile`` rows -> ``(path, member, xml, error)``, one archive after the other in a task.

    The only step on raw bytes that Spark has no expression for; decoding is native again. Results leave in
    batches of about ``batch_bytes``; the memory of a task is bounded by the largest single archive, unpacked.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column(0)[i].as_py()
                for member, payload, error in _members(batch.column(1)[i].as_py() or b""):
                    rows.append({"path": path, "member": member, "payload": payload, "error": error})
                    size += len(payload)
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, MEMBERS)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, MEMBERS)

    raw = df.select("path", "content").mapInArrow(unpack, "path string, member string, payload binary, error string")
    return raw.select("path", "member", decode_bytes("payload").alias("xml"), "error")


MEMBERS = pa.schema([("path", pa.string()), ("member", pa.string()), ("payload", pa.binary()), ("error", pa.string())])
