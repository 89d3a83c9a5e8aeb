"""Text records by planned byte ranges: a Python data source whose partitions are ranges of files.

A small job looks at every range once and writes the plan: where its lines begin and end, whether it begins within quotes, how its file
is encoded and where the rows of the file start. The source then reads each range on its own, so title and header lines are left out
by their place and a quoted line break never cuts a record, wherever the ranges lie.
"""

from __future__ import annotations

import codecs
import csv
from collections.abc import Iterator, Sequence
from urllib.parse import quote as url_quote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weekwise.session import scratch_path

RANGE_BYTES = 128 << 20
BLOCK_BYTES = 4 << 20
PEEKS = 64  # files, or ranges of which only the ends are read, that one planning task opens on average
PACKED = (".gz", ".bz2", ".zst")  # streams that cannot be entered in the middle: one range each
TO_THE_END = 1 << 62
NOT_IN_CP1252 = [b"\x81", b"\x8d", b"\x8f", b"\x90", b"\x9d"]

_FACTS = "path string, start long, end long, odd boolean, utf8 boolean, cp1252 boolean, head binary, body long"


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return pafs.LocalFileSystem(), "/" + (rest if colon else uri).lstrip("/")
    return pafs.FileSystem.from_uri(url_quote(uri, safe=":/@"))


def _open(uri: str) -> pa.NativeFile:
    files, path = _place(uri)
    return files.open_input_stream(path, compression="detect") if path.endswith(PACKED) else files.open_input_file(path)


def _blocks(uri: str, start: int, end: int, block: int) -> Iterator[bytes]:
    """The bytes of a range in blocks of whole lines; a line longer than ``block`` is a block of its own."""
    with _open(uri) as f:
        if uri.endswith(PACKED):
            left = start
            while left and (gone := len(f.read(min(left, block)))):
                left -= gone
        else:
            f.seek(start)
        held, left = [], end - start
        while left > 0 and (data := f.read(min(block, left))):
            left -= len(data)
            cut = data.rfind(b"\n") + 1
            if cut:
                yield b"".join([*held, data[:cut]])
                held = []
            held.append(data[cut:])
        if any(held):
            yield b"".join(held)


def _line_start(f: pa.NativeFile, at: int, size: int) -> int:
    """The first position from ``at`` on where a line begins; the end of the file if there is none."""
    if at <= 0 or at >= size:
        return min(max(at, 0), size)
    f.seek(at - 1)
    done = at - 1
    while data := f.read(1 << 16):
        found = data.find(b"\n")
        if found >= 0:
            return done + found + 1
        done += len(data)
    return size


def _lines(block: bytes, quote: bytes) -> list[bytes]:
    """Lines with their ends; where quotes count, a line ends at a line feed only."""
    if not quote:
        return block.splitlines(keepends=True)
    *whole, last = block.split(b"\n")
    return [line + b"\n" for line in whole] + ([last] if last else [])


def _records(blocks: Iterator[bytes], start: int, end: int, quote: bytes, inside: bool) -> Iterator[list[bytes]]:
    """Records that begin in [start, end), with their line breaks; lines are joined while a quote is open.

    With ``inside`` the range begins within quotes: the lines up to the close of that record belong to the range before.
    """
    at, odd, skipping, held = start, inside, inside, []
    for block in blocks:
        found = []
        for line in _lines(block, quote):
            if at >= end and not held:
                yield found
                return
            at += len(line)
            odd ^= bool(quote) and line.count(quote) % 2 == 1
            if skipping:
                skipping = odd
                continue
            held.append(line)
            if not odd:
                found.append(b"".join(held))
                held = []
        yield found
    if held:
        yield [b"".join(held)]


def _head(uri: str, titles: int, quote: bytes, block: int) -> tuple[bytes | None, int]:
    """The record after ``titles`` records that are not blank, and the position after it."""
    at, seen = 0, 0
    for found in _records(_blocks(uri, 0, TO_THE_END, block), 0, TO_THE_END, quote, False):
        for record in found:
            at += len(record)
            if record.removeprefix(codecs.BOM_UTF8).strip(b" \r\n"):
                seen += 1
                if seen > titles:
                    return record, at
    return None, at


def _prober(titles: int, quote: bytes, guess: bool, block: int):
    def facts(uri: str, start: int, end: int, size: int) -> tuple:
        first, last = start, end
        if not uri.endswith(PACKED):
            with _open(uri) as f:
                first, last = _line_start(f, start, size), _line_start(f, end, size)
        odd, utf8, cp1252 = False, True, True
        if guess or quote:
            for data in _blocks(uri, first, last, block):
                odd ^= bool(quote) and bool(data.count(quote) & 1)
                if guess:
                    cp1252 = cp1252 and not any(b in data for b in NOT_IN_CP1252)
                    if utf8:
                        try:
                            data.decode("utf-8")
                        except UnicodeDecodeError:
                            utf8 = False
        head, body = _head(uri, titles, quote, block) if start == 0 else (None, None)
        return uri, first, last, odd, utf8, cp1252, head, body

    names = ["path", "start", "end", "odd", "utf8", "cp1252", "head", "body"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary(), pa.int64()]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [facts(*row.values()) for row in batch.to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return probe


def plan_ranges(
    spark: SparkSession, path: str | list[str], titles: int = 0, quote: str = "", encoding: str | None = None,
    range_bytes: int = RANGE_BYTES, block_bytes: int = BLOCK_BYTES,
) -> tuple[str, DataFrame]:
    """Write the plan of ranges for files, directories or patterns to the shared folder; gives its path and the plan.

    Without ``encoding`` each file is UTF-8 if all its bytes are, else Windows-1252 if all its bytes are defined there, else Latin-1; that
    and a ``quote`` (line breaks between quotes end no record) read every range once more. Otherwise only heads and ends are read.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    packed = F.regexp_like("path", F.lit(r"\.(gz|bz2|zst)$"))
    ranges = files.select(
        "path", F.explode(F.when(packed, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))).alias("start"),
        F.when(packed, F.lit(TO_THE_END)).otherwise(F.col("length")).alias("size"),
    ).select("path", "start", F.least(F.when(F.col("size") == TO_THE_END, F.col("size")).otherwise(F.col("start") + range_bytes), "size").alias("end"), "size")
    total, many = files.agg(F.sum("length"), F.count("*")).first()
    whole = encoding is None or quote
    tasks = 1 + (total or 0) // (range_bytes if whole else PEEKS * range_bytes) + many // PEEKS
    facts = ranges.repartition(tasks, "path", "start").mapInArrow(_prober(titles, quote.encode(), encoding is None, block_bytes), _FACTS)
    of_file, before = Window.partitionBy("path"), Window.partitionBy("path").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    guessed = F.when(F.min("utf8").over(of_file), "utf-8").when(F.min("cp1252").over(of_file), "cp1252").otherwise("latin-1")
    place = scratch_path(spark, "ranges")
    facts.select(
        "path", "start", "end", "head", F.max("body").over(of_file).alias("body"),
        (F.lit(encoding) if encoding else guessed).alias("encoding"),
        (F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1).alias("inside"),
    ).write.parquet(place)
    return place, spark.read.parquet(place)


class _Ranges(InputPartition):
    def __init__(self, ranges: list[tuple]):
        super().__init__(ranges)


class _RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.plan, self.quote = options["path"], options.get("quote", "").encode()
        self.range_bytes, self.block_bytes = int(options["range_bytes"]), int(options["block_bytes"])

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges in the order of files, small ones packed up to the size of a range."""
        files, root = _place(self.plan)
        table = pq.read_table(root, filesystem=files, columns=["path", "start", "end", "body", "encoding", "inside"])
        packs, size = [], self.range_bytes
        for row in table.sort_by([("path", "ascending"), ("start", "ascending")]).to_pylist():
            start, inside = max(row["start"], row["body"]), row["inside"] and row["start"] >= row["body"]
            if start >= row["end"]:
                continue
            bytes_ = min(row["end"] - start, self.range_bytes)
            if size + bytes_ > self.range_bytes:
                packs.append([])
                size = 0
            packs[-1].append((row["path"], start, row["end"], row["encoding"], inside))
            size += bytes_
        return [_Ranges(p) for p in packs or [[]]]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        for uri, start, end, encoding, inside in partition.value:
            blocks = _blocks(uri, start, TO_THE_END if self.quote else end, self.block_bytes)
            if self.quote:
                lists = ([r.decode(encoding).rstrip("\r\n") for r in found] for found in _records(blocks, start, end, self.quote, inside))
            else:
                lists = (b.decode(encoding).replace("\r\n", "\n").replace("\r", "\n").split("\n") for b in blocks)
            for records in lists:
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], ["record"])


class RecordSource(DataSource):
    """``spark.read.format("weekwise_records").load(plan)``: one string per record of the planned ranges."""

    @classmethod
    def name(cls) -> str:
        return "weekwise_records"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> DataSourceReader:
        return _RecordReader(self.options)


def read_records(
    spark: SparkSession, path: str | list[str], sep: str, quote: str, titles: int, encoding: str | None, multi_line: bool,
    range_bytes: int = RANGE_BYTES, block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, list[tuple[str, ...]]]:
    """Records after each file's header as a one-column table, and the distinct headers (at most 100), each a tuple of names."""
    cuts = quote if multi_line else ""
    place, plan = plan_ranges(spark, path, titles, cuts, encoding, range_bytes, block_bytes)
    heads = plan.where(F.col("head").isNotNull()).select("head", "encoding").distinct().limit(100).collect()
    headers = set()
    for r in heads:
        text = bytes(r["head"]).removeprefix(codecs.BOM_UTF8).decode(r["encoding"])
        (names,) = csv.reader([text.rstrip("\r\n")], delimiter=sep, quotechar=quote or None, quoting=csv.QUOTE_MINIMAL if quote else csv.QUOTE_NONE)
        headers.add(tuple(n.strip().strip(quote or None).strip() for n in names))
    spark.dataSource.register(RecordSource)
    reader = spark.read.format(RecordSource.name()).options(quote=cuts, range_bytes=str(range_bytes), block_bytes=str(block_bytes))
    return reader.load(place), sorted(headers)
