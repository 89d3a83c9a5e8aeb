"""Helpers shared by the text operators: slices of bounded bytes, words, hashes and shared tables."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from weekwise.session import shared_dir

DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
LABELS = "doc_id BIGINT, quality INT, toxic INT"
PAGES = "page_id BIGINT, url STRING, html STRING"
CONVERSATIONS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
BENCHMARK = "item_id BIGINT, text STRING"

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


def shared_table(df: DataFrame, name: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back: lineage ends in files every executor sees."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text of a slice stays under ``limit`` bytes (a longer text is a slice of its own)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes.astype(np.int64)), 0
    while start < batch.num_rows:
        used = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, used + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def map_slices(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: int = 1, limit: int = 4 << 20,
) -> DataFrame:
    """Apply ``fn`` to slices of bounded bytes; column ``text`` is the one that is measured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
            batch = part = out = None  # or the batch would stay while the next one is read
            give_back()

    return map_batches(df, run, schema)


def give_back() -> None:
    """Hand memory that Arrow and the C library hold but do not use back to the system: a worker outlives its tasks, and others run beside it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose tasks leave no unused memory in their worker."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, NULL as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# a fixed random value per byte and an odd multiplier: prefix sums of value * B**i modulo 2**64 give the hash of
# any substring by one subtraction and one multiplication with the inverse power
_RNG = np.random.default_rng(20240229)
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(1 << 61, 1 << 62, dtype=np.uint64)) * 8 + 5 & (1 << 64) - 1
_POWERS: list[np.ndarray] = []


def _powers_of(base: int, n: int) -> np.ndarray:
    out, done = np.empty(n, np.uint64), 1
    out[0] = 1
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(pow(base, done, 1 << 64))
        done += k
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept between calls."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [_powers_of(BASE, size), _powers_of(pow(BASE, -1, 1 << 64), size)]
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums for ``span_hash``; one entry more than values."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for arrays of starts and ends."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in an array of bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
