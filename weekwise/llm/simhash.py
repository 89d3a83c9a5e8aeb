"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most ``radius`` bits agree in at least two of ``radius + 2`` blocks, so each is filed under every pair of
blocks. A group of fingerprints is stored as 64 bit planes (bit i of all members side by side); one XOR and a carry-save
step per plane then advance the distances of 64 members at once, and columns whose members have all left the radius are dropped on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._common import LOWER, as_bytes, map_slices, shared_table

PACK = 512  # small groups are compared together up to so many fingerprints: an extra link found so is a link all the same
CHUNK = 16_384  # a larger group is split, and its chunks meet two by two
QUERIES = 256
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, size: int = 3) -> int:
    """A bit is 1 if set in over half of the XXH64 values (seed 42) of the shingles of ``size`` words, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    n = max(1, len(words) - size + 1)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    digest = xxhash.xxh64_intdigest
    stops = ends[size - 1 :] if len(words) >= size else ends[-1:]
    values = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = values[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print, fp): fingerprint of every whole text as a signed 64-bit number; NULL and empty texts have 0.

    ``print`` is Spark's xxhash64 of the text; with the id it finds the row again.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(x) for x in as_bytes(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values)], ["doc_id", "print", "fp"])

    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("print"))
    return map_slices(rows, run, "doc_id BIGINT, print BIGINT, fp BIGINT")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row i holds bit i of all values, 64 values in a word; the last word is padded by repeating the first value."""
    padded = np.concatenate([values, np.repeat(values[:1], -len(values) % 64)])
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(sliced: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Bits (queries x words): members within ``radius`` of each query, by vertical carry-save counters.

    The counters hold up to 2**k - 1; a carry out of the top marks the member as gone. A column of words is
    abandoned once all its members are gone for all queries.
    """
    width = max(1, radius.bit_length())
    keep = np.arange(sliced.shape[1])
    gone = np.zeros((len(queries), len(keep)), np.uint64)
    counter = [np.zeros_like(gone) for _ in range(width)]
    for bit in range(64):
        flip = np.where(queries >> np.uint64(bit) & np.uint64(1), ALL, np.uint64(0))[:, None]
        carry = sliced[bit][keep][None, :] ^ flip
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        gone |= carry
        if bit % 8 == 7 and len(keep) > 8:
            alive = (gone != ALL).any(0)
            if not alive.all():
                keep, gone = keep[alive], gone[:, alive]
                counter = [c[:, alive] for c in counter]
                if not len(keep):
                    break
    # counts up to the counters' top are exact: take out those above the radius
    above, equal = np.zeros_like(gone), np.full_like(gone, ALL)
    for k in reversed(range(width)):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            above |= equal & counter[k]
            equal &= ~counter[k]
    out = np.zeros((len(queries), sliced.shape[1]), np.uint64)
    out[:, keep] = ~(gone | above)
    return out


def links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest (member, root) over distinct values that connects exactly those linked by steps of ``radius`` bits or fewer."""
    n, label = len(values), np.arange(len(values))
    sliced = planes(values)
    for start in range(0, n, QUERIES):
        near = within(sliced, values[start : start + QUERIES], radius)
        hits = np.bitwise_count(near).sum(1) > 1
        for q in np.flatnonzero(hits):
            found = np.flatnonzero(np.unpackbits(near[q].view(np.uint8), bitorder="little")[:n])
            roots = label[found]
            low = roots.min()
            others = np.unique(roots[roots != low])
            if len(others) == 1:
                label[label == others[0]] = low
            elif len(others):
                label[np.isin(label, others)] = low
    moved = np.flatnonzero(label != np.arange(n))
    return values[moved], values[label[moved]]


def block_pairs(radius: int) -> list[int]:
    """Masks of every pair out of ``radius + 2`` nearly equal blocks of the 64 bits."""
    edges = np.linspace(0, 64, radius + 3).astype(int)
    blocks = [(1 << int(b)) - (1 << int(a)) for a, b in zip(edges, edges[1:], strict=False)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_pairs(values: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) over distinct ``fp``: edges that connect exactly the fingerprints within reach; never all pairs of a group.

    Keys that only one fingerprint has go before any row is sorted. Groups over CHUNK members are cut by a hash and every
    two chunks meet in a group of their own, so no task holds more than two chunks of one group.
    """
    keyed = values.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in block_pairs(radius)])).alias("pair", "key"))
    sizes = keyed.groupBy("pair", "key").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    grouped = (
        keyed.join(sizes, ["pair", "key"])
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select("pair", "key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "fp")
    )
    group = ["pair", "key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            a, b = links(np.unique(np.concatenate(held)).view(np.uint64), radius)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        open_group, waiting = None, []
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            fp = batch.column(4).to_numpy()
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            for start, end in zip([0, *new], [*new, len(fp)], strict=True):
                key = tuple(int(c[start]) for c in cols)
                if key != open_group:
                    if waiting:
                        whole = np.concatenate(waiting)
                        if held and sum(map(len, held)) + len(whole) > PACK:
                            yield flush()
                        held.append(whole)
                    open_group, waiting = key, []
                waiting.append(fp[start:end])
        if waiting:
            held.append(np.concatenate(waiting))
        if held:
            yield flush()

    return grouped.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a BIGINT, b BIGINT").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every vertex of the edges (a, b): root is the smallest vertex of its component.

    Each round every vertex hands the smallest neighbour to its larger neighbours (large star), then to its smaller ones (small
    star); both keep components and shorten paths, and rounds end when nothing changes. Rounds are written to the shared folder.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = shared_table(both, "star")
    while True:
        out = state.union(state.select("b", "a"))
        low = out.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = out.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.*").where("a <> b").distinct()
        following = shared_table(small, "star")
        if following.exceptAll(state).isEmpty() and state.exceptAll(following).isEmpty():
            return following.withColumnRenamed("b", "root")
        state = following


def near_duplicates(docs: DataFrame, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print, fp, root, component_id): fingerprint and the smallest doc_id reachable over links of ``radius`` bits or fewer.

    NULL and empty texts have fingerprint 0 and link like any other. Copies share a fingerprint and are one vertex; repeated rows stay. A NULL
    id takes part but never names a component (the component of NULL ids alone has NULL). ``root`` is the fingerprint that names the component.
    """
    prints = shared_table(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = linked_pairs(distinct, radius)
    roots = distinct.join(components(edges).withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = roots.join(roots.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "print", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the one with the smallest doc_id (NULL ids last).

    Rows that repeat both id and text of the one that stays are one document and leave one row.
    """
    found = near_duplicates(docs, radius, doc_id, text)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("b"))
    kept = best.select(F.col("b.doc_id").alias("__id"), F.col("b.print").alias("__print"))
    own, copy = docs[doc_id].cast("bigint"), F.xxhash64(docs[text])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), own.alias("own"), copy.alias("copy"))  # whatever the columns are called
    matched = rows.join(kept, rows["own"].eqNullSafe(kept["__id"]) & (rows["copy"] == kept["__print"]), "left_semi")
    return matched.dropDuplicates(["own", "copy"]).select("row.*")
