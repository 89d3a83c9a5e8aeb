"""Benchmark decontamination as a prefix-filtered set join.

Every window of an item is a set of positioned words that a document must contain whole, so one *necessary* word per
window suffices as its prefix: the rarest, by counts over all documents. Documents emit only words that pass a Bloom filter of
fixed size, with their neighbours; the join on the word, the bounds on its position and the comparison of the whole window follow.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._common import LOWER, as_bytes, map_batches, shared_table, slices

FILTER_BITS = 23  # 1 MB of bits on every task, whatever the size of the benchmark; more false hits only cost work
OTHER = bytes(b if b >= 128 or chr(b).isdigit() or "a" <= chr(b) <= "z" else 32 for b in range(256))
CHANGE = LOWER.translate(OTHER)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(CHANGE).split()


def item_windows(items: DataFrame, size: int, item_id: str, text: str) -> DataFrame:
    """(item, window): distinct windows of ``size`` words; an item of fewer words, but not none, is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                ids, windows = [], []
                for i, x in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                    words = [w.decode() for w in words_of(x)]
                    for k in range(max(1, len(words) - size + 1) if words else 0):
                        ids.append(i)
                        windows.append(words[k : k + size])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array(windows, pa.list_(pa.string()))], ["item", "window"]
                )

    rows = items.select(items[item_id].cast("string").alias("item"), items[text].alias("text"))
    return map_batches(rows, run, "item STRING, window ARRAY<STRING>").distinct()


def bloom(words: DataFrame, spark_column: str = "word") -> np.ndarray:
    """A bitmap of 2**FILTER_BITS bits over the hashes of the words, built by an aggregate: its size never depends on the rows."""
    bit = F.pmod(F.xxhash64(spark_column), F.lit(1 << FILTER_BITS))
    parts = words.select(bit.alias("b")).groupBy(F.shiftright("b", 5).alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(b & 31 AS INT))")).alias("bits")
    ).collect()
    out = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    for r in parts:
        out[r.i] = r.bits
    return out


def _passes(bits: np.ndarray, word: bytes) -> bool:
    b = xxhash.xxh64_intdigest(word, 42) & (1 << FILTER_BITS) - 1
    return bool(bits[b >> 5] >> (b & 31) & 1)


def word_counts(docs: DataFrame, bits: np.ndarray, text: str) -> DataFrame:
    """(word, n): occurrences over all documents of the words that pass the filter, summed in the task first."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = Counter(), {}
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                for word, n in Counter(w for x in as_bytes(part.column(0)) for w in words_of(x)).items():
                    hit = known.get(word)
                    if hit is None:
                        if len(known) > 500_000:
                            known.clear()
                        hit = known[word] = _passes(shared.value, word)
                    if hit:
                        total[word] += n
                if len(total) > 100_000:
                    yield _counts(total)
                    total.clear()
        yield _counts(total)

    rows = map_batches(docs.select(docs[text].alias("text")), run, "word STRING, n BIGINT")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _counts(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"]
    )


def prefix_words(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, at, window): for every distinct window its rarest word, with its place; ties go to the smaller word, then place."""
    distinct = windows.select("window").distinct()
    placed = distinct.select("window", F.posexplode("window").alias("at", "word"))
    ranked = placed.join(counts, "word", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("rarest")
    )
    return ranked.select(F.col("rarest.word").alias("word"), F.col("rarest.at").alias("at"), "window")


def candidates(docs: DataFrame, bits: np.ndarray, size: int, doc_id: str, text: str) -> DataFrame:
    """One row per document: number of words, and for each word that passes the filter its place and the words around it."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bool] = {}
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                counts, found = [], []
                for x in as_bytes(part.column(1)):
                    words = words_of(x)
                    hot = set()
                    for w in set(words):
                        hit = known.get(w)
                        if hit is None:
                            if len(known) > 500_000:
                                known.clear()
                            hit = known[w] = _passes(shared.value, w)
                        if hit:
                            hot.add(w)
                    counts.append(len(words))
                    found.append([
                        {"word": w.decode(), "place": i, "left": min(i, size - 1),
                         "around": [v.decode() for v in words[max(0, i - size + 1) : i + size]]}
                        for i, w in enumerate(words) if w in hot
                    ] if hot else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(counts, pa.int64()), pa.array(found, FOUND)], ["doc_id", "print", "n_words", "found"]
                )

    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("print"))
    return map_batches(
        rows, run, "doc_id BIGINT, print BIGINT, n_words BIGINT, found ARRAY<STRUCT<word: STRING, place: INT, left: INT, around: ARRAY<STRING>>>"
    )


FOUND = pa.list_(pa.struct([("word", pa.string()), ("place", pa.int32()), ("left", pa.int32()), ("around", pa.list_(pa.string()))]))


def contamination(
    docs: DataFrame, items: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per row of ``docs``: n_words, n_hit (words inside an occurrence of an item window), items (ids as sorted strings).

    ``print`` is Spark's xxhash64 of the text; with the id it finds the row again.
    NULL and empty texts and items have no words and no windows. Repeated rows stay, each with its own counts; rows of items
    with the same id add up to one item. Other columns are not read. An empty benchmark hits nothing.
    """
    windows = shared_table(item_windows(items, size, item_id, item_text), "windows")
    counts = word_counts(docs, bloom(windows.select(F.explode("window").alias("word"))), text)
    prefixes = shared_table(prefix_words(windows, counts), "prefixes")
    # the row number is fixed by writing it: repeated rows of one document stay apart
    rows = shared_table(
        candidates(docs, bloom(prefixes), size, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "candidates"
    )
    found = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    start = F.col("left") - F.col("at") + 1
    length = F.size("window")
    hits = (
        found.join(prefixes, "word")
        .where((start >= 1) & (start + length - 1 <= F.size("around")))
        .where(F.slice("around", start, length) == F.col("window"))
        .select("row", (F.col("place") - F.col("at")).alias("start"), length.alias("length"), "window")
        .distinct()
    )
    words = hits.groupBy("row").agg(F.collect_set(F.struct("start", "length")).alias("spans")).select(
        "row", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))).alias("n_hit")
    )
    owners = (
        hits.select("row", "window").distinct().join(windows, "window").groupBy("row").agg(F.collect_set("item").alias("items"))
    )
    return (
        rows.select("row", "doc_id", "print", "n_words").join(words, "row", "left").join(owners, "row", "left")
        .select(
            "doc_id", "print", "n_words", F.coalesce(F.col("n_hit").cast("bigint"), F.lit(0).cast("bigint")).alias("n_hit"),
            F.array_sort(F.coalesce("items", F.array().cast("array<string>"))).alias("items"),
        )
    )


def clean_rows(docs: DataFrame, items: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a window of an item."""
    hit = contamination(docs, items, size, doc_id, text).where("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("print").alias("__print"))
    return docs.join(hit, docs[doc_id].cast("bigint").eqNullSafe(hit["__id"]) & (F.xxhash64(docs[text]) == hit["__print"]), "left_anti")
