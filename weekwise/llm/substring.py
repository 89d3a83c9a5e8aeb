"""Repeated word windows by level-wise doubling.

Level by level the window length doubles, a quarter of the target, then half, then the target. A window repeated at one length alone
is a candidate at the next; whatever is found once leaves the search with everything longer around it. At the first level windows are picked where
every long window has one (see ``_repeats``), at the second one row stands for a run of neighbouring windows around a
core of half the length, and only runs that share a core but differ elsewhere are taken apart into single windows at the last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import BYTE_VALUE, as_bytes, map_slices, mix, prefix_hash, shared_table, span_hash, word_spans
from ._repeats import Blocks, anchor_runs, bit_filter, covered, gram_keys, offset_blocks, passes

SLICE_BYTES = 1 << 20  # text that is hashed at a time, at least a whole document
BLOCKS = "doc_id BIGINT, print BIGINT, start INT, starts INT, core BIGINT, variant BIGINT"


def _slice(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Texts, first word and end of the words of each, and prefix hashes over the words of all."""
    texts = as_bytes(batch.column(2))
    data = np.frombuffer(b" ".join(texts), np.uint8)
    if not len(data):
        none = np.zeros(len(texts), np.int64)
        return texts, none, none, np.zeros(1, np.uint64)
    first, last = word_spans(data)
    word = span_hash(prefix_hash(BYTE_VALUE[data]), first, last)
    ends = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts]))
    return texts, np.concatenate([[0], ends[:-1]]), ends, prefix_hash(word | np.uint64(1))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _levels(window: int) -> tuple[int, int]:
    """Lengths of the first level and of the runs whose core has the second level's length."""
    return -(-window // 4), window - -(-window // 2) + 1


def _first_level(rows: DataFrame, window: int) -> DataFrame:
    """(key, n): windows of the first length that are found twice or more."""
    gram, _ = _levels(window)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, begins, ends, prefix = _slice(batch)
        keys, n = np.unique(gram_keys(prefix, anchor_runs(prefix, begins, ends, gram, window), gram), return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(keys), pa.array(n)], ["key", "n"])

    return map_slices(rows, run, "key BIGINT, n BIGINT", text=2, limit=SLICE_BYTES).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def _candidates(prefix: np.ndarray, begins: np.ndarray, ends: np.ndarray, window: int, bits: np.ndarray) -> Blocks:
    gram, grid = _levels(window)
    runs = anchor_runs(prefix, begins, ends, gram, window)
    seen = passes(bits, gram_keys(prefix, runs, gram))
    return offset_blocks(prefix, type(runs)(*(x[seen] for x in runs)), gram, window, grid)


def _spot(core: np.ndarray, variant: np.ndarray, doc_id: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(mix(core ^ mix(variant)) + mix(doc_id.view(np.uint64)) * np.uint64(3) + start.astype(np.uint64))


def earliest(rows: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of window starts, and per (core, variant) the smallest doc_id of each start (one for all: a single entry)."""
    spark = rows.sparkSession
    bits = spark.sparkContext.broadcast(bit_filter(_first_level(rows, window)))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, begins, ends, prefix = _slice(batch)
        b = _candidates(prefix, begins, ends, window, bits.value)
        doc = pa.array(b.doc)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(doc), batch.column(1).take(doc), pa.array((b.start - begins[b.doc]).astype(np.int32)),
             pa.array(b.starts.astype(np.int32)), _signed(b.core), _signed(b.variant)],
            ["doc_id", "print", "start", "starts", "core", "variant"],
        )

    blocks = shared_table(map_slices(rows, find, BLOCKS, text=2, limit=SLICE_BYTES), "blocks")
    variants = blocks.groupBy("core", "variant").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("low"), F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "start")).alias("spot")
    )
    groups = variants.groupBy("core").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    known = shared_table(variants.join(groups, "core"), "variants")

    mixed = known.where("kinds > 1")
    spots = mixed.select("core", "variant", F.col("spot.doc_id").alias("doc_id"), F.col("spot.start").alias("start"))

    def named(batches):
        for b in batches:
            c = [b.column(k).to_numpy() for k in range(4)]
            yield pa.RecordBatch.from_arrays([_signed(_spot(c[0].view(np.uint64), c[1].view(np.uint64), c[2], c[3]))], ["key"])

    wanted = spark.sparkContext.broadcast(bit_filter(spots.mapInArrow(named, "key BIGINT")))

    def take_apart(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, begins, ends, prefix = _slice(batch)
        b = _candidates(prefix, begins, ends, window, bits.value)
        ids = batch.column(0).fill_null(0).to_numpy().astype(np.int64)
        chosen = np.flatnonzero(passes(wanted.value, _spot(b.core, b.variant, ids[b.doc], b.start - begins[b.doc])))
        many = b.starts[chosen]
        offsets = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat(b.start[chosen] - offsets[:-1], many) + np.arange(offsets[-1])
        hashes = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _signed(span_hash(prefix, at, at + window)))
        return pa.RecordBatch.from_arrays([_signed(b.core[chosen]), _signed(b.variant[chosen]), hashes], ["core", "variant", "hashes"])

    # the filter may let a block pass twice: one of a variant's is enough
    pieces = map_slices(rows, take_apart, "core BIGINT, variant BIGINT, hashes ARRAY<BIGINT>", text=2, limit=SLICE_BYTES).dropDuplicates(["core", "variant"])
    windows = shared_table(
        pieces.join(mixed.select("core", "variant", "low"), ["core", "variant"]).select("core", "variant", "low", F.posexplode("hashes").alias("at", "hash")), "windows"
    )
    lows = windows.groupBy("hash").agg(F.min("low").alias("lowest"))
    apart = windows.join(lows, "hash").groupBy("core", "variant").agg(F.array_sort(F.collect_list(F.struct("at", "lowest"))).alias("starts_low"))
    alone = known.where("kinds = 1").select("core", "variant", F.array("low").alias("lows"))
    return blocks, alone.union(apart.select("core", "variant", F.col("starts_low.lowest").alias("lows")))


def remove_later(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts in a row with a smaller doc_id.

    One row per input row: doc_id, n_words, n_removed, kept (the words left, joined by one space). NULL is an empty text. Repeated rows have the same
    id, so none is later than the other, and both are judged alike. A row with a NULL id is neither smaller nor larger than
    any: it keeps its words and takes none from others. ``window`` must be 4 or more.
    """
    if window < 4:
        raise ValueError("window must be 4 or more")
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), F.xxhash64(docs[text]).alias("print"), docs[text].alias("text"))
    blocks, lows = earliest(rows, window)
    late = (
        blocks.join(lows, ["core", "variant"])
        .withColumn("lows", F.when(F.size("lows") == 1, F.array_repeat(F.col("lows")[0], F.col("starts"))).otherwise(F.col("lows")))
        .select("doc_id", "print", "start", F.filter(F.transform("lows", lambda low, i: F.when(low < F.col("doc_id"), i)), lambda i: i.isNotNull()).alias("late"))
        .where(F.size("late") > 0)
        .select("doc_id", "print", F.transform("late", lambda i: i + F.col("start")).alias("late"))
        .groupBy("doc_id", "print").agg(F.flatten(F.collect_list("late")).alias("late"))
        .select(F.col("doc_id").alias("late_id"), F.col("print").alias("late_print"), "late")
    )
    joined = rows.join(late, F.col("doc_id").eqNullSafe(F.col("late_id")) & (F.col("print") == F.col("late_print")), "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, gone, kept = [], [], []
        for raw, starts in zip(as_bytes(batch.column(1)), batch.column(2), strict=True):
            words = raw.split()
            sizes.append(len(words))
            if starts.is_valid:
                at = starts.values.to_numpy()
                out = covered(len(words), at, at, window)
                gone.append(int(out.sum()))
                words = [w for w, g in zip(words, out.tolist(), strict=True) if not g]
            else:
                gone.append(0)
            kept.append(b" ".join(words))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )

    return map_slices(joined.select("doc_id", "text", "late"), run, "doc_id BIGINT, n_words BIGINT, n_removed BIGINT, kept STRING")
