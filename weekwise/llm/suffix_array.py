"""Suffix arrays by two-stage sorting, and removal of repeated byte strings from a whole corpus.

Stage one sorts directly only the suffixes that are smaller than their successors; stage two scans the buckets once from left to right
and puts every other suffix at the next free place of its bucket when its successor is met. Common prefixes of neighbours then
show the repeated strings. On a corpus, suffixes meet only where a repeat is possible (see ``_repeats``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import BYTE_VALUE, as_bytes, map_batches, map_slices, mix, prefix_hash, shared_table, span_hash
from ._repeats import Blocks, anchor_runs, bit_filter, covered, gram_keys, offset_blocks, passes, runs_of

GRAM, GRID = 64, 128
SORT_BYTES = 1 << 19  # bytes of text that one suffix array is built over, at least a whole group
HOT_VARIANTS = 1_500  # groups of more variants are told apart by the hash of each whole window instead
SLICE_BYTES = 1 << 20  # text that is hashed at a time, at least a whole document
BLOCKS = "doc_id BIGINT, print BIGINT, start INT, starts INT, core BIGINT, variant BIGINT"


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of bytes in which 0 ends each part; the zeros count as different letters, ordered by position."""
    n = len(s)
    place = np.arange(n)
    rises, differs = np.append(s[1:] > s[:-1], True), np.append(s[1:] != s[:-1], True)
    turn = np.minimum.accumulate(np.where(differs, place, n - 1)[::-1])[::-1]
    small = rises[turn]  # smaller than its successor
    small[s == 0] = True
    counts = np.bincount(s, minlength=256)
    begin = np.concatenate([[0], np.cumsum(counts)])
    large_counts = np.bincount(s[~small], minlength=256)
    out = np.empty(n, np.int64)
    out[: counts[0]] = np.flatnonzero(s == 0)
    # stage one: sort by the bytes up to the end of the part; equal ones by position, as the ends are
    direct = np.flatnonzero(small & (s != 0))
    raw, ends = s.tobytes(), out[: counts[0]]
    stop = (ends[np.searchsorted(ends, direct)] + 1).tolist()
    keys = [raw[i:e] for i, e in zip(direct.tolist(), stop, strict=True)]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
    del keys
    sorted_small, letters = direct[order] if len(order) else direct, np.bincount(s[direct], minlength=256)
    at = 0
    for c in np.flatnonzero(letters):
        out[begin[c] + large_counts[c] : begin[c + 1]] = sorted_small[at : at + letters[c]]
        at += letters[c]
    # stage two
    free = begin[:-1].copy()
    free[0] = begin[1]
    for c in np.flatnonzero(counts):
        fresh = out[begin[c] : free[c]] if c else out[:0]
        while len(fresh):  # runs of the letter itself
            before = fresh - 1
            before = before[before >= 0]
            fresh = before[(s[before] == c) & ~small[before]]
            out[free[c] : free[c] + len(fresh)] = fresh
            free[c] += len(fresh)
        before = out[begin[c] : begin[c + 1]] - 1
        before = before[before >= 0]
        before = before[s[before] > c]
        letter = s[before]
        grouped = np.argsort(letter, kind="stable")
        before, letter = before[grouped], letter[grouped]
        found, first, many = np.unique(letter, return_index=True, return_counts=True)
        out[np.arange(len(before)) + np.repeat(free[found] - first, many)] = before
        free[found] += many
    return out


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in the array and the one before it; it never crosses a 0."""
    n = len(s)
    previous = np.empty(n, np.int64)
    previous[sa[0]] = -1
    previous[sa[1:]] = sa[:-1]
    i = np.arange(n)
    known = previous >= 0
    same_left = np.zeros(n, bool)
    both = known & (i > 0) & (previous > 0)
    same_left[both] = (s[i[both] - 1] == s[previous[both] - 1]) & (s[i[both] - 1] != 0)
    # a pair whose left neighbours agree is one shorter than theirs: only the others are compared
    todo = np.flatnonzero(known & ~same_left)
    ends = np.flatnonzero(s == 0)
    left = ends[np.searchsorted(ends, i)] - i
    most = np.minimum(left[todo], left[previous[todo]])
    padded = np.concatenate([s, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = padded[:-1] << np.uint64(8) | padded[1:]
    word = word[:-2] << np.uint64(16) | word[2:]
    word = word[:-4] << np.uint64(32) | word[4:]
    length, active = np.zeros(len(todo), np.int64), np.arange(len(todo))
    while len(active):
        a, k = todo[active], length[active]
        equal = (k + 8 <= most[active]) & (word[np.minimum(a + k, n - 1)] == word[np.minimum(previous[a] + k, n - 1)])
        active = active[equal]
        length[active] += 8
    active = np.flatnonzero(length < most)
    while len(active):
        a, k = todo[active], length[active]
        active = active[s[a + k] == s[previous[a] + k]]
        length[active] += 1
        active = active[length[active] < most[active]]
    reach = np.full(n, -1, np.int64)
    reach[todo] = length + todo
    reach[~known] = i[~known]
    return (np.maximum.accumulate(reach) - i)[sa]


def repeated_starts(parts: list[bytes], window: int) -> list[np.ndarray]:
    """For each part which of its ``len(part) - window + 1`` windows starts anywhere else in the parts."""
    # UTF-8 has no byte above 0xF4, so all bytes move up by one and 0 is free to end the parts
    joined = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8) + np.uint8(1)
    sa = suffix_array(joined)
    long = common_prefixes(joined, sa) >= window
    again = np.zeros(len(joined), bool)
    again[sa[long]] = True
    again[sa[np.flatnonzero(long) - 1]] = True
    out, at = [], 0
    for p in parts:
        out.append(again[at : at + len(p) - window + 1])
        at += len(p) + 1
    return out


def _slice(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    texts = as_bytes(batch.column(2))
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    return texts, ends - sizes, ends, prefix_hash(BYTE_VALUE[np.frombuffer(b"".join(texts), np.uint8)])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _rows(docs: DataFrame, doc_id: str, text: str, carry: Sequence[str] = ()) -> DataFrame:
    """Id, print and text: id and print name a row, up to rows that are equal in both."""
    return docs.select(
        docs[doc_id].cast("bigint").alias("doc_id"), F.xxhash64(docs[text]).alias("print"), docs[text].alias("text"),
        *[docs[c].alias(f"carried_{k}") for k, c in enumerate(carry)],
    )


def _anchor_counts(rows: DataFrame, window: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, begins, ends, prefix = _slice(batch)
        keys, n = np.unique(gram_keys(prefix, anchor_runs(prefix, begins, ends, GRAM, window), GRAM), return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(keys), pa.array(n)], ["key", "n"])

    return map_slices(rows, run, "key BIGINT, n BIGINT", text=2, limit=SLICE_BYTES).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def _likely_blocks(prefix: np.ndarray, begins: np.ndarray, ends: np.ndarray, window: int, bits: np.ndarray) -> Blocks:
    runs = anchor_runs(prefix, begins, ends, GRAM, window)
    seen = passes(bits, gram_keys(prefix, runs, GRAM))
    return offset_blocks(prefix, type(runs)(*(x[seen] for x in runs)), GRAM, window, GRID)


def _spot(core: np.ndarray, variant: np.ndarray, doc_id: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash that names one block of one document."""
    return mix(mix(core ^ mix(variant)) + mix(doc_id.view(np.uint64)) * np.uint64(3) + start.astype(np.uint64))


def repeated_blocks(rows: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Blocks that can hold repeated windows, and for each (core, variant) the runs of starts that repeat."""
    spark = rows.sparkSession
    bits = spark.sparkContext.broadcast(bit_filter(_anchor_counts(rows, window)))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, begins, ends, prefix = _slice(batch)
        b = _likely_blocks(prefix, begins, ends, window, bits.value)
        doc = pa.array(b.doc)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(doc), batch.column(1).take(doc), pa.array((b.start - begins[b.doc]).astype(np.int32)),
             pa.array(b.starts.astype(np.int32)), _signed(b.core), _signed(b.variant)],
            ["doc_id", "print", "start", "starts", "core", "variant"],
        )

    blocks = shared_table(map_slices(rows, find, BLOCKS, text=2, limit=SLICE_BYTES), "blocks")
    variants = blocks.groupBy("core", "variant").agg(
        F.count("*").alias("n"), F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "start")).alias("spot"), F.max("starts").alias("starts")
    )
    groups = variants.groupBy("core").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    known = shared_table(variants.join(groups, "core"), "variants")

    # one block stands for each variant of a group of several; its text is cut where the document is read again
    mixed = known.where("kinds > 1")
    spots = mixed.select("core", "variant", F.col("spot.doc_id").alias("doc_id"), F.col("spot.start").alias("start"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [b.column(k).to_numpy() for k in range(4)]
            yield pa.RecordBatch.from_arrays([_signed(_spot(c[0].view(np.uint64), c[1].view(np.uint64), c[2], c[3]))], ["key"])

    wanted = spark.sparkContext.broadcast(bit_filter(map_batches(spots, named, "key BIGINT")))
    hot = spark.sparkContext.broadcast(bit_filter(mixed.where(F.col("kinds") > HOT_VARIANTS).select("core").distinct(), "core"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, begins, ends, prefix = _slice(batch)
        b = _likely_blocks(prefix, begins, ends, window, bits.value)
        ids = batch.column(0).fill_null(0).to_numpy().astype(np.int64)
        chosen = np.flatnonzero(passes(wanted.value, _spot(b.core, b.variant, ids[b.doc], b.start - begins[b.doc])))
        by_hash = passes(hot.value, b.core[chosen])
        parts, hashes = [], []
        for k, h in zip(chosen.tolist(), by_hash.tolist(), strict=True):
            start, many = int(b.start[k]), int(b.starts[k])
            if h:
                at = np.arange(start, start + many)
                hashes.append(span_hash(prefix, at, at + window).view(np.int64).tolist())
                parts.append(None)
            else:
                own = start - int(begins[b.doc[k]])
                parts.append(texts[b.doc[k]][own : own + many + window - 1])
                hashes.append(None)
        return pa.RecordBatch.from_arrays(
            [_signed(b.core[chosen]), _signed(b.variant[chosen]), pa.array(parts, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
            ["core", "variant", "part", "hashes"],
        )

    # the filter may let other copies pass, also of groups of one variant: one block of each variant of a mixed group is enough
    found = map_slices(rows, cut, "core BIGINT, variant BIGINT, part BINARY, hashes ARRAY<BIGINT>", text=2, limit=SLICE_BYTES)
    pieces = shared_table(
        found.dropDuplicates(["core", "variant"]).join(mixed.select("core", "variant"), ["core", "variant"], "left_semi"), "pieces"
    )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[tuple[int, int]] = []
        parts: list[bytes] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            found = []
            for (core, variant), again in zip(names, repeated_starts(parts, window), strict=True):
                for a, e in zip(*runs_of(again), strict=True):
                    found.append((core, variant, int(a), int(e)))
            names.clear()
            parts.clear()
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            columns = zip(*found, strict=True) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], ["core", "variant", "first", "last"])

        for b in batches:
            for core, variant, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if size >= SORT_BYTES and core != last:
                    yield flush()
                    size = 0
                names.append((core, variant))
                parts.append(part)
                size, last = size + len(part), core
        if parts:
            yield flush()

    texts = pieces.where("part IS NOT NULL").select("core", "variant", "part")
    sorted_runs = map_batches(texts.repartition("core").sortWithinPartitions("core"), sort, "core BIGINT, variant BIGINT, first INT, last INT")
    windows = pieces.where("hashes IS NOT NULL").select("core", "variant", F.posexplode("hashes").alias("first", "hash"))
    twice = windows.groupBy("hash").agg(F.count("*").alias("m")).where("m > 1").select("hash")
    hot_runs = windows.join(twice, "hash").select("core", "variant", "first", F.col("first").alias("last"))
    partial = sorted_runs.union(hot_runs).distinct().groupBy("core", "variant").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    whole = known.where("n > 1").select("core", "variant", F.array(F.struct(F.lit(0).alias("first"), (F.col("starts") - 1).alias("last"))).alias("runs"))
    once = known.where("n = 1 AND kinds > 1").select("core", "variant")
    return blocks, whole.union(once.join(partial, ["core", "variant"]).select("core", "variant", "runs"))


def remove_repeats(
    docs: DataFrame, window: int = 400, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = (), as_text: bool = False,
) -> DataFrame:
    """Remove every byte covered by a string of ``window`` bytes that starts anywhere else too, in any row of the table.

    One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes) and the columns ``carry``. With
    ``as_text`` the last is the column ``text``: the remaining bytes without the letters that a removed run cut through.
    NULL is an empty text. Matches never cross rows. Repeated rows are copies of each other and go whole if they are long
    enough; overlaps count; shorter texts are kept. ``window`` must be over 2 * GRAM.
    """
    if window <= 2 * GRAM:
        raise ValueError(f"window must be over {2 * GRAM}")
    rows = _rows(docs, doc_id, text)
    blocks, repeats = repeated_blocks(rows, window)
    spans = (
        blocks.join(repeats, ["core", "variant"]).select("doc_id", "print", "start", F.explode("runs").alias("r"))
        .select("doc_id", "print", F.struct((F.col("start") + F.col("r.first")).alias("first"), (F.col("start") + F.col("r.last")).alias("last")).alias("span"))
        .groupBy("doc_id", "print").agg(F.collect_list("span").alias("spans"))
        .select(F.col("doc_id").alias("span_id"), F.col("print").alias("span_print"), "spans")
    )
    carried = [f"carried_{k}" for k in range(len(carry))]
    joined = _rows(docs, doc_id, text, carry).join(spans, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("print") == F.col("span_print")), "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, gone, many, kept = [], [], [], []
        for raw, spans in zip(as_bytes(batch.column(1)), batch.column(2), strict=True):
            sizes.append(len(raw))
            if spans.is_valid:
                flat = spans.values.flatten()
                out = covered(len(raw), flat[0].to_numpy(), flat[1].to_numpy(), window)
                gone.append(int(out.sum()))
                many.append(len(runs_of(out)[0]))
                raw = np.frombuffer(raw, np.uint8)[~out].tobytes()
            else:
                gone.append(0)
                many.append(0)
            kept.append(raw.decode("utf-8", "ignore") if as_text else raw)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, many)), pa.array(kept, pa.string() if as_text else pa.binary()),
             *(batch.column(3 + k) for k in range(len(carried)))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", last, *carried],
        )

    last = "text" if as_text else "kept"
    kinds = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(carried, carry, strict=True))
    schema = f"doc_id BIGINT, n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, {last} {'STRING' if as_text else 'BINARY'}{kinds}"
    out = map_slices(joined.select("doc_id", "text", "spans", *carried), run, schema)
    return out.withColumnsRenamed(dict(zip(carried, carry, strict=True)))
