"""Katz backoff language model over words: Good-Turing discounted counts, exactly normalised backoff weights.

The corpus is staged once as batches of documents. Counts travel up and probabilities' parts travel down, both summed per batch and packed
as arrays: a batch sends each of its distinct words (then word pairs) once to the bucket that counts it, and
finds the answers under its own key in a table sorted by batch. So a word or pair that makes up a third of all tokens is one entry per
batch. Pairs are filed under their first word; a first word with more than 1/HOT of all tokens is spread over all buckets.

P(w|u) is d_n * n / c(u) for a pair seen n times and alpha(u) * P(w) for others; P(w) is d_c * c / N for known words, and what the
discounts leave goes to unknown ones. alpha(u) makes each P(.|u) sum to one over the known words and the unknown one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, functions as F

from weekwise.session import shared_dir

from ._common import BYTE_VALUE, LOWER, as_bytes, mix, prefix_hash, shared_table, slices, span_hash, word_spans

BATCH_BYTES = 8 << 20  # text of a batch; a longer text is a batch of its own
HASH_BYTES = 1 << 20  # text whose words are hashed at a time
BUCKET_BYTES = 8 << 20  # text whose words and pairs one bucket counts, on average
SHELVES, SHELF_BATCHES = 256, 64  # directories of a table of answers: so many, more only where each would hold over SHELF_BATCHES batches
ROW_GROUP_BYTES = 8 << 20
TOP = 5  # counts up to so many are discounted
HOT = 10_000  # at most so many first words are spread over the buckets
START, UNKNOWN, FIRST = 0, 1, 2  # ids: start of a text (as first word only), unknown word, first known word
END_HASH = np.uint64(0x9D5C0FB1E3A7C24B)  # stands for the end of a text
WORK = "kind STRING, bucket INT, batch BIGINT, x BINARY, y BINARY, z BINARY, ids ARRAY<INT>, others ARRAY<INT>, counts ARRAY<BIGINT>, sums ARRAY<DOUBLE>"
FIELDS = [("kind", pa.string()), ("bucket", pa.int32()), ("batch", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary()),
          ("ids", pa.list_(pa.int32())), ("others", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("sums", pa.list_(pa.float64()))]


def pack(values: np.ndarray) -> bytes:
    """Bytes of the same place side by side, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(raw.T.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def _batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in FIELDS], [n for n, _ in FIELDS])


def discounts(kinds: list[int]) -> np.ndarray:
    """Good-Turing factors for counts 0..TOP+1 (the last for all above) from kinds[r] = number of types seen r times, r up to TOP + 1.

    The largest range 1..k in which Katz's formula gives factors in (0, 1] is used; with none, nothing is discounted.
    """
    out = np.ones(TOP + 2)
    for k in range(TOP, 0, -1):
        if kinds[1] <= 0 or any(kinds[r] <= 0 for r in range(1, k + 2)):
            continue
        rest = (k + 1) * kinds[k + 1] / kinds[1]
        if rest >= 1:
            continue
        d = [((r + 1) * kinds[r + 1] / (r * kinds[r]) - rest) / (1 - rest) for r in range(1, k + 1)]
        if all(0 < x <= 1 for x in d):
            out[1 : k + 1] = d
            return out
    return out


class Words(NamedTuple):
    """Unigram model: total N, distinct V, factors, scale, and the probability of the unknown word."""

    total: int
    distinct: int
    factor: np.ndarray
    scale: float
    unknown: float

    def p(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words by their counts (0: the unknown word)."""
        return np.where(counts > 0, self.factor[np.minimum(counts, TOP + 1)] * counts * self.scale, self.unknown)


def word_model(total: int, distinct: int, kinds: list[int]) -> Words:
    """kinds[r]: words seen r times, r up to TOP + 1."""
    if not total:
        return Words(0, 0, np.ones(TOP + 2), 0.0, 1.0)
    factor = discounts(kinds)
    left = sum((1 - factor[r]) * r * kinds[r] for r in range(1, TOP + 1)) / total
    if left <= 0:  # nothing discounted: one more token is set aside for the unknown
        return Words(total, distinct, np.ones(TOP + 2), 1 / (total + 1), 1 / (total + 1))
    return Words(total, distinct, factor, 1 / total, left)


def backoff(counts: np.ndarray, small: np.ndarray, seen_mass: np.ndarray, factor: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, scale) of contexts: c(u), kinds of pairs seen 1..TOP times (rows), sum of P(w) over seen w."""
    r = np.arange(1, TOP + 1)
    left = (small * (r * (1 - factor[1 : TOP + 1]))[None, :]).sum(1)
    none = left <= 0
    total = counts + none
    left = np.where(none, 1.0, left)
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.where(counts > 0, left / total / np.maximum(1 - seen_mass, unknown), 1.0)
        return alpha, np.where(counts > 0, 1 / total, 0.0)


class Batch(NamedTuple):
    """Tokens of a batch: sorted distinct hashes, index of each token in them, its document; ids and marks of documents."""

    ids: list
    held: np.ndarray
    hashes: np.ndarray
    token: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # token begins a document


def open_batch(ids: list, held: np.ndarray, sizes: np.ndarray, blob: bytes) -> Batch:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, begins = len(ids), np.concatenate([[0], np.cumsum(sizes + 1)])
    parts, owners, k = [], [], 0
    while k < n:  # words of about HASH_BYTES at a time
        stop = max(k + 1, int(np.searchsorted(begins, begins[k] + HASH_BYTES, "right")) - 1)
        data = np.frombuffer(raw, np.uint8)[begins[k] : begins[stop]]
        start, end = word_spans(data)
        doc = k + np.searchsorted(begins[k + 1 : stop + 1] - begins[k], start, "right")
        words = np.full(len(start) + stop - k, END_HASH, np.uint64)
        words[np.arange(len(start)) + doc - k] = span_hash(prefix_hash(BYTE_VALUE[data]), start, end)
        parts.append(words)
        owners.append(np.repeat(np.arange(k, stop), np.bincount(doc - k, minlength=stop - k) + 1))
        k = stop
    docs = np.concatenate(owners)
    hashes, token = np.unique(np.concatenate(parts), return_inverse=True)
    first = np.ones(len(docs), bool)
    first[1:] = docs[1:] != docs[:-1]
    return Batch(ids, held, hashes, token, docs, first)


def _stage(docs: DataFrame, held: Column, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, BATCH_BYTES):
                texts = [t.translate(LOWER) for t in as_bytes(part.column(2))]
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().int >> 66], pa.int64()), pa.array([part.column(0).to_pylist()], kind), pa.array([part.column(1).to_pylist()], pa.list_(pa.bool_())),
                     pa.array([[len(t) for t in texts]], kind), pa.array([zstandard.ZstdCompressor(level=3).compress(b" ".join(texts))], pa.binary())],
                    ["batch", "doc_ids", "held", "sizes", "texts"],
                )

    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), held.alias("held"), docs[text].alias("text"))
    return shared_table(rows.mapInArrow(run, "batch BIGINT, doc_ids ARRAY<BIGINT>, held ARRAY<BOOLEAN>, sizes ARRAY<BIGINT>, texts BINARY"), "corpus")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Batch]]:
    for b in batches:
        for i in range(b.num_rows):
            ids = b.column(1)[i].as_py()
            yield b.column(0)[i].as_py(), open_batch(ids, np.array(b.column(2)[i].as_py(), bool), np.array(b.column(3)[i].as_py(), np.int64), b.column(4)[i].as_py())


class Answers(NamedTuple):
    """A table of answers: batches share ``shelves`` directories, sorted by batch, and a reader finds its batch by row-group statistics."""

    folder: str
    shelves: int

    def of(self, batch: int) -> dict[int, dict]:
        files, path = pafs.FileSystem.from_uri(f"{self.folder}/shelf={batch % self.shelves}")
        table = pads.dataset(path, filesystem=files, format="parquet").to_table(columns=["bucket", "x", "y", "z"], filter=pads.field("batch") == batch)
        return {r["bucket"]: r for r in table.to_pylist()}


def _by_batch(rows: DataFrame, name: str, shelves: int) -> Answers:
    path = f"{shared_dir(rows.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    placed = rows.select("batch", "bucket", "x", "y", "z", (F.col("batch") % shelves).alias("shelf"))
    placed.repartition("shelf").sortWithinPartitions("shelf", "batch").write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy("shelf").parquet(path)
    return Answers(path, shelves)


def _split(bucket: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Indices of each bucket, in order."""
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.cumsum(np.bincount(bucket, minlength=buckets))[:-1])


def _count_words(key: tuple, table: pa.Table, buckets: int) -> pa.Table:
    """Total count and id of the words of one bucket, and the answer to each batch."""
    bucket = int(key[0].as_py())
    rows = table.select(["batch", "x", "y"]).to_pylist()
    parts, counts = [unpack_sorted(r["x"]) for r in rows], [unpack(r["y"], np.uint32) for r in rows]
    words, where = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(where, np.concatenate(counts), len(words)).astype(np.int64)
    known = total > 0
    if known.sum() * buckets >= (1 << 31) - FIRST - buckets:
        raise OverflowError("more words than 31-bit ids")
    # frequent words get small ids: pairs then sort into runs that pack well
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(words))
    ids = np.where(known, FIRST + rank * buckets + bucket, UNKNOWN)
    out, at = [], 0
    for r, p in zip(rows, parts, strict=True):
        w = where[at : at + len(p)]
        out.append({"kind": "answer", "bucket": bucket, "batch": r["batch"], "x": pack(ids[w].astype(np.uint32)), "y": pack(total[w])})
        at += len(p)
    kinds = np.bincount(np.minimum(total[known], TOP + 2), minlength=TOP + 3)[: TOP + 2].tolist()
    out.append({"kind": "sum", "bucket": bucket, "counts": [int(total.sum()), int(known.sum()), *kinds]})
    out.append({"kind": "words", "bucket": bucket, "x": pack_sorted(words[known]), "ids": ids[known].tolist(), "counts": total[known].tolist()})
    return pa.Table.from_batches([_batch_of(out)])


def _count_pairs(key: tuple, table: pa.Table, words: Words, hot: np.ndarray) -> pa.Table:
    """Total count of the pairs of one bucket, what their contexts need for alpha, and the answer to each batch."""
    bucket = int(key[0].as_py())
    rows = table.select(["batch", "x", "y", "z"]).to_pylist()
    parts = [unpack_sorted(r["x"]) for r in rows]
    every = np.concatenate(parts)
    pairs, first, where = np.unique(every, return_index=True, return_inverse=True)
    del every
    total = np.bincount(where, np.concatenate([unpack(r["y"], np.uint32) for r in rows]), len(pairs)).astype(np.int64)
    second_counts = np.concatenate([unpack(r["z"], np.int64) for r in rows])[first]
    u = (pairs >> np.uint64(32)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    contexts, group = u[begins], np.cumsum(np.concatenate([[0], u[1:] != u[:-1]])) if len(u) else u
    seen = total > 0
    mass = np.bincount(group[seen], words.p(second_counts[seen]), len(contexts))
    small = np.stack([np.bincount(group[total == r], minlength=len(contexts)) for r in range(1, TOP + 1)], 1)
    used = np.bincount(group, total, len(contexts)).astype(np.int64)
    spread = np.isin(contexts, hot)
    present = ((small > 0) << np.arange(TOP)).sum(1).astype(np.uint8)
    out, at = [], 0
    for r, p in zip(rows, parts, strict=True):
        w = where[at : at + len(p)]
        at += len(p)
        own, asking = np.unique(group[w]), np.unique(group[w[total[w] == 0]])
        own, asking = own[~spread[own]], asking[~spread[asking]]
        full = pack(np.column_stack([small[asking].astype(np.float64), mass[asking]]).reshape(-1))
        out.append({"kind": "answer", "bucket": bucket, "batch": r["batch"], "x": pack(total[w].astype(np.uint32)), "y": pack(present[own]), "z": full})
    kinds = np.bincount(np.minimum(total[seen], TOP + 2), minlength=TOP + 3)[: TOP + 2].tolist()
    out.append({"kind": "sum", "bucket": bucket, "counts": kinds})
    for k in np.flatnonzero(spread):
        out.append({"kind": "hot", "bucket": bucket, "batch": int(contexts[k]), "counts": [int(used[k]), *small[k].tolist()], "sums": [float(mass[k])]})
    plain = np.flatnonzero(~spread & (used > 0))
    for k in range(0, len(plain), 1 << 16):
        c = plain[k : k + (1 << 16)]
        out.append({"kind": "contexts", "bucket": bucket, "ids": contexts[c].tolist(), "counts": np.column_stack([used[c], small[c]]).reshape(-1).tolist(), "sums": mass[c].tolist()})
    listed = np.flatnonzero(seen)
    batches = [_batch_of(out)]
    for k in range(0, len(listed), 1 << 18):
        c = listed[k : k + (1 << 18)]
        one = np.array([0, len(c)], np.int32)
        columns = {"kind": pa.array(["pairs"]), "bucket": pa.array([bucket], pa.int32()),
                   "ids": pa.ListArray.from_arrays(pa.array(one), pa.array(u[c].astype(np.int32))),
                   "others": pa.ListArray.from_arrays(pa.array(one), pa.array((pairs[c] & np.uint64(0xFFFFFFFF)).astype(np.int32))),
                   "counts": pa.ListArray.from_arrays(pa.array(one), pa.array(total[c]))}
        batches.append(pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(1, kind)) for n, kind in FIELDS], [n for n, _ in FIELDS]))
    return pa.Table.from_batches(batches)


def _pair_bucket(pairs: np.ndarray, u: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    spread = np.isin(u, hot)
    return (mix(np.where(spread, pairs, u.astype(np.uint64) << np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


class Model(NamedTuple):
    """The tables of a fitted model: ``work1`` has rows of kind words (hash, id, count), ``work2`` of kinds pairs (ids, others, counts) and contexts."""

    corpus: DataFrame
    word_answers: Answers
    pair_answers: Answers
    words: Words
    pair_factor: np.ndarray
    hot: np.ndarray
    hot_stats: dict[int, tuple]
    buckets: int
    work1: DataFrame
    work2: DataFrame


def _vocabulary(batch: int, b: Batch, answers: Answers, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Id and total count of each distinct word of the batch."""
    ids, counts = np.full(len(b.hashes), UNKNOWN, np.int64), np.zeros(len(b.hashes), np.int64)
    found = answers.of(batch)
    for k, own in enumerate(_split((b.hashes % np.uint64(buckets)).astype(np.int64), buckets)):
        if len(own):
            ids[own], counts[own] = unpack(found[k]["x"], np.uint32), unpack(found[k]["y"], np.int64)
    return ids, counts


def _pairs(b: Batch, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (first id in the upper 32 bits) of the batch, sorted, and the pair of each token."""
    second = ids[b.token]
    first = np.concatenate([[START], second[:-1]])
    first[b.first] = START
    return np.unique(first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64), return_inverse=True)


def fit(docs: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Count words and pairs of the rows whose ``held`` is false; the held ones are staged along to be scored.

    Bounded: a batch, a bucket, and the list of spread first words. All counts are exact and cover every training text.
    """
    corpus = _stage(docs, held, doc_id, text)
    size, many = corpus.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x + 1)), F.count("*")).first()
    size, shelves = size or 0, max(SHELVES, many // SHELF_BATCHES)
    buckets = max(4, -(-size // BUCKET_BYTES))

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b in _batches(batches):
            counts = np.bincount(b.token[~b.held[b.doc]], minlength=len(b.hashes)).astype(np.uint32)
            yield _batch_of([
                {"bucket": k, "batch": batch, "x": pack_sorted(b.hashes[own]), "y": pack(counts[own])}
                for k, own in enumerate(_split((b.hashes % np.uint64(buckets)).astype(np.int64), buckets)) if len(own)
            ])

    sent = corpus.mapInArrow(send_words, WORK).select("bucket", "batch", "x", "y")
    work1 = shared_table(sent.groupBy("bucket").applyInArrow(lambda k, t: _count_words(k, t, buckets), WORK), "words", partition_by=("kind",))
    word_answers = _by_batch(work1.where("kind = 'answer'"), "word-answers", shelves)
    sums = work1.where("kind = 'sum'").select(*[F.sum(F.col("counts")[i]) for i in range(TOP + 4)]).first()
    total, distinct, *kinds = (int(x or 0) for x in sums)
    words = word_model(total, distinct, kinds)
    # fewer than HOT words can each have more than 1 / HOT of the tokens
    frequent = work1.where("kind = 'words'").select(F.explode(F.arrays_zip("ids", "counts")).alias("w")).where(F.col("w.counts") * HOT > total)
    hot = np.array(sorted({START, UNKNOWN, *(r[0] for r in frequent.select("w.ids").collect())}), np.int64)

    def send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b in _batches(batches):
            ids, counts = _vocabulary(batch, b, word_answers, buckets)
            pairs, where = _pairs(b, ids)
            n = np.bincount(where[~b.held[b.doc]], minlength=len(pairs)).astype(np.uint32)
            second = np.zeros(len(pairs), np.int64)
            second[where] = counts[b.token]
            own_bucket = _pair_bucket(pairs, (pairs >> np.uint64(32)).astype(np.int64), hot, buckets)
            yield _batch_of([
                {"bucket": k, "batch": batch, "x": pack_sorted(pairs[own]), "y": pack(n[own]), "z": pack(second[own])}
                for k, own in enumerate(_split(own_bucket, buckets)) if len(own)
            ])

    sent = corpus.mapInArrow(send_pairs, WORK).select("bucket", "batch", "x", "y", "z")
    work2 = shared_table(sent.groupBy("bucket").applyInArrow(lambda k, t: _count_pairs(k, t, words, hot), WORK), "pairs", partition_by=("kind",))
    pair_answers = _by_batch(work2.where("kind = 'answer'"), "pair-answers", shelves)
    sums = work2.where("kind = 'sum'").select(*[F.sum(F.col("counts")[i]) for i in range(TOP + 2)]).first()
    factor = discounts([int(x or 0) for x in sums])
    spread = work2.where("kind = 'hot'").groupBy("batch").agg(
        *[F.sum(F.col("counts")[i]).alias(f"n{i}") for i in range(TOP + 1)], F.sum(F.col("sums")[0]).alias("mass")
    ).collect()
    stats = {r.batch: (r.n0, [r[f"n{i}"] for i in range(1, TOP + 1)], r.mass) for r in spread}
    return Model(corpus, word_answers, pair_answers, words, factor, hot, stats, buckets, work1, work2)


def backoff_weights(model: Model) -> DataFrame:
    """(id, alpha) of every first word seen in training."""
    factor, unknown = model.pair_factor, model.words.unknown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, counts, sums in zip(*(b.column(k) for k in range(3)), strict=True):
                table = np.array(counts.as_py(), np.int64).reshape(-1, TOP + 1)
                alpha, _ = backoff(table[:, 0], table[:, 1:], np.array(sums.as_py()), factor, unknown)
                yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), pa.int32()), pa.array(alpha)], ["id", "alpha"])

    plain = model.work2.where("kind = 'contexts'").select("ids", "counts", "sums").mapInArrow(run, "id INT, alpha DOUBLE")
    rows = []
    for u, (n, small, mass) in model.hot_stats.items():
        if n:
            rows.append((u, float(backoff(np.array([n]), np.array([small]), np.array([mass]), factor, unknown)[0][0])))
    return plain.union(model.corpus.sparkSession.createDataFrame(rows, "id INT, alpha DOUBLE"))


def score(model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per staged text, log10 of its probability.

    Each token asks for its pair; where training has none, for alpha of the first word and the word alone; where
    that is unknown too, for the unknown word. A NULL or empty text is the end alone. Repeated rows stay.
    """
    words, factor, hot, buckets = model.words, model.pair_factor, model.hot, model.buckets
    word_answers, pair_answers, stats = model.word_answers, model.pair_answers, model.hot_stats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b in _batches(batches):
            ids, counts = _vocabulary(batch, b, word_answers, buckets)
            pairs, where = _pairs(b, ids)
            u = (pairs >> np.uint64(32)).astype(np.int64)
            n, small, mass = np.zeros(len(pairs), np.int64), np.zeros((len(pairs), TOP)), np.zeros(len(pairs))
            present = np.zeros(len(pairs), np.uint8)
            found = pair_answers.of(batch)
            for k, own in enumerate(_split(_pair_bucket(pairs, u, hot, buckets), buckets)):
                if not len(own):
                    continue
                n[own] = unpack(found[k]["x"], np.uint32)
                plain = own[~np.isin(u[own], hot)]
                present[plain] = unpack(found[k]["y"], np.uint8)[np.unique(u[plain], return_inverse=True)[1]]
                asking = plain[n[plain] == 0]
                table = unpack(found[k]["z"], np.float64).reshape(-1, TOP + 1)[np.unique(u[asking], return_inverse=True)[1]]
                small[asking], mass[asking] = table[:, :TOP], table[:, TOP]
            # how often a first word was seen: as often as the word itself; spread ones come with the model
            order = np.argsort(ids, kind="stable")
            at = np.minimum(np.searchsorted(ids[order], u), len(ids) - 1)
            used = np.where(ids[order][at] == u, counts[order][at], 0)
            for h in np.intersect1d(hot, u):
                mine = slice(*np.searchsorted(u, [h, h + 1]))
                total, few, m = stats.get(int(h), (0, [0] * TOP, 0.0))
                used[mine], small[mine], mass[mine] = total, few, m
                present[mine] = sum((x > 0) << r for r, x in enumerate(few))
            # a context with nothing to discount sets one count aside, as ``backoff`` does
            lowered = np.flatnonzero(factor[1 : TOP + 1] < 1)
            none = ~((present[:, None] >> lowered[None, :].astype(np.uint8)) & 1).any(1)
            second = np.zeros(len(pairs), np.int64)
            second[where] = counts[b.token]
            p = factor[np.minimum(n, TOP + 1)] * n / np.maximum(used + none, 1)
            unseen = np.flatnonzero(n == 0)
            alpha, _ = backoff(used[unseen], small[unseen], mass[unseen], factor, words.unknown)
            p[unseen] = alpha * words.p(second[unseen])
            docs, c = len(b.ids), counts[b.token]
            sums = [np.bincount(b.doc, x, docs) for x in (np.log10((c + 1) / (words.total + words.distinct + 1)), np.log10(p)[where])]
            many = [np.bincount(b.doc, x, docs).astype(np.int64) for x in (np.ones(len(c)), c > 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.ids, pa.int64()), pa.array(b.held), *map(pa.array, many), pa.array(np.full(docs, words.total, np.int64)), *map(pa.array, sums)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return model.corpus.mapInArrow(
        run, "doc_id BIGINT, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, train_tokens BIGINT, base_score DOUBLE, score DOUBLE"
    )
