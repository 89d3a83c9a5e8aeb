"""Toxicity by a factorisation machine over hashed terms.

A term is a word or the beginning of a longer word (which gathers inflected forms), known by a 64-bit hash. The logit of a text is
``bias + sum w_i + sum_{i<j} <v_i, v_j>`` over its distinct terms: single words count by w, and pairs such as an
insult next to a mention of a group by the product of their factors, whether or not the pair was seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import BYTE_VALUE, LOWER, as_bytes, give_back, map_batches, map_slices, prefix_hash, slices, span_hash, word_spans

SAMPLE_ROWS = 12_000  # bound of the labelled sample that the model is fitted on
MAX_TERMS = 50_000  # bound of the terms in the model, those that tell most about the labels of the sample
FACTORS = 4
MIN_DOCS, STRENGTH = 4, 3.0  # a term needs so many sample documents, and labels so many standard deviations from the share of all
STEMS = (4, 5, 6, 7, 8)  # lengths of word beginnings that are terms, in bytes
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.3, 1e-5
CHUNK, COUNT_BITS = 128, 25  # texts whose terms are held at a time; 32 MB of counters while terms are chosen
POSITIVE = 2.0  # weight of a toxic document in the loss
ONLY_LETTERS = LOWER.translate(bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)))


class Model(NamedTuple):
    """terms: sorted hashes; w and v: one row per term."""

    terms: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, term): distinct hashed terms of each text, sorted by both."""
    texts = [t if t.isascii() else t.decode("utf-8", "replace").lower().encode() for t in texts]
    joined = b" ".join(texts).translate(ONLY_LETTERS)
    if not joined:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    prefix = prefix_hash(BYTE_VALUE[data])
    start, end = word_spans(data)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    docs, terms = [doc], [span_hash(prefix, start, end)]
    for k in STEMS:
        longer = end - start > k
        docs.append(doc[longer])
        terms.append(span_hash(prefix, start[longer], start[longer] + k) ^ np.uint64(k))
    doc, term = np.concatenate(docs), np.concatenate(terms)
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    return doc[first], term[first]


def _known(model_terms: np.ndarray, doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(model_terms):
        return doc[:0], np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(model_terms, term), len(model_terms) - 1)
    hit = model_terms[at] == term
    return doc[hit], at[hit]


def _logit(model: Model, doc: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Logit and sums of factors of n documents."""
    out, sums = np.full(n, model.bias), np.zeros((n, FACTORS))
    out += np.bincount(doc, model.w[at], n)
    for f in range(FACTORS):
        v = model.v[at, f]
        sums[:, f] = np.bincount(doc, v, n)
        out += 0.5 * (sums[:, f] ** 2 - np.bincount(doc, v * v, n))
    return out, sums


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit by AdaGrad on the logistic loss; same rows in the same order give the same model."""
    n = len(texts)
    share = float(np.clip(labels.mean() if n else 0.0, 1e-3, 1 - 1e-3))

    def chunks() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for k in range(0, n, CHUNK):
            yield k, *terms_of(texts[k : k + CHUNK])

    # a table of fixed size counts the terms of each hash; those that reach MIN_DOCS there are then counted exactly
    seen = np.zeros(1 << COUNT_BITS, np.uint8)
    for _, _, t in chunks():
        slot, c = np.unique(t >> np.uint64(64 - COUNT_BITS), return_counts=True)
        seen[slot] = np.minimum(255, seen[slot] + np.minimum(c, 255 - MIN_DOCS))
    kinds, counts, toxic = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for k, d, t in chunks():
        often = seen[t >> np.uint64(64 - COUNT_BITS)] >= MIN_DOCS
        own, which, c = np.unique(t[often], return_inverse=True, return_counts=True)
        merged, which2 = np.unique(np.concatenate([kinds, own]), return_inverse=True)
        counts = np.bincount(which2, np.concatenate([counts, c]), len(merged))
        toxic = np.bincount(which2, np.concatenate([toxic, np.bincount(which, labels[k + d[often]], len(own))]), len(merged))
        kinds = merged
    del seen
    # how far a term's labels are from the share of all, in standard deviations
    strength = np.abs(toxic - counts * share) / np.sqrt(counts * share * (1 - share))
    usable = np.flatnonzero((counts >= MIN_DOCS) & (strength >= STRENGTH))
    if len(usable) > MAX_TERMS:
        usable = np.sort(usable[np.lexsort((kinds[usable], -strength[usable]))[:MAX_TERMS]])
    kept = kinds[usable]
    found = [(k + d, at) for k, d, at in ((k, *_known(kept, d, t)) for k, d, t in chunks())]
    doc = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    at = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    model = Model(kept, float(np.log(share / (1 - share))), np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS)))
    if not n or not len(kept):
        return model
    begins = np.searchsorted(doc, np.arange(n + 1))
    bias, seen_b = model.bias, 1.0
    seen_w, seen_v = np.full(len(kept), 1e-2), np.full((len(kept), FACTORS), 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            rows = order[k : k + BATCH]
            spans = [at[begins[r] : begins[r + 1]] for r in rows]
            own = np.repeat(np.arange(len(rows)), [len(s) for s in spans])
            terms_at = np.concatenate(spans)
            logit, sums = _logit(model._replace(bias=bias), own, terms_at, len(rows))
            error = (_sigmoid(logit) - labels[rows]) * np.where(labels[rows] > 0, POSITIVE, 1.0) / len(rows)
            seen_b += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(seen_b)
            if not len(terms_at):
                continue
            touched, where = np.unique(terms_at, return_inverse=True)
            pull = error[own]
            g = np.bincount(where, pull, len(touched)) + DECAY * model.w[touched]
            seen_w[touched] += g * g
            model.w[touched] -= RATE * g / np.sqrt(seen_w[touched])
            for f in range(FACTORS):
                v = model.v[touched, f]
                g = np.bincount(where, pull * (sums[own, f] - v[where]), len(touched)) + DECAY * v
                seen_v[touched, f] += g * g
                model.v[touched, f] = v - RATE * 0.3 * g / np.sqrt(seen_v[touched, f])
    return model._replace(bias=float(bias))


def score(model: Model, texts: list[bytes]) -> np.ndarray:
    doc, at = _known(model.terms, *terms_of(texts))
    return _sigmoid(_logit(model, doc, at, len(texts))[0])


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))) % parts


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most ``rows`` labelled documents, the first by a hash of their id.

    NULL labels are left out; of several labels of one id the largest counts. With no labelled document at hand the model is a constant.
    """
    known = (
        labels.select(labels[doc_id].cast("bigint").alias("id"), labels[label].cast("double").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    )
    # a filter by hash leaves about twice the bound, so that the one task that orders them is not sent more by more tasks
    every = max(1, known.count() // (2 * rows))
    sample = known.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(every)) == 0).orderBy(F.xxhash64("id"), "id").limit(rows)
    # ``rows`` pairs of numbers at most, so the broadcast is bounded and the texts are not shuffled
    picked = docs.select(docs[doc_id].cast("bigint").alias("id"), docs[text].alias("text")).join(F.broadcast(sample), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, ys = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            texts += as_bytes(b.column(1))
            ys += b.column(2).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))[:rows]
        m = fit([texts[i] for i in order], np.array([ys[i] for i in order], float))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], pa.binary()) for x in (m.terms.tobytes(), np.array([m.bias]).tobytes(), m.w.tobytes(), m.v.tobytes())],
            ["terms", "bias", "w", "v"],
        )

    found = map_batches(picked.select("id", "text", "y").repartition(1), run, "terms BINARY, bias BINARY, w BINARY, v BINARY").collect()
    if not found:
        return fit([], np.zeros(0))
    r = found[0]
    return Model(
        np.frombuffer(r.terms, np.uint64), float(np.frombuffer(r.bias)[0]), np.frombuffer(r.w), np.frombuffer(r.v).reshape(-1, FACTORS)
    )


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted): one row per input row, scored where it is read.

    NULL and empty texts get the score of a text without known terms. Repeated rows stay; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = np.concatenate([score(shared.value, as_bytes(part.column(1))) for part in slices(batch, 1, 1 << 20)])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
        )

    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    return map_slices(rows, run, "doc_id BIGINT, score DOUBLE, predicted INT")


def clean_rows(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``; filtered where they are read."""
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, 1 << 20):
                yield part.filter(pa.array(score(shared.value, as_bytes(part.column(column))) < threshold))
            batch = part = None
            give_back()

    return map_batches(docs, run, docs.schema)
