"""Quality rules as a short-circuit cascade: a sample prices each rule, then the best rejection per cost goes first.

The rules are a conjunction, so their order changes the work and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import map_slices, slices

SAMPLE_ROWS = 2_000  # expected rows of the sample that prices the rules; decides their order only
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
LETTERS = bytes(b for b in range(256) if b >= 128 or chr(b).isalpha())
SCHEMA = (
    "doc_id BIGINT, n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, n_repeat_words BIGINT, "
    "base_failed BOOLEAN, kept BOOLEAN"
)


class Doc(NamedTuple):
    text: str
    words: list[bytes]
    word_chars: int
    n_symbols: int
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside a window of ``size`` words that is found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key, kinds = a[:n], len(ids)
    for k in range(1, size):
        if kinds > (1 << 62) // (len(ids) + 1):
            distinct, key = np.unique(key, return_inverse=True)
            kinds = len(distinct)
        key, kinds = key * len(ids) + a[k : k + n], kinds * len(ids)
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : k + n] |= twice
    return int(covered.sum())


def measure(text: str | None) -> Doc:
    """The base counts of one text (NULL as empty)."""
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return Doc(
        text, words, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), repeated_words(words),
    )


def base_failed(d: Doc) -> bool:
    return len(d.words) < 50 or 100 * d.n_repeat_words > 50 * len(d.words)


def _no_letters(d: Doc) -> bool:
    """More than a fifth of the words hold no letter (any character beyond ASCII counts as one)."""
    return sum(len(w.translate(None, LETTERS)) == len(w) for w in d.words) * 5 > len(d.words)


def _bullets(d: Doc) -> bool:
    """More than nine lines in ten begin with a bullet."""
    lines = [x.lstrip(BLANKS) for x in d.text.split("\n") if x.strip(BLANKS)]
    return sum(x.startswith(("-", "*", "•", "·")) for x in lines) * 10 > 9 * len(lines)


def _ellipses(d: Doc) -> bool:
    """More than three lines in ten end with an ellipsis."""
    lines = [x.rstrip(BLANKS) for x in d.text.split("\n") if x.strip(BLANKS)]
    return sum(x.endswith(("...", "…")) for x in lines) * 10 > 3 * len(lines)


def _one_word(d: Doc) -> bool:
    """One word makes up over three tenths of the text."""
    counts: dict[bytes, int] = {}
    for w in d.words:
        counts[w] = counts.get(w, 0) + 1
    return max(counts.values()) * 10 > 3 * len(d.words)


RULES: dict[str, Callable[[Doc], bool]] = {
    "word_length": lambda d: not 2 * len(d.words) <= d.word_chars <= 15 * len(d.words),
    "symbols": lambda d: 10 * d.n_symbols > len(d.words),
    "dup_lines": lambda d: 10 * d.n_dup_lines > 3 * d.n_lines,
    "no_letters": _no_letters,
    "bullets": _bullets,
    "ellipses": _ellipses,
    "one_word": _one_word,
}


def price_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds per document, share rejected) on a bounded sample, best rejection per cost first.

    About ``rows`` documents are picked by a hash of the row; every task prices those it reads, a sum per rule comes back.
    Rules without a rejection come last, the cheaper first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, seen = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                for x in part.column(0).to_pylist():
                    if base_failed(d := measure(x)):
                        continue
                    seen += 1
                    for name, rule in RULES.items():
                        began = time.perf_counter()
                        hits[name] += rule(d)
                        spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(RULES)), pa.array(list(spent.values())), pa.array(list(hits.values()), pa.int64()), pa.array([seen] * len(RULES), pa.int64())],
            ["rule", "seconds", "hits", "seen"],
        )

    every = max(1, docs.count() // rows)
    sample = docs.select(docs[text].alias("text")).where(F.pmod(F.xxhash64(docs[doc_id], docs[text]), F.lit(every)) == 0)
    priced = (
        sample.mapInArrow(run, "rule STRING, seconds DOUBLE, hits BIGINT, seen BIGINT")
        .groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("hits").alias("hits"), F.sum("seen").alias("seen")).collect()
    )
    found = [(r.rule, r.seconds / max(1, r.seen), r.hits / max(1, r.seen)) for r in priced]
    return sorted(found, key=lambda x: (-x[2] / max(x[1], 1e-9), x[1], x[0]))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """Base counts and verdict of every whole text; one row per input row.

    ``base_failed`` documents skip the cascade; for the others rules run in ``order`` (by default as
    ``price_rules`` finds) up to the first rejection. NULL and empty texts have no words and fail. Repeated rows stay.
    """
    names = [x[0] for x in price_rules(docs, doc_id, text)] if order is None else list(order)
    names += [x for x in RULES if x not in names]

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        cascade, rows = [RULES[x] for x in names], []
        for x in batch.column(1).to_pylist():
            d = measure(x)
            failed = base_failed(d)
            kept = not failed and not any(rule(d) for rule in cascade)
            rows.append((len(d.words), d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, kept))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
            ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        )

    return map_slices(docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text")), judge, SCHEMA)
