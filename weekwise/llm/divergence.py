"""How the sources of a language differ in their terms: symmetric chi-square values between smoothed term shares.

Terms are counted by length. One of up to 8 bytes is one uint64, one of up to 16 is two: big-endian, so that the order of words is the order
of bytes, and as no term holds a zero byte the padding is unambiguous. Packed terms are radix-sorted by 16-bit digits and counted as runs;
longer ones are sorted as bytes, one bucket per length. The packed form is also the key of the shuffle. All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import LOWER, as_bytes, shared_table, slices

MIN_DOCS = 10  # documents of a language that must hold a kept term
TOP = 10  # ranks of part ``term``
SCALE = 1_000_000_000
SLICE_BYTES = 4 << 20  # text cut into terms at a time
CHUNK_TERMS = 4 << 20  # terms sorted and counted at a time
BLOCK = 256  # sources of a language that meet in one group
GROUP_TERMS = 8_192  # terms of a language in one group, on average
WORD = ["lang", "w1", "w2", "rest"]
COUNTS = "lang STRING, source STRING, w1 BIGINT, w2 BIGINT, rest BINARY, n BIGINT, docs BIGINT"
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def term_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ASCII letters and bytes beyond ASCII."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = LETTER[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pack_terms(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second eight bytes of each term as big-endian words, zero where it has ended."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    at = np.ndarray(len(padded) - 7, np.dtype(">u8"), padded, strides=(1,))

    def word(begin: np.ndarray, left: np.ndarray) -> np.ndarray:
        blank = (8 * (8 - np.clip(left, 0, 8))).astype(np.uint64)
        keep = np.where(blank < 64, ~np.uint64(0) << np.minimum(blank, np.uint64(63)), np.uint64(0))
        return at[begin].astype(np.uint64) & keep

    return word(start, size), word(np.minimum(start + 8, len(at) - 1), size - 8)


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order by unsigned words, the most significant last in ``words``: one counting pass per 16-bit digit that varies."""
    order = np.arange(len(words[0]))
    for w in words:
        differs = np.bitwise_or.reduce(w ^ w[0]) if len(w) else np.uint64(0)
        for shift in range(0, 64, 16):
            if int(differs) >> shift & 0xFFFF:
                digit = (w >> np.uint64(shift)).astype(np.uint16)[order]
                order = order[np.argsort(digit, kind="stable")]
    return order


def run_counts(new: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and number of distinct documents of each run; ``new`` marks its first row, documents ascend within it."""
    starts = np.flatnonzero(new)
    fresh = new.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    return starts, np.diff(starts, append=len(new)), np.add.reduceat(fresh.astype(np.int64), starts)


class _Chunk:
    """Terms of whole documents until they are counted: packed words or bytes, with group and document."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.groups.clear()
        self.terms = self.docs = 0
        self.short: list[list[tuple[np.ndarray, ...]]] = [[], []]  # (group, doc, w1[, w2]) of terms of one and of two words
        self.long: dict[int, list[tuple[int, int, bytes]]] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        texts = as_bytes(batch.column(2))
        raw = b" ".join(texts).translate(LOWER)
        data = np.frombuffer(raw, np.uint8)
        start, end = term_spans(data)
        if not len(start):
            return
        ends = np.cumsum([len(t) + 1 for t in texts])
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        group_of = np.array([self.groups.setdefault(p, len(self.groups)) for p in pairs], np.uint64)
        row, size = np.searchsorted(ends, start, "right"), end - start
        group, doc = group_of[row], self.docs + row
        w1, w2 = pack_terms(data, start, size)
        one, two = size <= 8, (size > 8) & (size <= 16)
        self.short[0].append((group[one], doc[one], w1[one]))
        self.short[1].append((group[two], doc[two], w1[two], w2[two]))
        for k in np.flatnonzero(size > 16).tolist():
            self.long.setdefault(int(size[k]), []).append((int(group[k]), int(doc[k]), raw[start[k] : end[k]]))
        self.terms += len(start)
        self.docs += len(texts)

    def counts(self) -> Iterator[pa.RecordBatch]:
        names = list(self.groups)
        langs, sources = pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.string())

        def out(group: np.ndarray, w1: np.ndarray, w2: np.ndarray, rest: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
            at = pa.array(group.astype(np.int64))
            return pa.RecordBatch.from_arrays(
                [langs.take(at), sources.take(at), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), rest, pa.array(n), pa.array(docs)],
                ["lang", "source", "w1", "w2", "rest", "n", "docs"],
            )

        for parts in self.short:
            if not sum(len(p[0]) for p in parts):
                continue
            group, doc, *words = (np.concatenate(c) for c in zip(*parts, strict=True))
            keys = [*words[::-1], group]  # least significant first; rows come in by document, and the order is stable
            order = radix_order(keys)
            keys, doc = [k[order] for k in keys], doc[order]
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            starts, n, docs = run_counts(new, doc)
            words = [k[starts] for k in keys[-2::-1]]
            second = words[1] if len(words) > 1 else np.zeros(len(starts), np.uint64)
            yield out(keys[-1][starts], words[0], second, pa.array([b""] * len(starts), pa.binary()), n, docs)
        for size in sorted(self.long):
            group, doc, terms = zip(*self.long[size], strict=True)
            group, doc, terms = np.array(group, np.uint64), np.array(doc), np.array(terms, f"S{size}")
            order = np.argsort(terms, kind="stable")
            order = order[np.argsort(group[order], kind="stable")]
            group, doc, terms = group[order], doc[order], terms[order]
            new = np.ones(len(order), bool)
            new[1:] = (terms[1:] != terms[:-1]) | (group[1:] != group[:-1])
            starts, n, docs = run_counts(new, doc)
            zero = np.zeros(len(starts), np.uint64)
            yield out(group[starts], zero, zero, pa.array(terms[starts].tolist(), pa.binary()), n, docs)


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, w1, w2, rest, n, docs) of ``docs`` (lang, source, text): occurrences and documents per chunk of text read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                chunk.add(part)
                if chunk.terms >= CHUNK_TERMS:
                    yield from chunk.counts()
                    chunk.clear()
        yield from chunk.counts()

    return docs.mapInArrow(run, COUNTS)


def term_text() -> Column:
    """The term that the columns w1, w2, rest hold."""
    packed = F.unhex(F.concat(F.lpad(F.hex("w1"), 16, "0"), F.lpad(F.hex("w2"), 16, "0"))).cast("string")
    return F.when(F.length("rest") > 0, F.col("rest").cast("string")).otherwise(F.rtrim(packed, F.lit("\0")))


def share(count: str, total: str, kinds: str = "v") -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kinds)), exact."""
    return F.expr(
        f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(19, 0))) div CAST({total} + 2 * {kinds} AS DECIMAL(20, 0))"
    )


def pair_values(rows: DataFrame, base: DataFrame) -> DataFrame:
    """(lang, a, b, value) for a < b, the numbers of two sources of a language: the sum over all its kept terms.

    ``rows``: lang, source, item, p where the source has the term; ``base``: lang, source, v, p0 (the share of a term it does not have).
    Terms are dealt over groups by a hash, sources over blocks, and every two blocks meet in groups of their own: a group holds about
    GROUP_TERMS terms of at most 2 * BLOCK sources.
    """
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    known = base.select("lang", "source", "v", "p0", number.alias("i"), F.count("*").over(Window.partitionBy("lang")).alias("k"))
    known = known.withColumns({
        "block": F.floor(F.col("i") / BLOCK).cast("int"), "blocks": F.ceil(F.col("k") / BLOCK).cast("int"),
        "parts": F.greatest(F.lit(1), F.ceil(F.col("v") / GROUP_TERMS)).cast("int"),
    })
    met = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks", "k")
    heads = met.select("lang", "lo", "hi", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "i", F.lit(None).cast("string").alias("item"), "p0")
    cells = rows.select("lang", "source", "item", "p").join(met, ["lang", "source"]).select(
        "lang", "lo", "hi", F.pmod(F.xxhash64("item"), "parts").cast("int").alias("part"), "i", "item", F.col("p").alias("p0")
    )

    def sums(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lang, lo, hi, _ = key
        absent = group["item"].isna()
        head = group[absent].sort_values("i")
        ids, floor = head["i"].to_numpy(), head["p0"].to_numpy()
        cell = group[~absent]
        term, _ = pd.factorize(cell["item"])
        place, value = np.searchsorted(ids, cell["i"].to_numpy()), cell["p0"].to_numpy()
        order = np.argsort(term, kind="stable")
        term, place, value = term[order], place[order], value[order]
        left = np.flatnonzero(ids // BLOCK == lo)
        right = left if lo == hi else np.flatnonzero(ids // BLOCK == hi)
        total = np.zeros((len(left), len(right)), np.int64)
        count, step = (int(term[-1]) + 1 if len(term) else 0), 1_024
        for first in range(0, count, step):
            a, b = np.searchsorted(term, [first, first + step])
            shares = np.repeat(floor[None, :], min(step, count - first), 0)
            shares[term[a:b] - first, place[a:b]] = value[a:b]
            for k, x in enumerate(left.tolist()):
                columns = slice(k + 1, None) if lo == hi else slice(None)
                p, q = shares[:, x : x + 1], shares[:, right[columns]]
                total[k, columns] += ((p - q) * (p - q) // (p + q)).sum(0)
        i, j = np.triu_indices(len(left), 1) if lo == hi else map(np.ravel, np.indices(total.shape))
        return pd.DataFrame({"lang": lang, "a": ids[left[i]], "b": ids[right[j]], "value": total[i, j]})

    met_in = cells.union(heads).groupBy("lang", "lo", "hi", "part").applyInPandas(sums, "lang STRING, a INT, b INT, value BIGINT")
    found = met_in.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = found.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("lang", "value", "e.*")
    names = known.select("lang", F.col("i").alias("a"), "source")
    others = known.select("lang", F.col("i").alias("b"), F.col("source").alias("item"))
    return both.join(names, ["lang", "a"]).join(others, ["lang", "b"]).select("lang", "source", "item", "value")


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each (lang, source) how far the other sources of the language are, and its own terms.

    Part ``pair`` holds every other source, part ``term`` the ``top`` kept terms that the source has a larger share of than the language.
    NULL text, lang and source are empty strings; a group without terms has pairs all the same; with no kept term values are 0. Ties
    rank by the bytes of the item. Every row is a document, repeated rows too; an empty table gives an empty one. Other columns are not read.
    """
    rows = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = count_terms(rows).repartition(*WORD).groupBy(*WORD, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy(*WORD)  # one row per source
    kept = counted.withColumns({"all_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "lead": F.min("source").over(term) == F.col("source")})
    kept = shared_table(kept.where(F.col("all_docs") >= min_docs).drop("docs", "all_docs"), "terms")
    in_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    in_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("lead").alias("v"))
    base = rows.select("lang", "source").distinct().join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left")
    base = shared_table(base.na.fill(0, ["total", "lang_total", "v"]).withColumn("p0", F.when(F.col("v") > 0, share("0", "total"))), "groups")
    shares = kept.join(base, ["lang", "source"]).select(
        "lang", "source", term_text().alias("item"), share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q")
    )
    terms = shares.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    pairs = pair_values(shares, base).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).union(first.select(*columns))
