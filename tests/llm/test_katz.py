"""The language model against dictionaries of counts, and its distributions against one."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from weekwise.llm import katz
from weekwise.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lowered), None]


class Plain:
    """The same model over dictionaries."""

    def __init__(self, texts):
        self.c, self.pairs = Counter(), Counter()
        for t in texts:
            seq = tokens(t)
            self.c.update(seq)
            self.pairs.update(zip(["<start>", *seq[:-1]], seq, strict=True))
        self.n, self.v = sum(self.c.values()), len(self.c)
        kinds = Counter(min(x, katz.TOP + 2) for x in self.c.values())
        self.words = katz.word_model(self.n, self.v, [0] + [kinds[r] for r in range(1, katz.TOP + 2)])
        kinds = Counter(min(x, katz.TOP + 2) for x in self.pairs.values())
        self.factor = katz.discounts([0] + [kinds[r] for r in range(1, katz.TOP + 2)])
        self.after = {}
        for (u, w), n in self.pairs.items():
            self.after.setdefault(u, {})[w] = n

    def p1(self, w):
        return float(self.words.p(np.array([self.c[w]]))[0])

    def p(self, w, u):
        seen = self.after.get(u)
        if not seen:
            return self.p1(w)
        total = sum(seen.values())
        d = lambda n: self.factor[min(n, katz.TOP + 1)]
        left = sum((1 - d(n)) * n for n in seen.values())
        if left <= 0:
            total, left = total + 1, 1.0
        if w in seen:
            return d(seen[w]) * seen[w] / total
        return left / total * self.p1(w) / (1 - sum(self.p1(x) for x in seen))

    def row(self, text):
        seq = tokens(text)
        base = sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in seq)
        full = sum(math.log10(self.p(w, u)) for u, w in zip(["<start>", *seq[:-1]], seq, strict=True))
        return len(seq), sum(self.c[w] > 0 for w in seq), self.n, base, full


def close(got, want):
    return got[:3] == want[:3] and all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got[3:], want[3:], strict=True))


def texts_of(seed, n):
    rng = np.random.default_rng(seed)
    return [" ".join(f"W{x}" for x in np.minimum(rng.zipf(1.4, rng.integers(0, 60)), 3000)) for _ in range(n)] + ["the " * 3000, "", None, "É é A a", "\t\n"]


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_against_dictionaries(spark, docs, monkeypatch, size):
    monkeypatch.setattr(katz, "BATCH_BYTES", 4 * size)
    monkeypatch.setattr(katz, "BUCKET_BYTES", 8 * size)
    monkeypatch.setattr(katz, "HOT", 20)
    # several batches to a shelf, and row groups that hold parts of a batch
    monkeypatch.setattr(katz, "SHELVES", 2)
    monkeypatch.setattr(katz, "SHELF_BATCHES", 3)
    monkeypatch.setattr(katz, "ROW_GROUP_BYTES", 4 * size)
    texts = texts_of(4, 150)
    held = [i % 5 == 2 for i in range(len(texts))]
    model = katz.fit(docs(texts), F.col("doc_id") % 5 == 2)
    assert len(model.hot) > 2
    plain = Plain([t for t, h in zip(texts, held, strict=True) if not h])
    rows = {r.doc_id: tuple(r) for r in katz.score(model).collect()}
    for i, (t, h) in enumerate(zip(texts, held, strict=True)):
        assert rows[i][1] == h and close(rows[i][2:], plain.row(t)), i
    # every distribution sums to one over the known words and the unknown one
    for u in [*list(plain.after)[:40], "never seen"]:
        assert math.isclose(sum(plain.p(w, u) for w in [*plain.c, "never seen"]), 1, rel_tol=1e-9)
    # the stored tables hold the same counts and weights
    stored = model.work2.where("kind = 'pairs'").select(F.explode(F.arrays_zip("ids", "others", "counts")).alias("p")).select("p.*").collect()
    assert sorted(r.counts for r in stored) == sorted(plain.pairs.values())
    weights = sorted(r.alpha for r in katz.backoff_weights(model).collect())
    assert len(weights) == len(plain.after)
    want = []
    for u, seen in plain.after.items():
        w = "never seen"
        want.append(plain.p(w, u) / plain.p1(w))
    assert np.allclose(weights, sorted(want))


@pytest.mark.parametrize("texts", [[], [None], ["a"], ["a a a"] * 5, ["q w e r t y"]])
def test_small_corpora(docs, texts):
    for none_held in (True, False):
        held = F.lit(not none_held)
        rows = [tuple(r) for r in katz.score(katz.fit(docs(texts), held)).collect()]
        plain = Plain(texts if none_held else [])
        assert len(rows) == len(texts)
        assert all(close(r[2:], plain.row(t)) for r, t in zip(sorted(rows), texts, strict=True))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    plain = Plain([t for i, t in rows if not held[i]])
    got = {r.doc_id: tuple(r) for r in QUERIES["op2_katz_scoring"](spark, sf).collect()}
    assert len(got) == len(rows) and all(got[i][1] == held[i] and close(got[i][2:], plain.row(t)) for i, t in rows)
    # on texts that it has not seen, pairs tell more than words alone
    assert sum(r[6] for r in got.values() if r[1]) > sum(r[5] for r in got.values() if r[1])
