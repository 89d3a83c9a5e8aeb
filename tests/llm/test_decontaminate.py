"""Decontamination against a search for every window in every document."""

import hashlib
import re

import pytest
from weekwise.llm import decontaminate
from weekwise.llm.registry import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(texts, items, size=10):
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i) if i is not None else None)
    lengths = {len(w) for w in windows}
    out = []
    for d, t in texts:
        words, hit, found = split(t), set(), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                if own := windows.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((d, len(words), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=str)


def got(docs, items, **kw):
    return sorted((tuple(r) for r in decontaminate.contamination(docs, items, **kw).select("doc_id", "n_words", "n_hit", "items").collect()), key=str)


def test_odd_cases(spark, docs):
    ten = "one two three four five six seven eight nine ten"
    items = [(1, ten), (2, "one two three four five six seven eight nine ten eleven twelve"), (3, "short item"), (4, ""), (5, None), (6, ten), (7, "the"), (10, "a a a a a a a a a a a")]
    texts = ["", None, ten.upper(), "x " + ten + " y", "One-two, three! four five six seven eight nine ten eleven twelve", "short; item", "short an item", "nine ten " + ten,
             "the the é", "a " * 13, ten, "q" * 100000, " ".join(f"w{i}" for i in range(3000)) + " Short Item", ten]
    ids = [*range(13), 12]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, word string, row int")
    assert got(docs(texts, ids), frame) == plain(list(zip(ids, texts, strict=True)), items)
    assert got(docs(texts, ids), frame.limit(0)) == plain(list(zip(ids, texts, strict=True)), [])
    assert got(docs([]), frame) == []
    assert got(docs([ten], [None]), frame) == plain([(None, ten)], items)


@pytest.mark.parametrize("size", [1, 3, 10])
def test_query(spark, size):
    sf = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain(texts, items, size)
    if size != 10:
        frames = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
        assert got(*frames, size=size) == want
    else:
        rows = QUERIES["op8_benchmark_decontamination"](spark, sf).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == {
            d: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in want
        }
        assert any(r.contaminated for r in rows)
