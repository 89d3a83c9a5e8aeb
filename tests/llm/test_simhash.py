"""SimHash near-duplicates against brute force over all pairs."""

import re

import numpy as np
import pytest
import xxhash
from weekwise.llm import simhash
from weekwise.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    """(doc_id, fp) -> smallest doc_id reachable."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    values = np.array([p for _, p in prints], np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            parent[root(int(j))] = root(i)
    low = {}
    for i, (d, _) in enumerate(prints):
        low[root(i)] = min(low.get(root(i), d), d)
    return [low[root(i)] for i in range(len(prints))]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 7])
def test_within(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(700)], np.uint64)
    values = np.unique(np.concatenate([base[rng.integers(0, 5, 700)] ^ flips, rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    near = simhash.within(simhash.planes(values), values, radius)
    got = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, : len(values)].astype(bool)
    assert (got == (np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)).all()


def test_chains_and_split_groups(spark, monkeypatch):
    rng = np.random.default_rng(1)
    chain = [int(rng.integers(0, 1 << 63))]
    for _ in range(40):  # each two or three bits from the one before
        chain.append(chain[-1] ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    ball = [chain[7] ^ (1 << int(a)) ^ (1 << int(b)) for a in range(20) for b in range(20, 40)]
    values = sorted({*chain, *ball, *map(int, rng.integers(0, 1 << 63, 200))})
    frame = spark.createDataFrame([(v if v < 1 << 63 else v - (1 << 64),) for v in values], "fp bigint")
    want = plain_components(list(enumerate(values)))
    for chunk in (16_384, 64):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        roots = {r.a: r.root for r in simhash.components(simhash.linked_pairs(frame)).collect()}
        signed = [v if v < 1 << 63 else v - (1 << 64) for v in values]
        groups = {}
        for v, c in zip(signed, want, strict=True):
            groups.setdefault(c, set()).add(roots.get(v, v))
        assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_odd_texts(docs):
    texts = ["", None, " ", "One", "one", "a b", "A B c d", "a b c d", "Ä b c", "x " * 3000, "same text of words here", "same text of words here"]
    ids = [9, 3, 5, 1, 2, 4, 6, 7, 8, 10, 11, 11]
    got = sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs(texts, ids)).collect())
    prints = [(i, plain_print(t)) for i, t in zip(ids, texts, strict=True)]
    assert got == sorted((i, p, c) for (i, p), c in zip(prints, plain_components(prints), strict=True))
    assert simhash.near_duplicates(docs([])).count() == 0
    assert sorted(map(tuple, simhash.near_duplicates(docs(["q w e"] * 2, [None, None])).select("doc_id", "component_id").collect())) == [(None, None)] * 2


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    prints = sorted((r.doc_id, plain_print(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in QUERIES["op6_simhash_near_dedup"](spark, sf).select("doc_id", "fingerprint", "component_id").collect())
    assert got == [(d, f"{p:016x}", c) for (d, p), c in zip(prints, plain_components(prints), strict=True)]


def test_one_of_each_keeps_columns_of_any_name(spark):
    """Columns called like those the operator works with stay as they are; repeats of the kept row are one row."""
    rows = [(1, "a b c d", "x", 7, 0), (1, "a b c d", "x", 7, 0), (2, "a b c d", "y", 8, 1), (3, "something else altogether here now", "z", 9, 2), (None, "", "n", 1, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __own string, __text int, own int")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, [df.collect()[k] for k in (0, 3, 4)]))
    assert simhash.one_of_each(df.limit(0)).count() == 0
