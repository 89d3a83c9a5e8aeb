"""Source divergence against counts and sums written out plainly."""

import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from weekwise.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, item string, w1 int"


def plain(docs, min_docs, top=10):
    """Rows as (lang, source, part, item, value, rank)."""
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        held[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        every = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(every)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def found(spark, docs, **kw):
    df = spark.createDataFrame([(i, *d, "x", 1) for i, d in enumerate(docs)], DOCS)
    return sorted(tuple(r) for r in divergence.source_divergence(df, **kw).collect())


def documents(sources=4):
    """Short, two-word and long terms, ties, repeated rows, NULLs, a group and a language without terms, a very long term."""
    rng = np.random.default_rng(5)
    terms = ["a", "B", "abcdefgh", "abcdefghi", "ABCDEFGHIJKLMNOP", "abcdefghijklmnopq", "abcdefghijklmnopr", "é", "ñandúñandú", "日本語日本語日本語", "x" * 300]
    rows = []
    for k in range(120):
        words = rng.choice(terms, rng.integers(0, 12), p=np.arange(11, 0, -1) / 66)
        rows.append((" ".join(words) + "-1_" + words[0] if len(words) else "", ["en", "de", None][k % 3], f"s{k % sources}" if k % 7 else None))
    return rows + [rows[5]] * 3 + [("123 !?", "en", "bare"), (None, "xx", "p"), ("word", "xx", "q"), ("y" * 200_000 + " a", "en", "s0"), ("", "", "")]


def test_against_plain(spark):
    docs = documents()
    assert found(spark, docs, min_docs=3) == plain(docs, 3)
    assert found(spark, docs) == plain(docs, 10)
    assert found(spark, docs, min_docs=3, top=2) == plain(docs, 3, 2)
    assert found(spark, []) == []


def test_blocks_and_chunks(spark, monkeypatch):
    """Blocks of sources, groups of terms and chunks of text change nothing."""
    docs = documents(9)
    want = plain(docs, 2)
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "GROUP_TERMS", 3)
    monkeypatch.setattr(divergence, "CHUNK_TERMS", 10)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 40)
    assert found(spark, docs, min_docs=2) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 2**64 - 1) | st.integers(0, 5)] * 2), max_size=40))
def test_radix_order(pairs):
    low, high = (np.array([p[i] for p in pairs], np.uint64) for i in (0, 1))
    assert divergence.radix_order([low, high]).tolist() == sorted(range(len(pairs)), key=lambda i: (pairs[i][1], pairs[i][0]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=16).map(lambda b: bytes(x or 1 for x in b)), min_size=1, max_size=20))
def test_packed_order_is_byte_order(terms):
    data, sizes = np.frombuffer(b" ".join(terms), np.uint8), np.array([len(t) for t in terms])
    start = np.cumsum(sizes + 1) - sizes - 1
    w1, w2 = divergence.pack_terms(data, start, sizes)
    assert [a.to_bytes(8, "big") + b.to_bytes(8, "big") for a, b in zip(w1.tolist(), w2.tolist())] == [t.ljust(16, b"\0") for t in terms]
    assert [terms[i] for i in divergence.radix_order([w2, w1])] == sorted(terms)
