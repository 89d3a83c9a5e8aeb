"""Suffix arrays against plain sorting, and removal of repeated strings against brute force over all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from weekwise.llm import _repeats, suffix_array
from weekwise.llm.registry import QUERIES


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30) | st.text("abc", min_size=1, max_size=9), min_size=1, max_size=6))
def test_array_and_prefixes(parts):
    s = np.frombuffer(b"".join(p.encode() + b"\xff" for p in parts), np.uint8) + np.uint8(1)
    ends = np.flatnonzero(s == 0)
    # the zeros are different letters, smaller than all others and ordered by position
    letters = [(int(c), 0) if c else (0, int(np.searchsorted(ends, i))) for i, c in enumerate(s)]
    want = sorted(range(len(s)), key=lambda i: letters[i:])
    got = suffix_array.suffix_array(s)
    assert got.tolist() == want
    lcp = suffix_array.common_prefixes(s, got).tolist()
    for k, (i, j) in enumerate(zip(want, want[1:], strict=False), 1):
        n = 0
        while letters[i + n] == letters[j + n]:
            n += 1
        assert lcp[k] == n


def plain(texts, window):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - window + 1):
            if counts[r[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(n))


@pytest.mark.parametrize("hot", [1500, 1])
def test_odd_texts(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_array, "HOT_VARIANTS", hot)
    rng = np.random.default_rng(5)
    passage, long = words(rng, 120), words(rng, 3000)
    edited = long.split(" ")
    for k in (200, 700, 1500, 1501, 2600):
        edited[k] = "EDIT"
    texts = ["", None, "short", "short", "x" * 399, "x" * 399, "y" * 400, "y" * 401, "z" * 5000, "ab" * 600, words(rng, 50) + passage + words(rng, 60), passage, words(rng, 10) + passage,
             long, " ".join(edited), long[:9000], "w" + passage[:398], "v" + passage[:400], passage[5:] + "tail", long[300:800] + "|" + long[300:800], passage.upper()]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_array.remove_repeats(docs(texts)).collect())
    assert got == [(i, *x) for i, x in enumerate(plain(texts, 400))]
    again = sorted((r.n_bytes, r.n_removed) for r in suffix_array.remove_repeats(docs(["q" * 10, "q" * 10, passage, passage], [None, None, 7, 7])).collect())
    assert again == sorted([(10, 0), (10, 0)] + [(len(passage.encode()),) * 2] * 2)
    assert suffix_array.remove_repeats(docs([])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(map(tuple, QUERIES["op3_suffix_array_dedup"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == [(i, *x) for (i, _), x in zip(texts, plain([t for _, t in texts], 400), strict=True)]
    assert sum(g[2] for g in got) > 0


def test_full_filter(docs, monkeypatch):
    """However full the filter is, one block of each variant of a mixed group is sorted and no copy of it."""
    rng = np.random.default_rng(11)
    long, other = words(rng, 700), words(rng, 700)
    edited = long.split(" ")
    edited[300] = "EDIT"
    texts = [long] * 30 + [other] * 30 + [" ".join(edited), words(rng, 20) + long[500:1500]]
    tables, written = {}, suffix_array.shared_table

    def keep(df, name):
        tables[name] = written(df, name)
        return tables[name]

    monkeypatch.setattr(suffix_array, "shared_table", keep)
    monkeypatch.setattr(_repeats, "FILTER_BITS", 6)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_array.remove_repeats(docs(texts)).collect())
    assert got == [(i, *x) for i, x in enumerate(plain(texts, 400))]
    pieces = sorted((r.core, r.variant) for r in tables["pieces"].collect())
    assert pieces == sorted((r.core, r.variant) for r in tables["variants"].where("kinds > 1").collect())
