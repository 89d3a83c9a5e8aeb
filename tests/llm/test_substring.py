"""Level-wise doubling against brute force over all windows."""

import hashlib
import re

import numpy as np
import pytest
from weekwise.llm import substring
from weekwise.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window):
    lowest, split = {}, [(d, WORD.findall(t or "")) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if d is not None:
                lowest[key] = min(d, lowest.get(key, d))
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and lowest[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame, window=50):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring.remove_later(frame, window).collect()), key=str)


@pytest.mark.parametrize("window", [4, 7, 50])
def test_odd_texts(docs, window):
    rng = np.random.default_rng(window)
    words = lambda n: [f"é{x}" for x in rng.integers(0, 5000, n)]
    passage, long = words(70), words(900)
    edited = list(long)
    for k in (60, 61, 200, 480, 700):
        edited[k] = "EDIT"
    texts = ["", None, "one two", "one two", " ".join(long), "\n".join(edited), "\t".join(words(9) + passage + words(8)), " ".join(passage + passage), " ".join(words(3) + passage[:50]),
             " ".join(passage[10:59]), "a " * 300, "a " * 49, "a b " * 200, " ".join(long[100:400] + passage), " ".join(passage), " ".join(long).upper()]
    ids = [5, 6, 7, 8, 40, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20]
    rows = list(zip(ids, texts, strict=True))
    assert got(docs(texts, ids), window) == plain(rows, window)
    more = [(10, texts[5]), (10, texts[5]), (None, texts[4]), (None, texts[4]), (3, " ".join(passage)), (2, texts[4])]
    assert got(docs([t for _, t in more], [i for i, _ in more]), window) == plain(more, window)
    assert got(docs([]), window) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows, 50)
    assert sorted(map(tuple, QUERIES["op5_substring_dedup"](spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == want
    assert sum(x[2] for x in want) > 0
