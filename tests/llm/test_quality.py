"""Quality rules against counts written out plainly; the order of the cascade never changes a verdict."""

import re
from collections import Counter

from weekwise.llm import quality
from weekwise.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    threes = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(threes)
    covered = {i + k for i, t in enumerate(threes) if counts[t] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


ODD = [
    "", None, "\n \n\t", "a b c a b c a b c", "é ü ñ x\n" * 30, " ".join(f"w{i}" for i in range(60)), "x\ry\x0bz\x0c" * 40, "a " * 9,
    " ".join(f"w{i} |" for i in range(60)), "\n".join(f"- item number{i} goes on" for i in range(30)), " ".join(f"{i}" for i in range(99)),
    "\n".join(f"line {i} word{i} other{i}..." for i in range(40)), " ".join(f"the w{i}" for i in range(60)), "y" * 100000, ("dup line here\n" * 3 + "one two three four five six\n") * 2,
]


def test_counts_and_verdicts(docs):
    names = list(quality.RULES)
    first = {r.doc_id: r for r in quality.quality_rules(docs(ODD), order=names).collect()}
    again = {r.doc_id: r for r in quality.quality_rules(docs(ODD), order=names[::-1]).collect()}
    assert first == again
    for i, text in enumerate(ODD):
        r = first[i]
        assert tuple(r)[1:7] == plain(text), text
    kept = {i for i, r in first.items() if r.kept}
    assert kept == {5}


def test_query(spark, docs):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op7_quality_rules"](spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in found} == {i: plain(t) for i, t in texts.items()}
    priced = quality.price_rules(docs(list(texts.values())))
    assert {x[0] for x in priced} == set(quality.RULES) and all(x[1] >= 0 and 0 <= x[2] <= 1 for x in priced)
    assert quality.quality_rules(docs([])).count() == 0
    assert quality.quality_rules(docs(["a", "a"], [None, None])).count() == 2
