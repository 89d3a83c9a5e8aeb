"""Entropy balancing against targets and dual variables found plainly, and the promises of the rounding."""

import math
import re
from collections import defaultdict

import pytest

from weekwise.llm import mixing
from weekwise.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, source string, size string, target int, s int, number int"


def plain_targets(total, share=1.5, cap=2, weights=(3, 1, 2)):
    """Targets of sources -> size, dealt in rounds."""
    order = sorted((s for s in total if s is not None), key=str.encode) + [s for s in total if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, open_ = {}, share * sum(total.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > cap * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: float(cap * total[s]) for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def plain_tilt(sizes, target, cap=2):
    mean = sum(sizes) / len(sizes)

    def taken(t):
        return sum(cap * x / (1 + (cap - 1) * math.exp(-max(min(t * x / mean, 700), -700))) for x in sizes)

    low, high = -1e6, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if taken(middle) < target else (low, middle)
    return lambda x: cap / (1 + (cap - 1) * math.exp(-max(min(low * x / mean, 700), -700)))


def check(found, texts):
    size = [len(WORD.findall(t or "")) for t, _ in texts]
    held = defaultdict(list)
    for (_, s), n in zip(texts, size):
        held[s].append(n)
    target = plain_targets({s: sum(v) for s, v in held.items()})
    assert sorted(r.size for r in found) == sorted(size) and len(found) == len(texts)
    taken = defaultdict(int)
    rate = {s: plain_tilt([x for x in v if x], target[s]) if any(v) and target[s] < 2 * sum(v) - 1e-9 else None for s, v in held.items()}
    for r in found:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        assert r.source_size == sum(held[r.source]) and r.target == pytest.approx(target[r.source], abs=1e-6)
        if r.size:
            mean_of = [x for x in held[r.source]]
            assert 0 <= r.rate <= 2
            if rate[r.source] is None:
                assert r.copies == 2
            elif all(mean_of):
                assert r.rate == pytest.approx(rate[r.source](r.size), abs=1e-4)
        taken[r.source] += r.taken
    return taken, target, held


def build(spark, texts):
    return spark.createDataFrame([(i, t, s, "x", 1, 2, 3) for i, (t, s) in enumerate(texts)], DOCS)


def corpus():
    texts = []
    for k in range(900):
        source = ["a", "b", "ç", None, "z", "dd"][min(k % 13, 5)]
        texts.append((" ".join(["w"] * (1 + (k * k * 31) % 97 + (400 if k % 50 == 0 else 0))), source))
    return texts


def test_against_plain(spark):
    texts = corpus()
    first = mixing.mix(build(spark, texts)).collect()
    taken, target, held = check(first, texts)
    for s in target:
        assert abs(taken[s] - target[s]) <= max(2, 0.002 * target[s]), s
    again = mixing.mix(build(spark, texts).repartition(7)).collect()
    assert sorted(first, key=lambda r: r.doc_id) == sorted(again, key=lambda r: r.doc_id)


def test_segments(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SEGMENT", 60)
    taken, target, _ = check(mixing.mix(build(spark, corpus())).collect(), corpus())
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 5 for s in target)


def test_odd_rows(spark):
    assert mixing.mix(build(spark, [])).collect() == []
    nothing = mixing.mix(build(spark, [(None, None), ("", "a"), (" \n", "a")])).collect()
    assert all(r.taken == 0 and r.target == 0 for r in nothing) and len(nothing) == 3
    texts = [("one two", "a")] * 50 + [(None, "a"), ("x " * 20_000, "b"), ("y", "b"), ("q r s", None), ("q r s", None)]
    found = mixing.mix(build(spark, texts)).collect()
    check(found, texts)
    ids = spark.createDataFrame([(None, "a b", "s", "x", 1, 2, 3)] * 4, DOCS)
    assert sum(r.taken for r in mixing.mix(ids).collect()) == 12


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op11_source_mixing"](spark, sf).collect()
    assert {r.doc_id: r.size for r in found} == {i: len(WORD.findall(t or "")) for i, (t, _) in texts.items()}
    total = defaultdict(int)
    for t, s in texts.values():
        total[s] += len(WORD.findall(t or ""))
    target, taken = plain_targets(total), defaultdict(int)
    for r in found:
        source = texts[r.doc_id][1]
        taken[source] += r.taken
        assert r.source_size == total[source] and r.target == pytest.approx(target[source]) and r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 20 for s in target)
