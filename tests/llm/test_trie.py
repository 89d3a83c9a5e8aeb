"""The prefix trie against one built node by node from whole sequences of turns."""

import hashlib
import random
import zlib

import pytest

from weekwise.llm import trie
from weekwise.operators import scan

TURNS = "conv_id bigint, turn bigint, role string, text string, d int, b int, pos string, h int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
    return out


def plain(rows):
    """Every node with its members; subtree sums by visiting all nodes below."""
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        parents = {x[:-1] for x in members if x}
        ends = sorted(c for c in own if len(convs[c]) == len(node))
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), sum(len(x) == len(node) + 1 for x in below),
            sum(x not in parents for x in below), sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], TURNS)
    ids, turns = trie.with_shared_heads(trie.ordered_turns(df))
    return sorted((tuple(r) for r in trie.prefix_trie(ids, turns, **kw).select(*COLUMNS).collect()), key=str)


def conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 60), *range(100, 112), 305, 306, 450, -7, -205, 10**15 + 1, 10**15]:
        begin = rng.choice([[], ["hello", "é" * 5], ["hello", "é" * 5, "x", None, "y", "z"]])
        tail = [rng.choice(["a", "b", "", "long " * 50]) for _ in range(rng.choice([0, 1, 3, 9, 30]))]
        rows += [(c, k if k != 2 else None, ["user", "assistant", None][k % 3], t) for k, t in enumerate(begin + tail)]
    rows += [(7, 1, "user", "again")] * 3 + [(None, 0, "user", "lost"), (100, None, None, None), (450, 0, "u", "x" * 100_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4, 1, 7])
def test_against_plain(spark, block):
    assert found(spark, conversations(), block=block) == plain(conversations())


def test_cut_conversations(spark, monkeypatch):
    """Conversations of more rows than a range are placed and summed range by range."""
    rng = random.Random(9)
    rows = [(c, k, "u", "same" if c < 3 else rng.choice("ab")) for c in range(5) for k in range(120)]
    monkeypatch.setattr(scan.Series.__init__, "__defaults__", ((), 20))
    for name in ("row_numbers", "running_sums"):
        monkeypatch.setattr(getattr(scan, name), "__defaults__", tuple(20 if x == scan.ROWS else x for x in getattr(scan, name).__defaults__))
    assert found(spark, rows) == plain(rows)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "u", "x")]) == []
    assert found(spark, [(301, 1, "u", "x")] * 2) == plain([(301, 1, "u", "x")] * 2)
    copies = [(c, k, "u", f"t{k}") for c in range(0, 3000, 100) for k in range(6)]
    assert found(spark, copies) == plain(copies)
