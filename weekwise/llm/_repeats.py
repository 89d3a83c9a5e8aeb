"""Where equal windows can meet: content-defined anchors, blocks of window starts, and filters of fixed size.

Every window of ``window`` symbols has one anchor, the leftmost smallest hash among its grams of ``gram`` symbols, so equal windows have
equal anchors at equal offsets. The offsets are cut into a fixed grid; all windows of an anchor and one grid block share a core, and
only rows with an equal core need to meet. Rows are one per block, about 2 * (starts / block) + 1 per anchor, never one per symbol.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ._common import mix, span_hash

POSITION_BITS = 28  # positions in a slice; the rest of a sort key is hash, and ties go to the left whatever its width
FILTER_BITS = 26  # 8 MB of bits in a task whatever the input; more false hits only cost work


class Runs(NamedTuple):
    """Anchor position and its first and last window start, for each anchor of each document (all counted in the slice)."""

    doc: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray


class Blocks(NamedTuple):
    """Document, grid block, first start and number of starts; core: 64-bit hash that equal windows share; variant: hash of all of it."""

    doc: np.ndarray
    start: np.ndarray
    starts: np.ndarray
    core: np.ndarray
    variant: np.ndarray


def anchor_runs(prefix: np.ndarray, begins: np.ndarray, ends: np.ndarray, gram: int, window: int) -> Runs:
    """Anchors of all windows inside the documents [begins, ends) of a slice with prefix hashes ``prefix``."""
    n, none = len(prefix) - 1, np.zeros(0, np.int64)
    if n < window:
        return Runs(none, none, none, none)
    at = np.arange(n - gram + 1)
    key = span_hash(prefix, at, at + gram) >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS) | at.astype(np.uint64)
    width, wanted = 1, window - gram + 1
    while width * 2 <= wanted:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < wanted:
        key = np.minimum(key[: len(key) - (wanted - width)], key[wanted - width :])
    anchor = (key & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    # a start is of a document if its whole window is
    counts = np.maximum(ends - begins - window + 1, 0)
    doc = np.repeat(np.arange(len(begins)), counts)
    start = np.arange(len(doc)) + np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    own = anchor[start]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else none
    last = np.concatenate([new[1:], [len(doc)]]) - 1 if len(new) else none
    return Runs(doc[new], own[new], start[new], start[last])


def gram_keys(prefix: np.ndarray, runs: Runs, gram: int) -> np.ndarray:
    return span_hash(prefix, runs.at, runs.at + gram)


def offset_blocks(prefix: np.ndarray, runs: Runs, gram: int, window: int, grid: int) -> Blocks:
    """Cut the starts of each anchor along the grid of offsets."""
    low, high = runs.at - runs.last, runs.at - runs.first
    first, pieces = low // grid, high // grid - low // grid + 1
    row = np.repeat(np.arange(len(low)), pieces)
    block = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = runs.at[row]
    near, far = block * grid, np.minimum(block * grid + grid - 1, window - gram)
    lo, hi = np.maximum(low[row], near), np.minimum(high[row], far)
    core = mix(span_hash(prefix, at - near, at - far + window) + block.astype(np.uint64))
    shape = (lo - near).astype(np.uint64) * np.uint64(window + 1) + (hi - near).astype(np.uint64)
    variant = mix(span_hash(prefix, at - hi, at - lo + window) + shape)
    return Blocks(runs.doc[row], at - hi, hi - lo + 1, core, variant)


def bit_filter(keys: DataFrame, column: str = "key") -> np.ndarray:
    """Bits set for the (already mixed) hashes in ``column``: built by an aggregate into at most 2**FILTER_BITS / 64 rows."""
    bit = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = keys.select(bit.alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("w")
    ).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[words["i"].to_numpy()] = words["w"].to_numpy()
    return out.view(np.uint64)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    b = keys & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)


def covered(size: int, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Which of ``size`` symbols lie in a window that starts in one of the ranges first..last."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(last + window, size), -1)
    return np.cumsum(step[:size]) > 0


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
