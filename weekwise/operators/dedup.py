"""Deduplication, priority picks, top-k and unions.

The winner of each key is ``row_number() = 1``: Spark keeps one row per key and task before the shuffle, so a
key with a huge number of copies never lands in one task. Ties on ``order`` go to the row with fewer NULLs, then
by the remaining columns with NULLs last, which makes the result repeatable and never prefers a missing value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._util import as_list, col


def _columns(order) -> list[Column]:
    return [col(o) if isinstance(o, str) else o for o in ([order] if isinstance(order, (str, Column)) else order)]


def _ties(df: DataFrame, keys, ties, order_of) -> list[Column]:
    if ties is not None:
        return [order_of(c) for c in _columns(ties)]
    rest = [f.name for f in df.schema if f.name not in keys and f.dataType.typeName() not in ("map", "variant")]
    if not rest:
        return []
    nulls = reduce(lambda a, b: a + b, [col(c).isNull().cast("int") for c in rest])
    return [nulls.asc(), *[order_of(col(c)) for c in rest]]


def _winner(df: DataFrame, keys, ranks: list[Column]) -> DataFrame:
    w = Window.partitionBy(*map(col, as_list(keys))).orderBy(*ranks)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedup_last(df: DataFrame, keys, order, ties=None) -> DataFrame:
    """The row of each key that comes last in ``order`` (NULL order values count as earliest).

    ``ties`` (columns, the last wins, NULLs lose) replaces the default order of equal rows.
    """
    return _winner(df, keys, [c.desc_nulls_last() for c in _columns(order)] + _ties(df, as_list(keys), ties, Column.desc_nulls_last))


def dedup_first(df: DataFrame, keys, order, ties=None) -> DataFrame:
    """The row of each key that comes first in ``order`` (NULL order values count as latest).

    ``ties`` (columns, the first wins, NULLs lose) replaces the default order of equal rows.
    """
    return _winner(df, keys, [c.asc_nulls_last() for c in _columns(order)] + _ties(df, as_list(keys), ties, Column.asc_nulls_last))


def pick_by_priority(df: DataFrame, keys, priority: str, cond: Column | None = None) -> DataFrame:
    """Per key the row with the lowest priority number among those that satisfy ``cond``."""
    return dedup_first(df if cond is None else df.where(cond), keys, priority)


def dedup_alerts(df: DataFrame, keys=("chunk_key", "identifier"), order=("path", "info_pos")) -> DataFrame:
    """One row per alert and chunk: the last file's last info block."""
    return dedup_last(df, list(keys), list(order))


def concat_latest(parts: Sequence[DataFrame] | DataFrame, keys, order) -> DataFrame:
    """Union of several extracts of one feed, keeping for each key the row of the latest extract."""
    return dedup_last(parts if isinstance(parts, DataFrame) else union_panels(parts), keys, order)


def append_mapped(hist: DataFrame, new: DataFrame, mapping: dict[str, str], keys) -> DataFrame:
    """Append ``new``, renamed by ``mapping`` to the historical schema; its rows win on the key.

    Columns the new source lacks become NULL, columns the history lacks are dropped.
    """
    renamed = new.withColumnsRenamed(mapping)
    shaped = renamed.select(
        *[(col(c) if c in renamed.columns else F.lit(None)).cast(hist.schema[c].dataType).alias(c) for c in hist.columns]
    )
    both = hist.withColumn("__src", F.lit(0)).unionByName(shaped.withColumn("__src", F.lit(1)))
    return dedup_last(both, keys, "__src").drop("__src")


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """First ``k`` rows; ``order`` must end in a unique key."""
    return df.orderBy(*order).limit(k)


def union_panels(frames: Sequence[DataFrame], allow_missing: bool = True) -> DataFrame:
    """Union by name of panels with (nearly) the same schema."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)
