"""Exact order statistics that no single task has to hold: cumulative counts, quantiles, ranks.

``F.percentile`` keeps every distinct value of a group in one task, and ``rank()`` sorts a whole group
in one task. For groups without a size bound the operators here work on a *ladder* instead: the
distinct values with their counts, cut into value ranges of similar size. Each group has cuts of its own
(``cuts.py``), which only decide which task handles which range, so the result is exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._util import as_list, col, join_nullsafe
from .cuts import RANGES, group_cuts, with_range

ROWS_PER_RANGE = 10_000  # distinct values from which on a group is cut into ranges


def ladder(
    df: DataFrame, value: str, by=(), counts: Mapping[str, Column] | None = None,
    descending: bool = False, ranges: int = RANGES,
) -> DataFrame:
    """Distinct values per group with counts, the cumulative counts *before* each value, and totals.

    ``counts`` names the counted measures (default ``n`` = rows) as aggregate Columns. Output columns:
    keys, value, and for each measure ``m``: ``m``, ``m_before``, ``m_total``. NULL values are left out.
    """
    keys = as_list(by)
    measures = dict(counts or {"n": F.count("*")})
    rows = df.where(col(value).isNotNull()).groupBy(*map(col, keys), col(value)).agg(
        *[m.alias(name) for name, m in measures.items()]
    )
    # The cuts are taken from the aggregated rows, and read all their columns, so that the exchange of
    # that aggregate is planned once and reused: the input is scanned a single time.
    present = sum((F.col(m) for m in measures), F.lit(0)) > 0
    rows = with_range(rows, value, group_cuts(rows.where(present), value, keys, ROWS_PER_RANGE, ranges), keys, ranges=ranges)
    if descending:
        rows = rows.withColumn("__range", -F.col("__range"))
    per_range = rows.groupBy(*map(col, keys), "__range").agg(*[F.sum(m).alias(f"__s_{m}") for m in measures])
    # at most ``ranges`` rows per group from here on
    across = Window.partitionBy(*map(col, keys)) if keys else Window.partitionBy(F.lit(1))
    running = across.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *map(col, keys), "__range",
        *[F.coalesce(F.sum(f"__s_{m}").over(running), F.lit(0)).alias(f"__o_{m}") for m in measures],
        *[F.sum(f"__s_{m}").over(across).alias(f"{m}_total") for m in measures],
    )
    order = col(value).desc() if descending else col(value).asc()
    inside = (
        Window.partitionBy(*map(col, keys), "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return join_nullsafe(rows, offsets, [*keys, "__range"], "inner").select(
        *map(col, keys), col(value), *measures,
        *[(F.col(f"__o_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"{m}_before") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def quantiles(
    df: DataFrame, value: str, qs: Mapping[str, float], by=(), bounded: bool = False
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one named column each.

    ``bounded=True`` says that every group is small by construction (the weeks of one entity) and uses
    the built-in aggregate; otherwise the ladder is used.
    """
    keys = as_list(by)
    if bounded:
        return df.groupBy(*map(col, keys)).agg(*[F.percentile(col(value), q).alias(name) for name, q in qs.items()])
    steps = ladder(df, value, keys)
    aggs = []
    for name, q in qs.items():
        pos = (F.col("n_total") - 1) * F.lit(float(q))
        at_low = (F.col("n_before") <= F.floor(pos)) & (F.floor(pos) < F.col("n_before") + F.col("n"))
        at_high = (F.col("n_before") <= F.ceil(pos)) & (F.ceil(pos) < F.col("n_before") + F.col("n"))
        low, high = F.max(F.when(at_low, col(value))), F.max(F.when(at_high, col(value)))
        frac = F.max(pos - F.floor(pos))
        aggs.append((low + (high - low) * frac).alias(name))
    return steps.groupBy(*map(col, keys)).agg(*aggs)


def quantile_scalar(df: DataFrame, value: str, q: float) -> Column:
    """One exact quantile of a whole column as a scalar-subquery Column."""
    return quantiles(df, value, {"v": q}).scalar()


def average_ranks(df: DataFrame, value: str, name: str, by=()) -> DataFrame:
    """Add the average rank (ties share it) of a value within its group.

    The lookup side has one row per distinct value, so a value that fills a third of the table only
    makes AQE split the row side.
    """
    keys = as_list(by)
    ranks = ladder(df, value, keys).select(
        *map(col, keys), col(value), (F.col("n_before") + (F.col("n") + 1) / 2).alias(name)
    )
    return join_nullsafe(df, ranks, [*keys, value])
