"""Window operators over a panel.

Every window is partitioned by entity and ordered by the period key. A panel holds one row per entity
and period, so a window partition never exceeds the number of periods of the study, however many rows
the raw feeds had.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from weekwise.functions.dates import week_start

from ._util import add_group_values, as_list, col
from .aggregate import group_stat_back
from .calendar import _date, complete_calendar
from .ordered import quantiles


def by_entity(entity, key: str = "week_start"):
    return Window.partitionBy(*map(col, as_list(entity))).orderBy(col(key))


def add_lags(df: DataFrame, c: str, ks: Sequence[int], entity, key: str = "week_start") -> DataFrame:
    """``c_lag<k>``: the value ``k`` rows earlier. Complete the calendar first for calendar lags."""
    w = by_entity(entity, key)
    return df.withColumns({f"{c}_lag{k}": F.lag(col(c), k).over(w) for k in ks})


def add_leads(df: DataFrame, c: str, ks: Sequence[int], entity, key: str = "week_start") -> DataFrame:
    """``c_lead<k>``: the value ``k`` rows later."""
    w = by_entity(entity, key)
    return df.withColumns({f"{c}_lead{k}": F.lead(col(c), k).over(w) for k in ks})


def moving_avg(df: DataFrame, c: str, n: int, entity, key: str = "week_start", name: str | None = None) -> DataFrame:
    """Mean of the last ``n`` rows, from the first row on."""
    w = by_entity(entity, key).rowsBetween(1 - n, 0)
    return df.withColumn(name or f"{c}_ma{n}", F.avg(col(c)).over(w))


def anomaly(df: DataFrame, cols: Sequence[str] | str, part: Column, entity=(), suffix: str = "_anom") -> DataFrame:
    """Value minus the mean of its season (``part``: month, ISO week ...) within the entity."""
    names = as_list(cols)
    out = group_stat_back(
        df.withColumn("__season", part), [*as_list(entity), "__season"],
        {f"__m{i}": F.avg(col(c)) for i, c in enumerate(names)},
    )
    return out.withColumns({f"{c}{suffix}": col(c) - F.col(f"__m{i}") for i, c in enumerate(names)}).drop(
        "__season", *[f"__m{i}" for i in range(len(names))]
    )


def climatology(df: DataFrame, cols: Sequence[str], part: Column, name: str, entity=()) -> DataFrame:
    """Mean per season of several columns."""
    return df.groupBy(*map(col, as_list(entity)), part.alias(name)).agg(
        *[F.avg(col(c)).alias(f"{c}_clim") for c in cols]
    )


def episodes(
    df: DataFrame, flag: str, entity, key: str = "week_start", by: str = "row", days: int = 7, name: str = "episode_id"
) -> DataFrame:
    """Number maximal runs of ``flag = 1``; NULL outside them.

    ``by="row"``: adjacent rows belong together. ``by="calendar"``: only if they are ``days`` apart.
    """
    w = by_entity(entity, key)
    on = F.coalesce(col(flag) == 1, F.lit(False))
    fresh = F.lag(on, 1, False).over(w) == F.lit(False)
    if by == "calendar":
        fresh = fresh | (F.datediff(col(key), F.lag(col(key), 1).over(w)) > days)
    elif by != "row":
        raise ValueError("by must be 'row' or 'calendar'")
    start = F.when(on & fresh, 1).otherwise(0)
    out = df.withColumn("__start", start)
    count = F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, F.when(on, count)).drop("__start")


def episode_table(
    df: DataFrame, entity, key: str = "week_start", name: str = "episode_id",
    x: str | None = None, overlap: str | None = None,
) -> DataFrame:
    """One row per episode: start, end, weeks, peak/mean/sum of ``x``, overlap with another flag, type."""
    aggs = [F.min(key).alias("start"), F.max(key).alias("end"), F.count("*").alias("weeks")]
    if x:
        aggs += [F.max(col(x)).alias("peak"), F.avg(col(x)).alias("mean"), F.sum(col(x)).alias("total")]
    if overlap:
        aggs += [F.sum(F.coalesce(col(overlap), F.lit(0))).alias("overlap_weeks"),
                 F.max(F.coalesce(col(overlap), F.lit(0))).alias("overlaps")]
    out = df.where(col(name).isNotNull()).groupBy(*map(col, as_list(entity)), col(name)).agg(*aggs)
    return out.withColumn("episode_type", F.when(F.col("weeks") == 1, "1-week").otherwise("2+ weeks"))


def runs(df: DataFrame, c: str, entity, key: str = "week_start") -> DataFrame:
    """Run-length encoding: value, first and last key and length of every run of equal values."""
    w = by_entity(entity, key)
    change = F.when(F.lag(col(c), 1).over(w).eqNullSafe(col(c)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = df.withColumn("__c", change).withColumn(
        "run_id", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(*map(col, as_list(entity)), "run_id").agg(
        F.first(col(c)).alias("value"), F.min(key).alias("start"), F.max(key).alias("end"),
        F.count("*").alias("length"),
    )


def detect_gaps(
    df: DataFrame, entity, coverage: str, key: str = "week_start", threshold: float = 4 / 7, start=None, end=None
) -> DataFrame:
    """Ranges of adjacent weeks that are absent or under the coverage threshold, as (start, end) dates.

    ``start`` may be any day; the week that holds it is the first one expected.
    """
    keys = as_list(entity)
    start = None if start is None else week_start(_date(start))
    full = complete_calendar(df.select(*map(col, keys), key, col(coverage)), keys, key, start=start, end=end)
    poor = full.where(F.coalesce(col(coverage), F.lit(0.0)) < threshold)
    island = F.date_sub(col(key), (F.row_number().over(by_entity(keys, key)) * 7).cast("int"))
    return (
        poor.withColumn("__g", island)
        .groupBy(*map(col, keys), "__g")
        .agg(F.min(key).alias("gap_start"), F.date_add(F.max(key), 6).alias("gap_end"), F.count("*").alias("weeks"))
        .drop("__g")
    )


def count_changes(df: DataFrame, c: str, entity, key: str, count_first: bool = True) -> DataFrame:
    """Number of rows whose value differs from the row before; the first row counts unless told not to."""
    w = by_entity(entity, key)
    same = F.lag(col(c), 1).over(w).eqNullSafe(col(c)) & (F.row_number().over(w) > 1)
    changed = ~same if count_first else (~same & (F.row_number().over(w) > 1))
    return df.withColumn("__d", changed).groupBy(*map(col, as_list(entity))).agg(
        F.count_if("__d").alias("changes")
    )


def impute_median(df: DataFrame, cols: Sequence[str], entity) -> DataFrame:
    """NULL -> median of the column within the entity's periods."""
    keys = as_list(entity)
    out = group_stat_back(df, keys, {f"__med{i}": F.percentile(col(c), 0.5) for i, c in enumerate(cols)})
    return out.withColumns({c: F.coalesce(col(c), F.col(f"__med{i}")) for i, c in enumerate(cols)}).drop(
        *[f"__med{i}" for i in range(len(cols))]
    )


def quantile_bins(df: DataFrame, c: str, n: int, name: str, entity=(), bounded: bool = False) -> DataFrame:
    """Equal-frequency bins from exact quantile edges: right-closed, lowest value included, numbered from 0.

    Repeated edges collapse, so there may be fewer than ``n`` bins.
    """
    keys = as_list(entity)
    qs = {f"__e{i}": i / n for i in range(n + 1)}
    edges = quantiles(df, c, qs, keys, bounded).select(
        *map(col, keys), F.array_distinct(F.array(*[F.col(e) for e in qs])).alias("__edges")
    )
    out = add_group_values(df, edges, keys)
    passed = F.size(F.filter("__edges", lambda e: e < col(c)))
    return out.withColumn(name, F.when(col(c).isNotNull(), F.greatest(passed - 1, F.lit(0)))).drop("__edges")


def row_index(df: DataFrame, entity, key: str = "week_start") -> DataFrame:
    """Position of each row within its entity from 0, and its parity."""
    out = df.withColumn("row_index", F.row_number().over(by_entity(entity, key)) - 1)
    return out.withColumn("parity", F.col("row_index") % 2)


def interaction_flags(
    df: DataFrame, a: str, b: str, ks: Sequence[int], entity, key: str = "week_start"
) -> DataFrame:
    """``a_and_b`` and ``a_not_b`` 0/1 flags with their lags."""
    on_a, on_b = F.coalesce(col(a) == 1, F.lit(False)), F.coalesce(col(b) == 1, F.lit(False))
    both, only = f"{a}_and_{b}", f"{a}_not_{b}"
    out = df.withColumns({both: (on_a & on_b).cast("int"), only: (on_a & ~on_b).cast("int")})
    return add_lags(add_lags(out, both, ks, entity, key), only, ks, entity, key)
