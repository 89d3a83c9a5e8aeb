"""Week and day calendars, completion of panels, and key differences."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weekwise.functions.dates import analysis_window, week_start

from ._util import as_list, col


def _date(x) -> Column:
    return x if isinstance(x, Column) else F.lit(str(x)).cast("date")


def date_spine(spark: SparkSession, start, end, days: int = 7, name: str = "week_start") -> DataFrame:
    """One row per ``days`` step from ``start`` to ``end`` (DATE columns or ISO text)."""
    step = F.make_dt_interval(days=F.lit(days))
    return spark.range(1).select(F.explode(F.sequence(_date(start), _date(end), step)).alias(name))


def year_spine(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Mondays of the analysis window of whole calendar years."""
    return date_spine(spark, *analysis_window(first_year, last_year))


def daily_calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Every day of the years, with its year; the base onto which absent years join as all-NULL."""
    lo, hi = (F.make_date(F.lit(y), F.lit(m), F.lit(d)) for y, m, d in ((first_year, 1, 1), (last_year, 12, 31)))
    return date_spine(spark, lo, hi, 1, "date").withColumn("year", F.year("date"))


def entity_calendar(
    df: DataFrame, entity, key: str = "week_start", start=None, end=None, days: int = 7
) -> DataFrame:
    """All expected keys of each entity, between its own first and last key or fixed bounds.

    The bounds aggregate combines map-side, so one entity holding most rows costs no skew.
    """
    keys = as_list(entity)
    lo = _date(start) if start is not None else F.min(col(key))
    hi = _date(end) if end is not None else F.max(col(key))
    bounds = df.groupBy(*keys).agg(F.min(lo).alias("__lo") if start is not None else lo.alias("__lo"),
                                   F.max(hi).alias("__hi") if end is not None else hi.alias("__hi"))
    step = F.make_dt_interval(days=F.lit(days))
    return bounds.where("__lo <= __hi").select(
        *[col(k) for k in keys], F.explode(F.sequence("__lo", "__hi", step)).alias(key)
    )


def complete_calendar(
    df: DataFrame,
    entity,
    key: str = "week_start",
    fills: Mapping | None = None,
    start=None,
    end=None,
    days: int = 7,
    missing_flag: str | None = None,
) -> DataFrame:
    """One row for every expected key of every entity; ``fills`` replaces NULLs afterwards.

    Each row generates the keys between itself and the next row of its entity (the first and last row
    also up to ``start`` and ``end``), so the table is read once and nothing is joined. Keys must lie on
    the grid of ``days``; the window holds one row per entity and period.
    """
    keys = as_list(entity)
    w = Window.partitionBy(*map(col, keys)).orderBy(col(key))
    own = col(key)
    low = own if start is None else F.when(F.lag(own).over(w).isNull(), F.least(own, _date(start))).otherwise(own)
    high = F.date_sub(F.lead(own).over(w), days)
    high = F.greatest(own, F.coalesce(high, own if end is None else F.greatest(own, _date(end))))
    framed = df.where(own.isNotNull()).withColumns({"__lo": low, "__hi": high})
    if start is not None:
        framed = framed.withColumn("__lo", F.greatest(F.col("__lo"), _date(start)))
    if end is not None:
        framed = framed.withColumn("__hi", F.least(F.col("__hi"), _date(end)))
    # whole-number steps: adding days to a date is far cheaper than a sequence of dates
    steps = F.when(F.col("__lo") <= F.col("__hi"), F.sequence(
        F.lit(0), F.floor(F.datediff("__hi", "__lo") / days).cast("int")))
    grown = framed.withColumn("__step", F.explode(steps))
    grown = grown.withColumn("__key", F.date_add("__lo", F.col("__step") * days))
    here = F.col("__key") == own
    out = grown.select(
        *[col(k) for k in keys], F.col("__key").alias(key),
        *[F.when(here, col(c)).alias(c) for c in df.columns if c not in (*keys, key)],
        *([(~here).cast("int").alias(missing_flag)] if missing_flag else []),
    )
    return out.fillna(dict(fills)) if fills else out


def missing_keys(df: DataFrame, expected: DataFrame, keys) -> DataFrame:
    """Expected keys that do not occur in ``df``."""
    names = as_list(keys)
    return expected.join(df.select(*names), names, "left_anti").select(*names)


def common_keys(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Distinct keys present in both tables."""
    names = as_list(keys)
    return a.select(*names).distinct().join(b.select(*names), names, "left_semi")


def key_alignment(a: DataFrame, b: DataFrame, keys, names=("only_left", "only_right")) -> DataFrame:
    """Keys found on one side only, labelled with that side."""
    cols = as_list(keys)
    left, right = a.select(*cols).distinct(), b.select(*cols).distinct()
    return left.join(right, cols, "left_anti").withColumn("side", F.lit(names[0])).unionByName(
        right.join(left, cols, "left_anti").withColumn("side", F.lit(names[1]))
    )


def date_chunks(df: DataFrame, start: str, end: str, days: int | None = None, months: int | None = None) -> DataFrame:
    """Split each row's inclusive date range into consecutive chunks of fixed days or months."""
    if (days is None) == (months is None):
        raise ValueError("give days or months")
    if days:
        step, last = F.make_dt_interval(days=F.lit(days)), F.date_add("chunk_start", days - 1)
    else:
        step = F.make_ym_interval(months=F.lit(months))
        last = F.date_sub(F.add_months("chunk_start", months), 1)
    return df.select("*", F.explode(F.sequence(col(start), col(end), step)).alias("chunk_start")).withColumn(
        "chunk_end", F.least(last, col(end))
    )


def second_chunks(df: DataFrame, start: str, end: str, seconds: int) -> DataFrame:
    """Split each row's inclusive timestamp range into chunks of a fixed number of seconds."""
    step = F.make_dt_interval(secs=F.lit(seconds))
    return df.select("*", F.explode(F.sequence(col(start), col(end), step)).alias("chunk_start")).withColumn(
        "chunk_end", F.least(F.col("chunk_start") + F.make_dt_interval(secs=F.lit(seconds - 1)), col(end))
    )


def expand_intervals(df: DataFrame, start: str, end: str, name: str = "date", days: int = 1) -> DataFrame:
    """One row per day (or ``days`` step) of each inclusive interval; incomplete or reversed ones give none."""
    ok = df.where(col(start).isNotNull() & col(end).isNotNull() & (col(end) >= col(start)))
    count = F.floor(F.datediff(col(end), col(start)) / days).cast("int")
    steps = ok.withColumn("__step", F.explode(F.sequence(F.lit(0), count)))
    return steps.withColumn(name, F.date_add(col(start), F.col("__step") * days)).drop("__step")


def shift_key(df: DataFrame, key: str, days: int) -> DataFrame:
    """Move a period key by whole days."""
    return df.withColumn(key, F.date_add(col(key), days))


def with_week(df: DataFrame, ts: str, name: str = "week_start") -> DataFrame:
    return df.withColumn(name, week_start(col(ts)))
