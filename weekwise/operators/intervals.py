"""Overlapping intervals by their ends: what is open on each day without a row per interval and day.

Counts come from a sweep line: +1 at each start, -1 after each end, added up per day and entity before anything else, then summed along the
days. A maximum cannot be taken back at an end, so it goes another way: an interval is covered by two blocks whose length is a power of two, the
maximum is taken per block, and blocks hand it down to their halves until they are days. Both shuffle two rows per interval, fewer after
combining; what follows has at most one row (times the block lengths) per entity and day of the study. Incomplete or reversed
intervals count nowhere; ends are inclusive.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from weekwise.functions.dates import week_start

from ._util import as_list, col

LONGEST = 16  # intervals under 2**16 days


def _whole(df: DataFrame, entity, start: str, end: str) -> DataFrame:
    keys = as_list(entity) or ["__all"]
    rows = df if as_list(entity) else df.withColumn("__all", F.lit(0))
    first, last = col(start).cast("date"), col(end).cast("date")
    return rows.withColumns({"__first": first, "__last": last}).where(first.isNotNull() & last.isNotNull() & (first <= last)), keys


def open_segments(df: DataFrame, entity, start: str, end: str, weight: Column | None = None) -> DataFrame:
    """entity, first, last, open: maximal date ranges without a change, and how many intervals (or their weight) are open; none where it is 0."""
    rows, keys = _whole(df, entity, start, end)
    amount = F.lit(1).cast("bigint") if weight is None else weight
    ends = F.array(
        F.struct(F.col("__first").alias("day"), amount.alias("change")), F.struct(F.date_add("__last", 1).alias("day"), (-amount).alias("change"))
    )
    changes = rows.select(*map(col, keys), F.explode(ends).alias("__e")).groupBy(*map(col, keys), F.col("__e.day").alias("first")).agg(
        F.sum("__e.change").alias("__change")
    )
    days = Window.partitionBy(*map(col, keys)).orderBy("first")  # at most one row per day
    held = changes.where("__change <> 0").withColumns({
        "open": F.sum("__change").over(days.rowsBetween(Window.unboundedPreceding, 0)), "last": F.date_sub(F.lead("first").over(days), 1)
    })
    return held.where("open <> 0").select(*map(col, as_list(entity)), "first", "last", "open")


def open_per_day(df: DataFrame, entity, start: str, end: str, name: str = "open", key: str = "date") -> DataFrame:
    """Number of open intervals per entity and day, for days with any."""
    spans = open_segments(df, entity, start, end)
    steps = spans.withColumn("__step", F.explode(F.sequence(F.lit(0), F.datediff("last", "first"))))
    return steps.select(*map(col, as_list(entity)), F.date_add("first", F.col("__step")).alias(key), F.col("open").alias(name))


def interval_days_per_week(df: DataFrame, entity, start: str, end: str, name: str = "event_days") -> DataFrame:
    """Days of all intervals, overlaps counted each time, per entity and week."""
    keys = as_list(entity)
    spans = open_segments(df, keys, start, end).withColumn("__from", week_start(F.col("first")))
    weeks = spans.withColumn("__step", F.explode(F.sequence(F.lit(0), F.floor(F.datediff("last", "__from") / 7).cast("int"))))
    weeks = weeks.withColumn("week_start", F.date_add("__from", F.col("__step") * 7))
    days = F.datediff(F.least("last", F.date_add("week_start", 6)), F.greatest("first", "week_start")) + 1
    return weeks.groupBy(*map(col, keys), "week_start").agg(F.sum(F.col("open") * days).alias(name))


def highest_per_day(df: DataFrame, entity, start: str, end: str, value: str, key: str = "date") -> DataFrame:
    """Largest known value of the intervals open on each day, NULL where none of them has one."""
    rows, keys = _whole(df, entity, start, end)
    rows = rows.withColumn("__days", F.datediff("__last", "__first") + 1)
    rows = rows.withColumn("__k", F.expr(f"CAST(aggregate(sequence(1, {LONGEST - 1}), 0, (k, i) -> k + IF(shiftleft(1, i) <= __days, 1, 0)) AS INT)"))
    rows = rows.where(F.assert_true(F.col("__days") < 1 << LONGEST, F.lit("an interval is too long")).isNull())
    day = F.unix_date("__first")
    blocks = F.array(day, day + F.col("__days") - F.expr("shiftleft(1, __k)"))
    found = rows.select(*map(col, keys), "__k", F.explode(blocks).alias("__at"), col(value).alias("__v")).groupBy(*map(col, keys), "__k", "__at").agg(F.max("__v").alias("__v"))
    kind = df.schema[value].dataType.simpleString()

    def hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
        at, k = pdf["__at"].to_numpy(np.int64), pdf["__k"].to_numpy(np.int64)
        value_of = pdf["__v"]
        order, ranks = np.unique(value_of[value_of.notna()].to_numpy(), return_inverse=True)
        rank = np.full(len(pdf), -1, np.int64)
        rank[value_of.notna().to_numpy()] = ranks
        base, top = at.min(), int(k.max())
        size = int((at + (1 << k)).max() - base)
        level = np.full(size, -2, np.int64)  # -2: no interval, -1: none with a value, else the rank of the value
        for step in range(top, -1, -1):
            own = k == step
            np.maximum.at(level, at[own] - base, rank[own])
            if step:
                half = 1 << step - 1
                lower = level.copy()
                lower[half:] = np.maximum(lower[half:], level[:-half] if half else level)
                level = lower
        days = np.flatnonzero(level >= -1)
        got = level[days]
        values = pd.Series(np.empty(len(days), object))
        values[got >= 0] = order[got[got >= 0]]
        out = pd.DataFrame({"__day": days + base, value: values})
        return out.assign(**{c: pdf[c].iloc[0] for c in keys})[[*keys, "__day", value]]

    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys] + ["__day INT", f"`{value}` {kind}"])
    per_day = found.groupBy(*map(col, keys)).applyInPandas(hand_down, schema)
    return per_day.select(*map(col, as_list(entity)), F.date_from_unix_date("__day").alias(key), col(value))
