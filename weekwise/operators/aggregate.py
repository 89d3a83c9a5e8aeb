"""Grain changes: sub-daily -> daily -> weekly, event flags, alerts, hierarchy roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weekwise.functions.dates import week_start
from weekwise.functions.numbers import LEVELS, ordinal, rate_per, score_to_level

from ._util import add_group_values, as_list, col, join_nullsafe
from .calendar import expand_intervals
from .intervals import highest_per_day
from .ordered import quantiles

_SIMPLE = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def weekly_agg(df: DataFrame, entity, date: str, spec: Mapping[str, Column], key: str = "week_start") -> DataFrame:
    """Group to entity and Monday week with the given named aggregates."""
    return df.groupBy(*map(col, as_list(entity)), week_start(col(date)).alias(key)).agg(
        *[e.alias(name) for name, e in spec.items()]
    )


def sum_or_zero(c) -> Column:
    """Sum that is 0 (not NULL) when there is nothing to add."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def n_missing(c: str) -> Column:
    return F.count_if(col(c).isNull())


def units_seen(has_data: Column, unit: Column) -> Column:
    """How many different units have data; ``unit`` is a whole number from 0 to 62, such as an hour or a weekday.

    The units are bits of one number, which combine map-side: no row is expanded and none shuffled a second time, as a distinct count would.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), unit.cast("int"))
    return F.bit_count(F.coalesce(F.bit_or(F.when(has_data, bit)), F.lit(0).cast("long"))).cast("long")


def days_seen(has_data: Column, day: Column) -> Column:
    """How many different days have data, within a group that lies in one week."""
    return units_seen(has_data, F.weekday(F.to_date(day)))


def coverage(has_data: Column, day: Column, n: int = 7) -> Column:
    """Days that have data as a share of ``n``, within a group that lies in one week."""
    return days_seen(has_data, day) / F.lit(float(n))


def any_present(*cols: str) -> Column:
    """At least one of the columns is not NULL."""
    return F.greatest(*[col(c).isNotNull() for c in cols]) if len(cols) > 1 else col(cols[0]).isNotNull()


def agg_if(fn, c: str, cond: Column) -> Column:
    """Aggregate over the rows that satisfy a condition."""
    return fn(F.when(cond, col(c)))


def stats_spec(cols: Sequence[str], stats: Sequence[str] = ("mean", "max", "min")) -> dict[str, Column]:
    """``{col_stat: aggregate}`` for every column and statistic."""
    return {f"{c}_{s}": _SIMPLE[s](col(c)) for c in cols for s in stats}


def daily_agg(
    df: DataFrame, entity, ts: str, cols: Sequence[str], expected: int,
    stats: Sequence[str] = ("mean", "max", "min"), qs: Mapping[str, float] | None = None, bounded: bool = False,
) -> DataFrame:
    """Sub-daily -> daily statistics, observations with any data and coverage over ``expected`` hours.

    ``qs`` adds exact quantile columns ``<col>_<name>``.
    """
    keys = as_list(entity)
    day = df.withColumn("date", F.to_date(col(ts)))
    out = day.groupBy(*map(col, keys), "date").agg(
        *[e.alias(n) for n, e in stats_spec(cols, stats).items()],
        units_seen(any_present(*cols), F.hour(col(ts))).alias("hours_with_data"),
        F.count_if(any_present(*cols)).alias("n_obs"),
    ).withColumn("coverage", F.col("hours_with_data") / F.lit(float(expected)))
    for c in cols if qs else ():
        named = {f"{c}_{n}": q for n, q in qs.items()}
        out = join_nullsafe(out, quantiles(day, c, named, [*keys, "date"], bounded), [*keys, "date"])
    return out


def weekly_from_daily(df: DataFrame, entity, cols: Sequence[str], date: str = "date", days: int = 7) -> DataFrame:
    """Daily statistics -> weekly: mean of means, max of maxima, min of minima, and day coverage.

    Expects columns ``<col>_mean``, ``<col>_max``, ``<col>_min`` as ``daily_agg`` makes them.
    """
    spec = {f"{c}_{s}": _SIMPLE[s](col(f"{c}_{s}")) for c in cols for s in ("mean", "max", "min")}
    means = [f"{c}_mean" for c in cols]
    spec["days_with_data"] = days_seen(any_present(*means), col(date))
    out = weekly_agg(df, entity, date, spec)
    return out.withColumn("coverage", F.col("days_with_data") / F.lit(float(days)))


def daily_max(df: DataFrame, entity, date: str, cols: Sequence[str], key_col: str, flag: str) -> DataFrame:
    """Daily maximum per column and whether the key column has any data that day."""
    return df.groupBy(*map(col, as_list(entity)), col(date)).agg(
        *[F.max(col(c)).alias(c) for c in cols], F.bool_or(col(key_col).isNotNull()).alias(flag)
    )


def group_stat_back(df: DataFrame, by, aggs: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """Add group statistics to every row, computed over the rows that satisfy ``where``.

    Aggregate and join rather than a window: partial aggregates combine before the shuffle, and the
    small statistics side is broadcast by AQE when its measured size allows.
    """
    keys = as_list(by)
    source = df if where is None else df.where(where)
    stats = source.groupBy(*map(col, keys)).agg(*[e.alias(n) for n, e in aggs.items()])
    return add_group_values(df, stats, keys)


def baseline(df: DataFrame, c: str, by, event_level: str, null_is_quiet: bool = True) -> DataFrame:
    """Mean and sample deviation per group over non-event rows (level 0, or NULL unless told otherwise)."""
    quiet = col(event_level) == 0
    if null_is_quiet:
        quiet = quiet | col(event_level).isNull()
    return df.where(quiet).groupBy(*map(col, as_list(by))).agg(
        F.avg(col(c)).alias("baseline_mean"), F.stddev_samp(col(c)).alias("baseline_std")
    )


def z_anomaly(df: DataFrame, c: str, by, event_level: str, name: str = "z", null_is_quiet: bool = True) -> DataFrame:
    """Standardised anomaly against the non-event baseline; no deviation or a zero one gives NULL."""
    keys = as_list(by)
    out = join_nullsafe(df, baseline(df, c, keys, event_level, null_is_quiet), keys)
    return out.withColumn(
        name, F.try_divide(col(c) - F.col("baseline_mean"), F.nullif("baseline_std", F.lit(0.0)))
    )


def entity_day_flags(df: DataFrame, entity, station: str, date: str, flags: Mapping[str, str],
                     mins: Sequence[str] = ()) -> DataFrame:
    """Stations -> entity day: number of flagged stations, stations observed, minima and any-flags.

    ``flags`` maps an output stem to a station 0/1 column; gives ``<stem>_stations`` and ``<stem>_day``.
    """
    out = df.groupBy(*map(col, as_list(entity)), col(date)).agg(
        *[F.sum(col(c)).alias(f"{stem}_stations") for stem, c in flags.items()],
        F.count_distinct(col(station)).alias("stations_obs"),
        *[F.min(col(c)).alias(f"{c}_min") for c in mins],
    )
    days = {f"{stem}_day": (F.col(f"{stem}_stations") >= 1).cast("int") for stem in flags}
    out = out.withColumns(days)
    return out.withColumn("any_day", F.greatest(*days) if len(days) > 1 else F.col(next(iter(days))))


def entity_week_flags(df: DataFrame, entity, date: str, flags: Sequence[str], mins: Sequence[str] = ()) -> DataFrame:
    """Entity day -> entity week: flagged days, any-flags, maxima of station counts and minima."""
    spec: dict[str, Column] = {}
    for stem in (*flags, "any"):
        spec[f"{stem}_days_week"] = F.sum(f"{stem}_day")
        spec[f"{stem}_any_week"] = F.max(f"{stem}_day")
    for stem in flags:
        spec[f"{stem}_stations_max_week"] = F.max(f"{stem}_stations")
    spec["stations_obs_max_week"] = F.max("stations_obs")
    spec.update({f"{c}_min_week": F.min(col(f"{c}_min")) for c in mins})
    return weekly_agg(df, entity, date, spec)


def alerts_weekly(
    df: DataFrame, entity, ts: str, classes: Mapping[str, str], level: str = "level_score", threshold: int = 2
) -> DataFrame:
    """Alerts -> week: highest level per event class (0 when none), level >= threshold flags, day coverage."""
    kept = df.where(col(ts).isNotNull())
    spec = {
        f"{name}_level_max_week": F.coalesce(F.max(F.when(col(c) == 1, F.coalesce(col(level), F.lit(0)))), F.lit(0))
        for name, c in classes.items()
    }
    spec["days_with_alerts"] = days_seen(F.lit(True), col(ts))
    out = weekly_agg(kept, entity, ts, spec)
    flags = {f"{n}_yellow_plus_week": (F.col(f"{n}_level_max_week") >= threshold).cast("int") for n in classes}
    return out.withColumns(flags).withColumn("coverage_week", F.col("days_with_alerts") / 7.0)


def event_intensity_weekly(df: DataFrame, entity, start: str, end: str, intensity: str) -> DataFrame:
    """Overlapping interval events -> largest intensity of any day, per week.

    The largest daily maximum of a week is the largest intensity of the events that touch the week, so
    events are expanded to weeks: a seventh of the rows and no daily shuffle.
    """
    keys = as_list(entity)
    touched = df.where(col(end) >= col(start)).select(
        *map(col, keys), week_start(col(start)).alias("__from"), week_start(col(end)).alias("__to"), col(intensity)
    )
    weeks = expand_intervals(touched, "__from", "__to", "week_start", 7)
    return weeks.groupBy(*map(col, keys), "week_start").agg(F.max(col(intensity)).alias(intensity))


def event_intensity_daily(df: DataFrame, entity, start: str, end: str, intensity: str) -> DataFrame:
    """Overlapping interval events -> largest intensity per day; two rows are shuffled per event, not one per day."""
    return highest_per_day(df, entity, start, end, intensity)


def ordinal_max(df: DataFrame, by, c: str, order: Sequence[str], name: str) -> DataFrame:
    """Highest level of an ordered text column per group."""
    names = F.array(*[F.lit(x) for x in order])
    return df.groupBy(*map(col, as_list(by))).agg(F.get(names, F.max(ordinal(c, order))).alias(name))


def weighted_rollup(
    df: DataFrame, parents: DataFrame, entity: str, level: str, parent: str = "parent",
    weight: str = "population", key: str = "week_start", exposed_share: float = 0.5,
    order: Sequence[str] = LEVELS, extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Entities -> parent: population-weighted score, exposed population and share, level.

    ``parents`` has ``(entity, parent, weight)``. The score divides by the weight of the rows present
    that week (a NULL level adds nothing above but still counts below) and by the top rank; the exposed
    share divides by the parent's whole weight. ``extra`` adds named aggregates of the entity rows, so
    that an outcome is rolled up in the same pass.
    """
    extra = dict(extra or {})
    totals = parents.groupBy(parent).agg(F.sum(weight).alias("total_weight"))
    top = len(order) - 1
    weekly = (
        df.join(parents.select(entity, parent, weight), entity)
        .groupBy(parent, key)
        .agg(
            F.sum(F.when(col(level) == order[-1], F.col(weight)).otherwise(0)).alias("weight_exposed"),
            F.sum(ordinal(level, order) * F.col(weight)).alias("__num"),
            F.sum(weight).alias("__den"),
            *[e.alias(n) for n, e in extra.items()],
        )
        .join(totals, parent)
    )
    score = F.try_divide(F.coalesce(F.col("__num"), F.lit(0)), F.col("__den")) / top
    return weekly.select(
        parent, key, "weight_exposed", score.alias("score"),
        F.try_divide("weight_exposed", "total_weight").alias("share_exposed"), *extra,
    ).withColumns({
        "exposed": F.col("share_exposed") >= exposed_share,
        "level": score_to_level("score", names=order),
    })


def add_rate(df: DataFrame, num: str, population: str, name: str, k: float = 100_000) -> DataFrame:
    return df.withColumn(name, rate_per(num, population, k))


def region_rollup(
    df: DataFrame, n_parents: int, key: str = "week_start", outcome: str = "outcome", population: str = "population",
    exposed: str = "exposed", weight_exposed: str = "weight_exposed", by=(), order: Sequence[str] = LEVELS,
) -> DataFrame:
    """Parents -> region over weeks that all ``n_parents`` parents have: sums, any/both flags, level by share."""
    out = df.groupBy(*map(col, as_list(by)), col(key)).agg(
        F.count("*").alias("__n"),
        F.sum(col(outcome)).alias(outcome),
        F.sum(col(population)).alias(population),
        F.sum(col(weight_exposed)).alias(weight_exposed),
        F.bool_or(col(exposed)).alias("any_exposed"),
        F.bool_and(col(exposed)).alias("all_exposed"),
    ).where(F.col("__n") == n_parents).drop("__n")
    out = out.withColumn("share_exposed", F.try_divide(weight_exposed, population))
    return out.withColumns({
        f"{outcome}_per_100k": rate_per(outcome, population),
        "level": score_to_level("share_exposed", names=order),
    })


def grid_mean(
    df: DataFrame, time: str, cols: Sequence[str], scale: float = 1e9, box: tuple[float, float, float, float] | None = None,
    by=(), lat: str = "latitude", lon: str = "longitude",
) -> DataFrame:
    """Area mean of gridded variables per time step, scaled (kg/m3 -> microgram/m3).

    ``box`` is (south, west, north, east). A repeated time step collapses into the same group only once
    per cell: equal (time, cell) rows are averaged first.
    """
    if box:
        south, west, north, east = box
        df = df.where(col(lat).between(south, north) & col(lon).between(west, east))
    keys = as_list(by)
    cells = df.groupBy(*map(col, keys), col(time), col(lat), col(lon)).agg(*[F.avg(col(c)).alias(c) for c in cols])
    return cells.groupBy(*map(col, keys), col(time)).agg(*[(F.avg(col(c)) * scale).alias(c) for c in cols])
