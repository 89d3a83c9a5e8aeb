"""Contracts and report-only audits. Checks return tables; only ``require_*``/``assert_*`` raise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from ._util import as_list, col, stack_rows


def require_columns(df: DataFrame, cols: Sequence[str], label: str = "table") -> None:
    """Error naming the columns the table lacks (schema only, no job)."""
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise ValueError(f"{label}: missing columns {absent}")


def check_key_valid(df: DataFrame, key: str) -> DataFrame:
    """Number of rows whose key is NULL."""
    return df.agg(F.count_if(col(key).isNull()).alias("null_keys"))


def check_unique(df: DataFrame, keys, examples: int | None = None) -> DataFrame:
    """Keys that occur more than once, with their count; optionally only some examples."""
    names = as_list(keys)
    dup = df.groupBy(*map(col, names)).agg(F.count("*").alias("copies")).where("copies > 1")
    return dup.orderBy(*map(col, names)).limit(examples) if examples else dup


def check_monday(df: DataFrame, key: str = "week_start") -> DataFrame:
    """Rows whose key is not a Monday."""
    return df.where(F.weekday(col(key)) != 0)


def check_unit_interval(df: DataFrame, c: str) -> DataFrame:
    """Rows whose value lies outside [0, 1]."""
    return df.where(~col(c).between(0, 1))


def check_complete(df: DataFrame, entity, key: str = "week_start", start=None, end=None, days: int = 7) -> DataFrame:
    """Expected and actual number of keys per entity, between fixed bounds or the entity's own."""
    from .calendar import _date

    lo = F.min(col(key)) if start is None else F.min(_date(start))
    hi = F.max(col(key)) if end is None else F.max(_date(end))
    inside = df if start is None or end is None else df.where(col(key).between(_date(start), _date(end)))
    return (
        inside.groupBy(*map(col, as_list(entity)))
        .agg(
            (F.floor(F.datediff(hi, lo) / days) + 1).cast("long").alias("expected"),
            F.count_distinct(col(key)).alias("actual"),
            F.count("*").alias("rows"),
        )
        .withColumn("complete", (F.col("expected") == F.col("actual")) & (F.col("rows") == F.col("actual")))
    )


def assert_panel(df: DataFrame, entity, key: str = "week_start") -> DataFrame:
    """Raise unless the key is present, unique per entity and a Monday (runs one job); returns ``df``."""
    names = [*as_list(entity), key]
    require_columns(df, names, "panel")
    stats = (
        df.groupBy(*map(col, names))
        .agg(F.count("*").alias("n"))
        .agg(
            F.count_if(F.col("n") > 1).alias("duplicates"),
            F.count_if(col(key).isNull()).alias("nulls"),
            F.count_if(F.weekday(col(key)) != 0).alias("not_monday"),
        )
        .first()
    )
    bad = {k: v for k, v in stats.asDict().items() if v}
    if bad:
        raise ValueError(f"panel contract broken: {bad}")
    return df


def assert_one_to_one(a: DataFrame, b: DataFrame, keys) -> None:
    """Raise when a key repeats on either side of a join (runs jobs that stop at the first hit)."""
    for label, df in (("left", a), ("right", b)):
        if not check_unique(df, keys).isEmpty():
            raise ValueError(f"join is not one-to-one: repeated keys on the {label} side")


def checks(df: DataFrame, required: Sequence[str], keys, ts: str, non_negative: Sequence[str] = ()) -> DataFrame:
    """Generic check table ``(check, ok, detail)`` from one pass over the keys and values."""
    names = as_list(keys)
    absent = [c for c in required if c not in df.columns]
    per_key = df.groupBy(*map(col, names)).agg(
        F.count("*").alias("__n"),
        F.count_if(col(ts).isNull()).alias("__bad_ts"),
        *[F.count_if(col(c).isNull()).alias(f"__null_{i}") for i, c in enumerate(required) if c in df.columns],
        *[F.count_if(col(c) < 0).alias(f"__neg_{i}") for i, c in enumerate(non_negative)],
    )
    nulls = [F.sum(f"__null_{i}") for i, c in enumerate(required) if c in df.columns]
    negs = [F.sum(f"__neg_{i}") for i in range(len(non_negative))]
    one = per_key.agg(
        F.sum("__bad_ts").alias("bad_ts"),
        F.sum(F.col("__n") - 1).alias("dups"),
        sum(nulls, F.lit(0)).alias("nulls"),
        sum(negs, F.lit(0)).alias("negs"),
    )

    def row(n: Column) -> dict[str, Column]:
        n = F.coalesce(n, F.lit(0)).cast("long")
        return {"ok": n == 0, "detail": n}

    return stack_rows(one, [], "check", {
        "required_columns": row(F.lit(len(absent))),
        "key_parses": row(F.col("bad_ts")),
        "duplicate_keys": row(F.col("dups")),
        "missing_cells": row(F.col("nulls")),
        "negative_values": row(F.col("negs")),
    })


def missing_table(df: DataFrame, cols: Sequence[str] | None = None, by=()) -> DataFrame:
    """NULL count and percentage (4 decimals) of every column, optionally per group."""
    names, keys = list(cols or df.columns), as_list(by)
    one = df.groupBy(*map(col, keys)).agg(
        F.count("*").alias("__n"), *[F.count_if(col(c).isNull()).alias(f"__m{i}") for i, c in enumerate(names)]
    )
    return stack_rows(one, keys, "column", {
        c: {"missing": F.col(f"__m{i}"),
            "missing_pct": F.round(F.try_divide(F.col(f"__m{i}") * F.lit(100.0), F.col("__n")), 4)}
        for i, c in enumerate(names)
    })




def missing_by(df: DataFrame, c: str, part: Column, name: str, by=()) -> DataFrame:
    """Share of NULLs of one column per calendar part."""
    return df.groupBy(*map(col, as_list(by)), part.alias(name)).agg(
        F.count("*").alias("n"), F.avg(col(c).isNull().cast("int")).alias("missing_rate")
    )


def null_periods(df: DataFrame, cols: Sequence[str], key: str = "week_start", by=()) -> DataFrame:
    """First and last key at which each column is NULL."""
    keys = as_list(by)
    one = df.groupBy(*map(col, keys)).agg(*[
        e for i, c in enumerate(cols) for e in (
            F.min(F.when(col(c).isNull(), col(key))).alias(f"__lo{i}"),
            F.max(F.when(col(c).isNull(), col(key))).alias(f"__hi{i}"),
            F.count_if(col(c).isNull()).alias(f"__n{i}"))
    ])
    return stack_rows(one, keys, "column", {
        c: {"first_null": F.col(f"__lo{i}"), "last_null": F.col(f"__hi{i}"), "n_null": F.col(f"__n{i}")}
        for i, c in enumerate(cols)
    })


def column_audit(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Type, non-null, distinct and non-zero count of every column.

    Distinct counts come from one count over (column, value) pairs, which combines map-side, instead of
    an expansion of the whole row per column.
    """
    names = list(cols or df.columns)
    types = dict(df.dtypes)
    pairs = stack_rows(df, [], "column", {
        c: {"text": col(c).cast("string"),
            "zero": (col(c) == 0) if isinstance(df.schema[c].dataType, NumericType) else F.lit(False)}
        for c in names
    })
    values = pairs.groupBy("column", "text").agg(F.count("*").alias("n"), F.bool_or("zero").alias("zero"))
    some = F.col("text").isNotNull()
    return values.groupBy("column").agg(
        F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("non_null"),
        F.count_if(some).alias("distinct"),
        F.coalesce(F.sum(F.when(some & ~F.col("zero"), F.col("n"))), F.lit(0)).alias("non_zero"),
    ).withColumn("dtype", F.create_map(*[F.lit(x) for c in names for x in (c, types[c])])[F.col("column")])


def weekday_counts(df: DataFrame, key: str) -> DataFrame:
    """Number of keys per weekday name."""
    return df.groupBy(F.date_format(col(key), "EEEE").alias("weekday")).agg(F.count("*").alias("n"))


def audit_structure(df: DataFrame, y: str, entity, key: str = "week_start") -> DataFrame:
    """Per entity: rows, NULLs, duplicates, key range, expected/actual/missing weeks, outcome moments."""
    keys = as_list(entity)
    per_key = df.groupBy(*map(col, keys), col(key)).agg(
        F.count("*").alias("n"),
        F.count_if(col(y).isNull()).alias("nulls"),
        F.sum(col(y)).alias("s"),
        F.min(col(y)).alias("lo"),
        F.max(col(y)).alias("hi"),
    )
    return (
        per_key.groupBy(*map(col, keys))
        .agg(
            F.sum("n").alias("rows"),
            F.sum("nulls").alias("nulls"),
            F.sum(F.col("n") - 1).alias("duplicates"),
            F.min(key).alias("first_week"),
            F.max(key).alias("last_week"),
            F.count(key).alias("actual_weeks"),
            F.min("lo").alias("y_min"),
            F.max("hi").alias("y_max"),
            (F.sum("s") / F.sum(F.col("n") - F.col("nulls"))).alias("y_mean"),
        )
        .withColumn("expected_weeks", (F.datediff("last_week", "first_week") / 7 + 1).cast("long"))
        .withColumn("missing_weeks", F.col("expected_weeks") - F.col("actual_weeks"))
        .withColumn("null_pct", F.col("nulls") * 100.0 / F.col("rows"))
        .withColumn("missing_pct", F.col("missing_weeks") * 100.0 / F.col("expected_weeks"))
    )


def structure_flags(df: DataFrame, y: str, entity, key: str = "week_start") -> DataFrame:
    """Long table of flagged rows ``(entity, week, issue)``: null, duplicate, missing week, not Monday."""
    from .calendar import entity_calendar, missing_keys

    keys = as_list(entity)
    out = [*keys, key, "issue"]

    def tagged(rows: DataFrame, issue: str) -> DataFrame:
        return rows.withColumn("issue", F.lit(issue)).select(*map(col, out))

    return (
        tagged(df.where(col(y).isNull()), "null_outcome")
        .unionByName(tagged(check_unique(df, [*keys, key]), "duplicate_week"))
        .unionByName(tagged(missing_keys(df, entity_calendar(df, keys, key), [*keys, key]), "missing_week"))
        .unionByName(tagged(check_monday(df, key), "not_monday"))
    )


def range_flags(
    df: DataFrame, rules: Mapping[str, tuple[float | None, float | None]], keep: Sequence[str],
    logic: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Long table of violations ``(keys, variable, value, bounds, status)``.

    ``rules`` maps a column to (low, high), either may be open; ``logic`` maps a name to
    (value column, violated condition). Absent columns are skipped.
    """
    entries = []
    for c, (lo, hi) in rules.items():
        if c not in df.columns:
            continue
        bad = (col(c) < lo if lo is not None else F.lit(False)) | (col(c) > hi if hi is not None else F.lit(False))
        bounds = f"[{'-inf' if lo is None else lo:}, {'inf' if hi is None else hi}]"
        entries.append((c, col(c), bad, bounds, "OUTLIER" if None not in (lo, hi) else "VIOLATION"))
    for name, (c, bad) in (logic or {}).items():
        entries.append((name, col(c), bad, name, "LOGIC"))
    packed = F.array(*[
        F.when(bad, F.struct(F.lit(n).alias("variable"), v.cast("double").alias("value"),
                             F.lit(b).alias("bounds"), F.lit(s).alias("status")))
        for n, v, bad, b, s in entries
    ])
    return df.select(*map(col, keep), F.explode(F.array_compact(packed)).alias("__f")).select(
        *map(col, keep), "__f.*"
    )


def audit_ranges(
    df: DataFrame, rules: Mapping[str, tuple[float | None, float | None]], by=(),
    logic: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Violation count per rule (-1 for an absent column) and in total, in one aggregate."""
    aggs, total = [], F.lit(0)
    for c, (lo, hi) in rules.items():
        if c not in df.columns:
            aggs.append(F.lit(-1).cast("long").alias(f"{c}_violations"))
            continue
        bad = (col(c) < lo if lo is not None else F.lit(False)) | (col(c) > hi if hi is not None else F.lit(False))
        aggs.append(F.count_if(bad).alias(f"{c}_violations"))
        total = total + F.count_if(bad)
    for name, (_, bad) in (logic or {}).items():
        aggs.append(F.count_if(bad).alias(f"{name}_violations"))
        total = total + F.count_if(bad)
    return df.groupBy(*map(col, as_list(by))).agg(F.count("*").alias("rows"), *aggs, total.alias("total_violations"))


def traffic_light(null_pct: Column, duplicates: Column, missing_pct: Column) -> Column:
    """green / yellow / red verdict on a structure audit.

    Red: NULLs over 5 % or missing weeks over 10 %. Green: NULLs under 1 %, no duplicates and missing
    weeks under 2 %. Everything between is yellow.
    """
    return (
        F.when((null_pct > 5) | (missing_pct > 10), "red")
        .when((null_pct < 1) & (duplicates == 0) & (missing_pct < 2), "green")
        .otherwise("yellow")
    )


def audit_subdaily(df: DataFrame, ts: str, entity, hours: int = 6) -> DataFrame:
    """Per entity: expected and present time steps, missing steps and rows off the step grid."""
    keys = as_list(entity)
    per_ts = df.groupBy(*map(col, keys), col(ts).alias("__t")).agg(F.count("*").alias("__n"))
    on = on_grid_of(F.col("__t"), hours)
    span = F.timestamp_diff("HOUR", F.date_trunc("day", F.min("__t")), F.date_trunc("day", F.max("__t"))) + 24
    return (
        per_ts.groupBy(*map(col, keys))
        .agg((span / hours).cast("long").alias("expected"), F.count_if(on).alias("present"),
             F.coalesce(F.sum(F.when(~on, F.col("__n"))), F.lit(0)).alias("invalid_rows"))
        .withColumn("missing", F.col("expected") - F.col("present"))
    )


def on_grid_of(t: Column, hours: int) -> Column:
    """The timestamp lies exactly on a step of ``hours`` hours."""
    return (F.hour(t) % hours == 0) & (F.minute(t) == 0) & (F.second(t) == 0) & (F.date_trunc("second", t) == t)


def check_daily(df: DataFrame, required: Sequence[str], key: str = "date", by=()) -> DataFrame:
    """Daily contract: required columns (error), then NULL and repeated dates per group."""
    require_columns(df, [*required, key], "daily table")
    keys = as_list(by)
    per_day = df.groupBy(*map(col, keys), col(key)).agg(F.count("*").alias("__n"))
    return per_day.groupBy(*map(col, keys)).agg(
        F.coalesce(F.sum(F.when(col(key).isNull(), F.col("__n"))), F.lit(0)).alias("null_dates"),
        F.count_if(col(key).isNotNull() & (F.col("__n") > 1)).alias("duplicate_dates"),
    )


def table_diff(a: DataFrame, b: DataFrame, keys, cols: Sequence[str]) -> DataFrame:
    """Largest absolute difference per column between two copies, and rows found on one side only."""
    names = as_list(keys)
    left = a.select(*map(col, names), *[col(c).alias(f"__a_{c}") for c in cols], F.lit(1).alias("__ina"))
    right = b.select(*map(col, names), *[col(c).alias(f"__b_{c}") for c in cols], F.lit(1).alias("__inb"))
    joined = left.join(right, names, "full")
    one = joined.agg(
        F.count_if(F.col("__ina").isNull() | F.col("__inb").isNull()).alias("unmatched"),
        *[F.max(F.abs(col(f"__a_{c}") - col(f"__b_{c}"))).alias(f"__d_{c}") for c in cols],
        *[F.count_if(col(f"__a_{c}").isNull() != col(f"__b_{c}").isNull()).alias(f"__n_{c}") for c in cols],
    )
    return stack_rows(one, [], "column", {
        c: {"max_abs_diff": col(f"__d_{c}").cast("double"), "null_mismatch": col(f"__n_{c}"),
            "unmatched_rows": F.col("unmatched")} for c in cols
    })
