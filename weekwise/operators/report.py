"""Report tables: statistics by level, cross-tabulations, seasonality, effects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weekwise.functions.numbers import LEVELS

from ._util import as_list, col, join_nullsafe, stack_rows
from .ordered import quantiles


def moments(y: str) -> list[Column]:
    v = col(y)
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max")]


def level_rows(df: DataFrame, level: str, order: Sequence[str]) -> DataFrame:
    """The fixed level table ``(level, level_order)``."""
    rows = F.array(*[F.struct(F.lit(n).alias(level), F.lit(i).alias("level_order")) for i, n in enumerate(order)])
    return df.sparkSession.range(1).select(F.inline(rows))


def stats_by(df: DataFrame, by, y: str) -> DataFrame:
    """n, mean, std, min, max and exact median of ``y`` per group."""
    keys = as_list(by)
    rows = df.where(col(y).isNotNull())
    return join_nullsafe(
        rows.groupBy(*map(col, keys)).agg(*moments(y)), quantiles(rows, y, {"median": 0.5}, keys), keys
    )


def outcome_by_level(df: DataFrame, level: str, y: str, order: Sequence[str] = LEVELS) -> DataFrame:
    """Outcome statistics in the fixed level order; levels without rows are kept with n = 0."""
    out = level_rows(df, level, order).join(stats_by(df, level, y), level, "left")
    return out.fillna({"n": 0})


def mean_ci(df: DataFrame, by, y: str, z: float = 1.96) -> DataFrame:
    """Mean with standard error and normal confidence bounds per group."""
    out = df.groupBy(*map(col, as_list(by))).agg(*moments(y))
    out = out.withColumn("se", F.col("std") / F.sqrt("n"))
    return out.withColumns({"ci_low": F.col("mean") - z * F.col("se"), "ci_high": F.col("mean") + z * F.col("se")})


def combo_label(a: str, b: str, name_a: str, name_b: str) -> Column:
    """``neither`` / only one / ``both`` label of two 0/1 flags."""
    on_a, on_b = col(a) == 1, col(b) == 1
    return (
        F.when(on_a & on_b, "both").when(on_a, f"{name_a}_only").when(on_b, f"{name_b}_only").otherwise("neither")
    )


def interaction_table(df: DataFrame, a: str, b: str, y: str, full: bool = False) -> DataFrame:
    """Outcome statistics per combination of two 0/1 flags; ``full`` keeps empty cells."""
    out = stats_by(df, [a, b], y)
    if not full:
        return out
    cells = F.array(*[F.struct(F.lit(i).alias(a), F.lit(j).alias(b)) for i in (0, 1) for j in (0, 1)])
    grid = df.sparkSession.range(1).select(F.inline(cells))
    return grid.join(out, [a, b], "left")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long cross-tabulation with margins: counts and shares of row, column and table.

    ``CUBE`` gives cells and margins in one aggregate; ``is_total_*`` tells a margin from a NULL value.
    """
    cube = df.cube(col(a), col(b)).agg(
        F.count("*").alias("n"), F.grouping(col(a)).alias("is_total_a"), F.grouping(col(b)).alias("is_total_b")
    )
    cells, rows = cube, cube.where("is_total_b = 1").select(col(a), "is_total_a", F.col("n").alias("__row"))
    cols = cube.where("is_total_a = 1").select(col(b), "is_total_b", F.col("n").alias("__col"))
    total = cube.where("is_total_a = 1 and is_total_b = 1").select("n").scalar()
    out = join_nullsafe(join_nullsafe(cells, rows, [a, "is_total_a"]), cols, [b, "is_total_b"])
    return out.withColumns({
        "row_share": F.col("n") / F.col("__row"), "col_share": F.col("n") / F.col("__col"), "share": F.col("n") / total,
    }).drop("__row", "__col")


def crosstab_wide(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    """Cross-tabulation with one column per listed value of ``b`` (listing them avoids a job), 0-filled."""
    out = df.groupBy(col(a)).pivot(b, list(values)).count()
    return out.fillna(0, subset=[str(v) for v in values])


def level_by_month(df: DataFrame, level: str, key: str = "week_start", order: Sequence[str] = LEVELS) -> DataFrame:
    """Weeks per calendar month and level, wide and 0-filled."""
    return crosstab_wide(df.withColumn("month", F.month(col(key))), "month", level, order)


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Count and percentage per value, NULL included."""
    total = df.agg(F.count("*")).scalar()
    out = df.groupBy(col(c)).agg(F.count("*").alias("n"))
    return out.withColumn("pct", F.col("n") * F.lit(100.0) / total)


def group_counts(df: DataFrame, by) -> DataFrame:
    return df.groupBy(*map(col, as_list(by))).agg(F.count("*").alias("n"))


def quantiles_by(df: DataFrame, by, c: str, qs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Wide quantile table ``q10 ... q90`` per group."""
    return quantiles(df, c, {f"q{round(100 * q):02d}": q for q in qs}, by)


def num_summary(df: DataFrame, cols: Sequence[str], qs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column: n, mean, std, min, exact quantiles, max."""
    long = stack_rows(df, [], "column", {c: {"value": col(c).cast("double")} for c in cols})
    names = {f"p{round(100 * q):02d}": q for q in qs}
    return join_nullsafe(
        long.groupBy("column").agg(*moments("value")), quantiles(long, "value", names, "column"), ["column"]
    )


def bias_corrected_skew(c: str) -> Column:
    """Sample skewness with the small-sample correction."""
    n = F.count(col(c))
    return F.when(n > 2, F.skewness(col(c)) * F.sqrt(n * (n - 1)) / (n - 2))


def dist_stats(df: DataFrame, c: str, by=()) -> DataFrame:
    """Shape of a distribution: moments, quantiles, distinct values, skew, IQR and tail ratios."""
    keys = as_list(by)
    rows = df.where(col(c).isNotNull())
    qs = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    shape = rows.groupBy(*map(col, keys)).agg(
        *moments(c), F.count_distinct(col(c)).alias("n_unique"), bias_corrected_skew(c).alias("skew")
    )
    points = quantiles(rows, c, qs, keys)
    out = join_nullsafe(shape, points, keys) if keys else _side_by_side(shape, points)
    return out.withColumns({
        "iqr": F.col("p75") - F.col("p25"),
        "p95_over_median": F.try_divide("p95", "median"),
        "max_over_p95": F.try_divide("max", "p95"),
    })


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    from ._util import add_scalars

    return add_scalars(a, b)


def seasonality(df: DataFrame, y: str, part: Column, name: str, by=()) -> DataFrame:
    """Statistics (2 decimals) of the outcome per month or quarter."""
    out = df.groupBy(*map(col, as_list(by)), part.alias(name)).agg(*moments(y))
    return out.withColumns({c: F.round(c, 2) for c in ("mean", "std", "min", "max")})


def seasonality_summary(df: DataFrame, y: str, part: Column, by=()) -> DataFrame:
    """Part with the lowest and highest mean, and the range between them."""
    keys = as_list(by)
    means = df.groupBy(*map(col, keys), part.alias("__p")).agg(F.avg(col(y)).alias("__m"))
    return means.groupBy(*map(col, keys)).agg(
        F.min_by("__p", F.struct("__m", "__p")).alias("lowest"), F.min("__m").alias("lowest_mean"),
        F.max_by("__p", F.struct(F.col("__m"), -F.col("__p"))).alias("highest"), F.max("__m").alias("highest_mean"),
        (F.max("__m") - F.min("__m")).alias("range"),
    )


def year_classes(
    df: DataFrame, cond: Column, by=(), key: str = "week_start", threshold: float = 0.10,
    names: tuple[str, str] = ("high", "low"),
) -> DataFrame:
    """Class of each year by the share of weeks that satisfy ``cond``."""
    hit = F.coalesce(cond, F.lit(False)).cast("int")
    out = df.groupBy(*map(col, as_list(by)), F.year(col(key)).alias("year")).agg(
        F.count("*").alias("weeks"), F.sum(hit).alias("hits"), F.avg(hit).alias("share")
    )
    return out.withColumn("year_class", F.when(F.col("share") > threshold, names[0]).otherwise(names[1]))


def classify_years(df: DataFrame, cond: Column, y: str, by=(), key: str = "week_start", threshold: float = 0.10,
                   month: bool = False) -> DataFrame:
    """Outcome statistics per year class (and month)."""
    keys = as_list(by)
    classes = year_classes(df, cond, keys, key, threshold).select(*map(col, keys), "year", "year_class")
    rows = join_nullsafe(df.withColumns({"year": F.year(col(key)), "month": F.month(col(key))}), classes,
                         [*keys, "year"])
    return rows.groupBy("year_class", *(["month"] if month else [])).agg(*moments(y))


def monthly_overview(df: DataFrame, flag: str, severity: str, by=(), key: str = "week_start") -> DataFrame:
    """Weeks, flagged share and mean severity per calendar month; NULLs do not count."""
    return df.groupBy(*map(col, as_list(by)), F.date_trunc("month", col(key)).cast("date").alias("month_start")).agg(
        F.count("*").alias("weeks"), F.avg(col(flag)).alias("flag_share"), F.avg(col(severity)).alias("mean_severity")
    )


def yearly_rates(df: DataFrame, flag: str, coverage: str, by=(), key: str = "week_start") -> DataFrame:
    """Weeks, events, event rate and coverage per year."""
    return df.groupBy(*map(col, as_list(by)), F.year(col(key)).alias("year")).agg(
        F.count("*").alias("weeks"), F.count_if(col(flag) == 1).alias("events"),
        F.avg(F.coalesce(col(flag), F.lit(0))).alias("event_rate"),
        F.avg(col(coverage)).alias("coverage_mean"), F.min(col(coverage)).alias("coverage_min"),
    )


def extremes_by_year(df: DataFrame, flags: Sequence[str], by=(), key: str = "week_start") -> DataFrame:
    return df.groupBy(*map(col, as_list(by)), F.year(col(key)).alias("year")).agg(
        *[F.sum(col(f)).alias(f) for f in flags]
    )


def normalized_effect(
    df: DataFrame, entity: str, level: str, y: str, population: DataFrame, reference_population: float,
    order: Sequence[str] = LEVELS, digits: int = 3,
) -> DataFrame:
    """Mean outcome at the top level minus at the bottom one, per 100 000 and for a reference population.

    The rate is rounded before it is extrapolated, so that published tables can be reproduced.
    """
    top, bottom = F.col(level) == order[-1], F.col(level) == order[0]
    means = df.groupBy(entity).agg(
        F.avg(F.when(top, col(y))).alias("mean_top"), F.avg(F.when(bottom, col(y))).alias("mean_bottom")
    )
    return effect_from_means(means.join(population.select(entity, "population"), entity), reference_population, digits)


def effect_from_means(means: DataFrame, reference_population: float, digits: int = 3) -> DataFrame:
    """``delta``, rounded ``delta_per_100k`` and ``extrapolated`` from mean_top, mean_bottom, population."""
    out = means.withColumn("delta", F.col("mean_top") - F.col("mean_bottom"))
    out = out.withColumn("delta_per_100k", F.round(F.col("delta") / F.col("population") * 100_000, digits))
    return out.withColumn(
        "extrapolated", F.round(F.col("delta_per_100k") * F.lit(reference_population / 100_000.0), 1)
    )


def label_agreement_profile(df: DataFrame, a: Column, b: Column, cols: Sequence[str], by=()) -> DataFrame:
    """Rows that the first label calls an event, split by whether the second confirms; means per group."""
    status = F.when(F.coalesce(b, F.lit(False)), "confirmed").otherwise("unconfirmed")
    return df.where(a).groupBy(*map(col, as_list(by)), status.alias("status")).agg(
        F.count("*").alias("n"), *[F.avg(col(c)).alias(f"{c}_mean") for c in cols],
        *[F.stddev_samp(col(c)).alias(f"{c}_std") for c in cols],
    )


def agreement(df: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """Agreement of two 0/1 labels over rows where both are known.

    ``overlap_n`` such rows; ``agree_pct`` equal labels; ``a_given_b_pct`` share of b-events that a
    also flags; ``b_given_a_pct`` the other direction.
    """
    both = df.where(col(a).isNotNull() & col(b).isNotNull())
    x, z = col(a) == 1, col(b) == 1
    return both.groupBy(*map(col, as_list(by))).agg(
        F.count("*").alias("overlap_n"),
        (F.count_if(x == z) * 100.0 / F.count("*")).alias("agree_pct"),
        F.try_divide(F.count_if(x & z) * F.lit(100.0), F.count_if(z)).alias("a_given_b_pct"),
        F.try_divide(F.count_if(x & z) * F.lit(100.0), F.count_if(x)).alias("b_given_a_pct"),
    )


def key_numbers(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """``(metric, value)`` table from one aggregate; values as text."""
    one = df.agg(*[e.cast("string").alias(f"__k{i}") for i, e in enumerate(metrics.values())])
    return stack_rows(one, [], "metric", {m: {"value": F.col(f"__k{i}")} for i, m in enumerate(metrics)})


def dist_by_bin(df: DataFrame, binned: Column, y: str, name: str = "bin") -> DataFrame:
    """Distribution of one score within the bins of another."""
    return df.withColumn(name, binned).groupBy(name).agg(*moments(y))
