"""Cut tables: where to split the values of large groups, one sorted array of cut values per group.

The cuts are every ``OVERSAMPLE``-th of the values whose hash falls under a threshold that follows the size of the group. So each group
is cut along its own values, whatever the others hold; the sample is bounded per group, combines map-side and, unlike a quantile sketch
that is merged in the order of arrival, comes out the same when a lost task runs again. Groups with few rows have no cuts and one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weekwise.session import scratch_path

from ._util import add_scalars, as_list, col, join_nullsafe

RANGES = 256  # ranges of a group at most
OVERSAMPLE = 8  # sampled values per cut


def _cut_values(value: str, wanted: Column) -> Column:
    """Every OVERSAMPLE-th of the sampled values, ``wanted`` cuts at most."""
    picked = F.filter(F.sort_array(F.collect_set(col(value))), lambda _, i: i % OVERSAMPLE == OVERSAMPLE - 1)
    return F.slice(picked, 1, F.greatest(F.first(wanted), F.lit(1)))


def group_cuts(df: DataFrame, value: str, by=(), per_range: int = 10_000, ranges: int = RANGES) -> DataFrame:
    """Keys and ``__cuts`` for the groups with more than ``per_range`` rows (one row without keys).

    The number of ranges follows the rows of the group, up to ``ranges`` (a power of two). NULL values are left out.
    """
    keys = as_list(by)
    rows = df.where(col(value).isNotNull())
    sizes = rows.groupBy(*map(col, keys)).agg(F.count("*").alias("__rows")).where(F.col("__rows") > per_range)
    sized = join_nullsafe(rows, sizes, keys, "inner") if keys else add_scalars(rows, sizes)
    wanted = F.least(F.lit(ranges), F.ceil(F.col("__rows") / per_range)) - 1
    # as a double: the product with the rows of a group passes a long from 8.4 million rows on
    spot = F.pmod(F.xxhash64(col(value), F.lit("cut")), F.lit(1 << 40)).cast("double")
    sampled = sized.where(spot * F.col("__rows") < (wanted + 1) * F.lit(OVERSAMPLE * (1 << 40)).cast("double"))
    return sampled.groupBy(*map(col, keys)).agg(_cut_values(value, wanted).alias("__cuts"))


def with_range(df: DataFrame, value: str, cuts: DataFrame, by=(), name: str = "__range", ranges: int = RANGES) -> DataFrame:
    """Add the index of the range of each row, from 0: by binary search in the cuts of its group; NULL values go to range 0."""
    keys = as_list(by)
    out = join_nullsafe(df, cuts, keys) if keys else add_scalars(df, cuts)
    out, step = out.withColumn(name, F.lit(0)), ranges // 2
    while step:
        beyond = col(value) >= F.get("__cuts", F.col(name) + (step - 1))
        out, step = out.withColumn(name, F.col(name) + F.when(beyond, step).otherwise(0)), step // 2
    return out.drop("__cuts")


def ranged(df: DataFrame, value: str, by: str | Sequence[str] = (), per_range: int = 10_000, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``__range``: equal values of a group share a range, and the ranges of a group ascend with the value."""
    return with_range(df, value, group_cuts(df, value, by, per_range, ranges), by, ranges=ranges)


def ranged_by_stored(df: DataFrame, value: str, by: str | Sequence[str], per_range: int, ranges: int) -> DataFrame:
    """As ``ranged``, with the cut table written to the scratch folder, so that plans built on the result read ``df`` once."""
    keys = as_list(by)
    path = scratch_path(df.sparkSession, "cuts")
    group_cuts(df.select(*map(col, keys), col(value)), value, keys, per_range, ranges).write.parquet(path)
    cuts = df.sparkSession.read.parquet(path)
    return df.withColumn("__range", F.lit(0)) if cuts.isEmpty() else with_range(df, value, cuts, keys, ranges=ranges)
