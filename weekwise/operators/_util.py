from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def as_list(x: str | Sequence[str] | None) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def all_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def q(name: str) -> str:
    """Back-ticked column name, for names such as ``PM2.5``."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def join_nullsafe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on keys that may be NULL; the right side's key columns are dropped."""
    if not keys:
        raise ValueError("need at least one key")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = all_of(left[q(k)].eqNullSafe(renamed[q(f"__r_{k}")]) for k in keys)
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def stack_rows(df: DataFrame, keep: Sequence[str], name: str, rows: dict[str, dict[str, Column]]) -> DataFrame:
    """Turn one wide row into one row per entry of ``rows`` (label -> output columns)."""
    packed = F.array(
        *[F.struct(F.lit(label).alias(name), *[c.alias(k) for k, c in cols.items()]) for label, cols in rows.items()]
    )
    return df.select(*[col(k) for k in keep], F.explode(packed).alias("__row")).select(
        *[col(k) for k in keep], "__row.*"
    )


def add_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, through a single scalar subquery."""
    names = one_row.columns
    packed = one_row.select(F.struct(*map(col, names))).scalar()
    return df.withColumn("__one", packed).withColumns({n: F.col("__one")[n] for n in names}).drop("__one")


def add_group_values(df: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add per-group values: a join on the keys, or a scalar subquery when there are none."""
    return join_nullsafe(df, values, keys) if keys else add_scalars(df, values)
