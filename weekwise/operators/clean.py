"""Projections, filters and cleaning rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from weekwise.functions.text import strip_accents

from ._util import as_list, col
from .quality import require_columns

# Helper columns a feed may carry besides its key and measures.
HELPER_COLUMNS = ("year", "island", "code", "island_code")


def select_required(df: DataFrame, cols: Sequence[str], label: str = "table") -> DataFrame:
    """Projection in the given order; an absent column is an error naming the table."""
    require_columns(df, cols, label)
    return df.select(*map(col, cols))


def drop_helpers(df: DataFrame, helpers: Sequence[str] = HELPER_COLUMNS) -> DataFrame:
    return df.drop(*helpers)


def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def clip_period(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Inclusive date range; for a timestamp key the whole last day belongs to it."""
    kind = df.schema[key].dataType.typeName()
    if kind == "date":
        return df.where(col(key).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    upper = F.date_add(F.lit(end).cast("date"), 1).cast(kind)
    return df.where((col(key) >= F.lit(start).cast(kind)) & (col(key) < upper))


def clip_years(df: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Calendar years of the key, written as a range on the key so that it can be pushed down."""
    return clip_period(df, key, f"{first:04d}-01-01", f"{last:04d}-12-31")


def filter_series(
    df: DataFrame, dim: str, value: str | None, kind: str | None = None, base_kind: str | None = None, by=()
) -> DataFrame:
    """Rows of one dimension value (trimmed text; ``None`` = blank dimension).

    With ``kind``/``base_kind``: keep only rows of the base measure type where the selection has
    any (per ``by`` group), otherwise keep all.
    """
    text = F.trim(col(dim))
    out = df.where(text.isNull() | (text == "")) if value is None else df.where(text == value)
    if not kind:
        return out
    is_base = F.trim(col(kind)) == base_kind
    keys = as_list(by)
    if not keys:
        has_base = out.agg(F.coalesce(F.bool_or(is_base), F.lit(False))).scalar()
        return out.where(F.coalesce(is_base, F.lit(False)) | ~has_base)
    groups = out.groupBy(*keys).agg(F.coalesce(F.bool_or(is_base), F.lit(False)).alias("__has_base"))
    return (
        out.join(groups, keys)
        .where(F.coalesce(is_base, F.lit(False)) | ~F.col("__has_base"))
        .drop("__has_base")
    )


def drop_incomplete(df: DataFrame, subset: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows without NULL in ``subset`` and, for intervals, with ``end >= start``."""
    out = df.dropna(subset=list(subset))
    return out.where(col(end) >= col(start)) if start and end else out


def clean_sentinels(
    df: DataFrame,
    value: str,
    quality: str | None = None,
    bad_codes: Sequence[int] = (9,),
    capped: Sequence[float] = (9999, 10000),
    capped_name: str | None = None,
) -> DataFrame:
    """Value -> NULL under a bad quality code or when negative; optional flag for ceiling values."""
    bad = col(value) < 0
    if quality:
        bad = bad | F.coalesce(col(quality).isin(*bad_codes), F.lit(False))
    out = df.withColumn(value, F.when(~F.coalesce(bad, F.lit(False)), col(value)))
    if capped_name:
        out = out.withColumn(capped_name, F.coalesce(col(value).isin(*capped), F.lit(False)))
    return out


def first_column(df: DataFrame, names: Sequence[str]) -> str | None:
    """First of the candidate names the table has."""
    return next((n for n in names if n in df.columns), None)


def filter_by_flag_or_text(df: DataFrame, flag: str, text: str, needle: str) -> DataFrame:
    """Rows with ``flag = 1``; when the flag is absent or constant, rows whose text names the needle.

    Both branches stay in one plan: the flag's spread is a scalar subquery.
    """
    named = F.lower(strip_accents(col(text))).contains(needle.lower())
    if flag not in df.columns:
        return df.where(named)
    informative = df.agg(F.coalesce(F.min(col(flag)) < F.max(col(flag)), F.lit(False))).scalar()
    return df.where(F.when(informative, col(flag) == 1).otherwise(named))


def drop_first_period(df: DataFrame, key: str = "week_start", entity=()) -> DataFrame:
    """Rows after the first key of their entity (its leading, partial period)."""
    keys = as_list(entity)
    if not keys:
        return df.where(col(key) > df.agg(F.min(col(key))).scalar())
    firsts = df.groupBy(*keys).agg(F.min(col(key)).alias("__first"))
    return df.join(firsts, keys).where(col(key) > F.col("__first")).drop("__first")


def clip_intervals(df: DataFrame, start: str, end: str, lo: str, hi: str) -> DataFrame:
    """Intervals that touch ``lo..hi``, with their ends clamped to it."""
    low, high = F.lit(lo).cast("date"), F.lit(hi).cast("date")
    kept = df.where((col(end) >= low) & (col(start) <= high))
    return kept.withColumns({start: F.greatest(col(start), low), end: F.least(col(end), high)})


def flag_implausible(df: DataFrame, cond: Column, name: str = "implausible") -> DataFrame:
    """0/1 flag of a physically impossible combination, unknown counting as 0."""
    return df.withColumn(name, F.coalesce(cond, F.lit(False)).cast("int"))


def unify_spelling(df: DataFrame, c: str, spellings: Mapping[str, str]) -> DataFrame:
    return df.replace(dict(spellings), subset=[c])


def interpolate(df: DataFrame, cols: Sequence[str], entity, order: str = "week_start") -> DataFrame:
    """Fill NULLs linearly by row position between neighbours, edges by the nearest value, else 0.

    Works on a panel: two running windows over the periods of each entity, one forwards and one backwards.
    """
    part = Window.partitionBy(*as_list(entity))
    forward = part.orderBy(col(order).asc()).rowsBetween(Window.unboundedPreceding, 0)
    backward = part.orderBy(col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__i", F.row_number().over(part.orderBy(col(order).asc())))

    def pair(c: str) -> Column:
        return F.when(col(c).isNotNull(), F.struct(F.col("__i").alias("i"), col(c).alias("v")))

    out = out.withColumns({f"__before{k}": F.last(pair(c), True).over(forward) for k, c in enumerate(cols)})
    out = out.withColumns({f"__after{k}": F.last(pair(c), True).over(backward) for k, c in enumerate(cols)})
    filled = {}
    for k, c in enumerate(cols):
        a, b = F.col(f"__before{k}"), F.col(f"__after{k}")
        share = F.try_divide(F.col("__i") - a["i"], b["i"] - a["i"])
        filled[c] = F.coalesce(col(c), a["v"] + (b["v"] - a["v"]) * share, a["v"], b["v"], F.lit(0.0))
    return out.withColumns(filled).drop("__i", *[f"__{s}{k}" for k in range(len(cols)) for s in ("before", "after")])
