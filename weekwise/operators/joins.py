"""Joins of feeds onto a calendar, attachment of derived tables and patching from donors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from weekwise.functions.dates import minutes_from

from ._util import as_list, col
from .dedup import dedup_first


def build_master(calendar: DataFrame, feeds: Sequence[DataFrame], keys) -> DataFrame:
    """Calendar left-joined with every feed, each unique on the keys.

    All joins use the same keys, so the growing left side keeps its partitioning from join to join.
    """
    names, out = as_list(keys), calendar
    for feed in feeds:
        out = out.join(feed, names, "left")
    return out


def attach(df: DataFrame, other: DataFrame, keys) -> DataFrame:
    """Left join that replaces columns of the same name by those of ``other``."""
    names = as_list(keys)
    overlap = [c for c in other.columns if c in df.columns and c not in names]
    return df.drop(*overlap).join(other, names, "left")


def join_inner(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return a.join(b, as_list(keys), "inner")


def join_suffixed(a: DataFrame, b: DataFrame, keys, suffixes=("_x", "_y"), how: str = "inner") -> DataFrame:
    """Join in which columns of the same name get a suffix; an empty suffix on one side keeps the name,
    ``None`` drops that side's column."""
    names = as_list(keys)
    clash = [c for c in a.columns if c in b.columns and c not in names]

    def shaped(df: DataFrame, suffix: str | None) -> DataFrame:
        if suffix is None:
            return df.drop(*clash)
        return df.withColumnsRenamed({c: c + suffix for c in clash if suffix})

    return shaped(a, suffixes[0]).join(shaped(b, suffixes[1]), names, how)


def lookup(df: DataFrame, c: str, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join a lookup table on ``c = key``; its size decides at run time whether it is broadcast."""
    return df.join(table.withColumnRenamed(key, "__k"), col(c) == F.col("__k"), how).drop("__k")


def canonical_entity(df: DataFrame, c: str, aliases: DataFrame, name: str = "entity") -> DataFrame:
    """Map a spelled name to its canonical id through an ``(alias, canonical)`` table.

    Both sides are normalised the same way; unknown names give NULL.
    """
    from weekwise.functions.text import normalize_name

    table = aliases.select(normalize_name("alias").alias("__alias"), F.col("canonical").alias(name)).distinct()
    return (
        df.withColumn("__norm", normalize_name(c))
        .join(table, F.col("__norm") == F.col("__alias"), "left")
        .drop("__norm", "__alias")
    )


def rows_in_both(donor: DataFrame, main: DataFrame, keys) -> DataFrame:
    """Donor rows whose key the main table also has."""
    names = as_list(keys)
    return donor.join(main.select(*names), names, "left_semi")


def rows_only_in(donor: DataFrame, main: DataFrame, keys) -> DataFrame:
    """Donor rows whose key the main table lacks."""
    names = as_list(keys)
    return donor.join(main.select(*names), names, "left_anti")


def patch_from_donor(
    main: DataFrame,
    donor: DataFrame,
    keys,
    flag_col: str,
    label,
    donor_col: str = "donor_station",
    append: bool = False,
) -> DataFrame:
    """Replace the values of matching rows by the donor's, NULLs included, and mark them.

    ``flag_col`` becomes 1 and ``donor_col`` the label (a literal, or a donor column given as Column)
    on patched rows, NULL-preserving elsewhere. ``append`` also adds donor rows with new keys.
    """
    names = as_list(keys)
    values = [c for c in donor.columns if c not in names and c in main.columns]
    tag = label if not isinstance(label, str) else F.lit(label)
    side = donor.select(
        *map(col, names), *[col(c).alias(f"__d_{c}") for c in values], tag.alias("__label"), F.lit(True).alias("__hit")
    )
    hit = F.col("__hit").isNotNull()
    joined = main.join(side, names, "left")
    old_flag = col(flag_col) if flag_col in main.columns else F.lit(0)
    old_label = col(donor_col) if donor_col in main.columns else F.lit(None).cast("string")
    patched = joined.select(
        *map(col, names),
        *[F.when(hit, col(f"__d_{c}")).otherwise(col(c)).alias(c) if c in values else col(c)
          for c in main.columns if c not in (*names, flag_col, donor_col)],
        F.when(hit, 1).otherwise(old_flag).cast("int").alias(flag_col),
        F.when(hit, F.col("__label")).otherwise(old_label).alias(donor_col),
    )
    if not append:
        return patched
    extra = rows_only_in(donor, main, names).select(
        *map(col, names), *[col(c) for c in values], F.lit(1).alias(flag_col), tag.alias(donor_col)
    )
    return patched.unionByName(extra, allowMissingColumns=True)


def require_overlap(main: DataFrame, donor: DataFrame, keys) -> None:
    """Error when no donor row matches the main table (runs a job that stops at the first match)."""
    if rows_in_both(donor, main, keys).isEmpty():
        raise ValueError("donor and main table have no key in common")


def nearest_in_day(
    df: DataFrame, keys: Sequence[str], ts: str, target_minute: int = 720, tolerance: int = 90
) -> DataFrame:
    """Per key and UTC day the observation closest to a time of day, ties to the earlier one.

    Adds ``date`` and ``abs_min_from_target``; days without an observation in tolerance have no row.
    """
    near = df.withColumns(
        {"date": F.to_date(col(ts)), "abs_min_from_target": minutes_from(col(ts), target_minute)}
    ).where(F.col("abs_min_from_target") <= tolerance)
    return dedup_first(near, [*keys, "date"], ["abs_min_from_target", ts])


def map_column(df: DataFrame, c: str, mapping: Mapping, name: str) -> DataFrame:
    from weekwise.functions.numbers import map_values

    return df.withColumn(name, map_values(c, mapping))
