"""Numeric parsing, bins, levels and small arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .dates import ColumnOrName, _col

# Magnus coefficients for saturation vapour pressure over water.
MAGNUS_A = 17.625
MAGNUS_B = 243.04

# Ordered level names of the composite score, and the cuts between them.
LEVELS = ("none", "possible", "probable", "intense")
SCORE_CUTS = (0.25, 0.50, 0.75)


def null_if_nan(c: ColumnOrName) -> Column:
    """NaN -> NULL, so that comparisons and aggregates skip it."""
    return F.nanvl(_col(c), F.lit(None).cast("double"))


def to_double(c: ColumnOrName) -> Column:
    """Text -> DOUBLE, NULL when it is no finite-or-infinite number."""
    return null_if_nan(F.trim(_col(c).cast("string")).try_cast("double"))


def parse_eu_number(c: ColumnOrName) -> Column:
    """``1.234,5`` -> 1234.5: dots group thousands, the comma is the decimal mark; blank -> NULL."""
    text = F.regexp_replace(F.trim(_col(c)), r"\.", "")
    return null_if_nan(F.regexp_replace(text, ",", ".").try_cast("double"))


def parse_comma_decimal(c: ColumnOrName) -> Column:
    """``"12,3"`` -> 12.3; quotes are stripped, words such as ``nan`` or ``Ip`` become NULL."""
    text = F.trim(F.regexp_replace(_col(c), "\"", ""))
    return null_if_nan(F.regexp_replace(text, ",", ".").try_cast("double"))


def relative_humidity(temp: ColumnOrName, dewpoint: ColumnOrName) -> Column:
    """Relative humidity in percent from temperature and dew point (both in degrees Celsius)."""

    def exponent(t: Column) -> Column:
        return MAGNUS_A * t / (MAGNUS_B + t)

    return 100 * F.exp(exponent(_col(dewpoint)) - exponent(_col(temp)))


def row_min(*cols: ColumnOrName) -> Column:
    """Smallest value across columns, NULLs skipped."""
    return F.least(*map(_col, cols))


def row_max(*cols: ColumnOrName) -> Column:
    """Largest value across columns, NULLs skipped."""
    return F.greatest(*map(_col, cols))


def flag(cond: Column) -> Column:
    """Condition -> 1/0, with an unknown condition counting as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def gate(c: ColumnOrName, cond: Column) -> Column:
    """Keep the value only where the quality condition holds."""
    return F.when(cond, _col(c))


def valid_until(c: ColumnOrName, key: ColumnOrName, horizon: str, default=None) -> Column:
    """NULL after ``horizon``; up to it an absent value becomes ``default``."""
    value = _col(c) if default is None else F.coalesce(_col(c), F.lit(default))
    return F.when(_col(key) <= F.lit(horizon).cast("date"), value)


def cut_right(c: ColumnOrName, edges: Sequence[float], labels: Sequence) -> Column:
    """Right-closed bins ``(e0, e1], (e1, e2], ...``; values outside all of them give NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    value, out = _col(c), F.lit(None)
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((value > low) & (value <= high), F.lit(label)).otherwise(out)
    return out


def score_to_level(c: ColumnOrName, cuts: Sequence[float] = SCORE_CUTS, names: Sequence[str] = LEVELS) -> Column:
    """Level whose cut is the last one reached; a NULL score stays NULL."""
    value = _col(c)
    out = F.when(value.isNotNull(), F.lit(names[0]))
    for cut, name in zip(cuts, names[1:]):
        out = F.when(value >= cut, F.lit(name)).otherwise(out)
    return out


def map_values(c: ColumnOrName, mapping: Mapping) -> Column:
    """Lookup in a small literal mapping; unknown keys give NULL."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _col(c))


def ordinal(c: ColumnOrName, order: Sequence[str] = LEVELS) -> Column:
    """Rank of a level in its fixed order, from 0."""
    return map_values(c, {name: i for i, name in enumerate(order)})


def one_hot(c: ColumnOrName, values: Sequence, prefix: str) -> dict[str, Column]:
    """One 0/1 column per listed value."""
    return {f"{prefix}{v}": flag(_col(c) == F.lit(v)) for v in values}


def rate_per(num: ColumnOrName, population: ColumnOrName, k: float = 100_000) -> Column:
    """Rate per ``k`` heads; NULL for an empty population."""
    return F.try_divide(_col(num) * F.lit(float(k)), _col(population))


def low_visibility(vis: ColumnOrName, rh: ColumnOrName) -> tuple[Column, Column]:
    """(confirmed, possible) 0/1 flags of reduced visibility.

    Confirmed: under 9 999 m, or under 20 000 m in dry air (humidity under 70 %).
    Possible: no visibility reported and very dry air (humidity under 30 %).
    """
    v, h = _col(vis), _col(rh)
    return flag((v < 9_999) | ((v < 20_000) & (h < 70))), flag(v.isNull() & (h < 30))
