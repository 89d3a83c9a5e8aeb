"""Threshold flags and rule-based composite scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from operator import ge, gt, le, lt

from pyspark.sql import Column, DataFrame, functions as F

from weekwise.functions.numbers import LEVELS, SCORE_CUTS, score_to_level

from ._util import add_group_values, as_list, col
from .ordered import quantiles

_OPS = {">=": ge, ">": gt, "<=": le, "<": lt}


@dataclass(frozen=True)
class Rule:
    """Adds ``weight`` where ``column op threshold``; with ``quantile`` the threshold is that quantile."""

    column: str
    op: str
    threshold: float | None = None
    weight: float = 1.0
    quantile: float | None = None

    def holds(self, threshold: Column) -> Column:
        return F.coalesce(_OPS[self.op](col(self.column), threshold), F.lit(False))


def composite_score(
    df: DataFrame, rules: Sequence[Rule], entity=(), name: str = "score",
    normalize: bool = True, max_weight: float | None = None, bounded: bool = False,
) -> DataFrame:
    """Sum of the weights of the rules that hold (unknown = does not hold), divided by the largest sum.

    Quantile thresholds are taken per entity (or over the table) in one extra aggregate per column.
    """
    keys, out, drop = as_list(entity), df, []
    wanted: dict[str, dict[str, float]] = {}
    for i, r in enumerate(rules):
        if r.quantile is not None:
            wanted.setdefault(r.column, {})[f"__t{i}"] = r.quantile
    if bounded and wanted:
        aggs = [F.percentile(col(c), qv).alias(t) for c, ts in wanted.items() for t, qv in ts.items()]
        limits = df.groupBy(*map(col, keys)).agg(*aggs)
        out = add_group_values(out, limits, keys)
        drop = [t for ts in wanted.values() for t in ts]
    else:
        for c, ts in wanted.items():
            limits = quantiles(df, c, ts, keys)
            out = add_group_values(out, limits, keys)
            drop += ts
    total: Column = F.lit(0.0)
    for i, r in enumerate(rules):
        limit = F.col(f"__t{i}") if r.quantile is not None else F.lit(r.threshold)
        total = total + F.when(r.holds(limit), F.lit(float(r.weight))).otherwise(F.lit(0.0))
    scale = (max_weight or sum(r.weight for r in rules)) if normalize else 1.0
    return out.withColumn(name, total / F.lit(float(scale))).drop(*drop)


def score_and_level(
    df: DataFrame, rules: Sequence[Rule], entity=(), cuts: Sequence[float] = SCORE_CUTS,
    names: Sequence[str] = LEVELS, score: str = "score", level: str = "level",
    normalize: bool = True, bounded: bool = False,
) -> DataFrame:
    out = composite_score(df, rules, entity, score, normalize, bounded=bounded)
    return out.withColumn(level, score_to_level(score, cuts, names))


def threshold_flags(
    df: DataFrame, c: str, qs: dict[str, float], entity=(), strict: bool = False, bounded: bool = False
) -> DataFrame:
    """One 0/1 column per named quantile: value at or over it (``strict``: over it), unknown = 0."""
    keys = as_list(entity)
    limits = quantiles(df, c, {f"__q_{n}": v for n, v in qs.items()}, keys, bounded)
    out = add_group_values(df, limits, keys)
    op = gt if strict else ge
    out = out.withColumns({n: F.coalesce(op(col(c), F.col(f"__q_{n}")), F.lit(False)).cast("int") for n in qs})
    return out.drop(*[f"__q_{n}" for n in qs])


def quantile_flag(df: DataFrame, c: str, q: float, name: str, by=(), bounded: bool = False) -> DataFrame:
    """Value at or over the ``q`` quantile of its own column (per group)."""
    return threshold_flags(df, c, {name: q}, by, bounded=bounded)


def tercile_level(df: DataFrame, c: str, name: str, entity=(), bounded: bool = False) -> DataFrame:
    """0 for no event, else 1..3 by the .33 and .66 quantiles of the positive values."""
    keys = as_list(entity)
    positive = df.where(col(c) > 0)
    limits = quantiles(positive, c, {"__q33": 0.33, "__q66": 0.66}, keys, bounded)
    out = add_group_values(df, limits, keys)
    level = (
        F.when(F.coalesce(col(c), F.lit(0)) <= 0, 0)
        .when(col(c) <= F.col("__q33"), 1)
        .when(col(c) <= F.col("__q66"), 2)
        .otherwise(3)
    )
    return out.withColumn(name, level).drop("__q33", "__q66")


def agreement_flag(df: DataFrame, keys, station: str, stations: Sequence[str], cond: Column, name: str) -> DataFrame:
    """1 for keys at which every one of the listed stations satisfies the condition."""
    hits = [F.bool_or(F.when(col(station) == s, F.coalesce(cond, F.lit(False)))) for s in stations]
    out = df.groupBy(*map(col, as_list(keys))).agg(*[h.alias(f"__h{i}") for i, h in enumerate(hits)])
    every = F.lit(True)
    for i in range(len(stations)):
        every = every & F.coalesce(F.col(f"__h{i}"), F.lit(False))
    return out.withColumn(name, every.cast("int")).drop(*[f"__h{i}" for i in range(len(stations))])
