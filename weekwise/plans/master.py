"""Master panels: all feeds of an entity, its score, and the roll-up to parents and region."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from weekwise.operators import aggregate as agg
from weekwise.operators.clean import drop_helpers, interpolate
from weekwise.operators.joins import attach, build_master
from weekwise.operators.quality import check_unique
from weekwise.operators.score import Rule, score_and_level

from .domain import PERCENTILE_CUTS, PERCENTILE_RULES, SCORE_RULES

KEYS = ["entity", "week_start"]


def master_panel(outcome: DataFrame, feeds: Sequence[DataFrame], entities: DataFrame, start: str, end: str, check: bool = True) -> DataFrame:
    """Every expected week of every entity with all feeds, entity code and year; feeds keep all columns.

    The calendar comes from the entity table, so an entity without outcome rows keeps its weeks. With ``check`` a
    key that repeats in a feed is an error (one small job per feed, which stops at the first hit).
    """
    parts = [drop_helpers(f) for f in (outcome, *feeds)]
    for k, part in enumerate(parts if check else []):
        if not check_unique(part, KEYS).isEmpty():
            raise ValueError(f"feed {k} has repeated weeks")
    weeks = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.make_dt_interval(days=F.lit(7)))
    calendar = entities.select("entity", F.col("code").alias("entity_code"), F.explode(weeks).alias("week_start"))
    return build_master(calendar, parts, KEYS).withColumn("year", F.year("week_start"))


def assert_master(panel: DataFrame, start: str, end: str) -> DataFrame:
    """Raise unless every entity has each Monday of start..end exactly once (runs one job); returns ``panel``."""
    expected = (date.fromisoformat(end) - date.fromisoformat(start)).days // 7 + 1
    bad = panel.groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("week_start").alias("weeks"), F.count_if(F.weekday("week_start") != 0).alias("odd"))
    wrong = bad.where((F.col("n") != expected) | (F.col("weeks") != expected) | (F.col("odd") > 0)).limit(5).collect()
    if wrong:
        raise ValueError(f"expected {expected} weeks per entity: {[tuple(r) for r in wrong]}")
    return panel


def tmax_anomaly(master: DataFrame, event_level: str = "dust_level_week") -> DataFrame:
    """Standardised maximum temperature against the non-event weeks of its month."""
    rows = master.withColumn("month", F.month("week_start"))
    return agg.z_anomaly(rows, "tmax_c_max", ["entity", "month"], event_level, "tmax_anomaly")


def dust_score(master: DataFrame, event_level: str = "dust_level_week", rules: Sequence[Rule] = SCORE_RULES) -> DataFrame:
    """Current score: anomaly, gap filling by interpolation, weighted rules over 4, level at quarters."""
    inputs = sorted({r.column for r in rules})
    rows = tmax_anomaly(master, event_level)
    rows = rows.withColumn("low_vis_confirmed_any_week", F.col("low_vis_confirmed_any_week").cast("double"))
    filled = interpolate(rows, inputs, "entity")
    return score_and_level(filled, rules).select(*KEYS, "score", "level")


def percentile_score(master: DataFrame) -> DataFrame:
    """Percentile score: thresholds are the entity's own quantiles."""
    out = score_and_level(master, PERCENTILE_RULES, "entity", PERCENTILE_CUTS, normalize=False, bounded=True)
    return out.select(*KEYS, "score", "level")


def parent_panel(scores: DataFrame, entities: DataFrame, outcome: DataFrame) -> DataFrame:
    """Entity levels -> parent exposure, joined with the parent's outcome and population."""
    up = agg.weighted_rollup(scores, entities, "entity", "level")
    totals = entities.groupBy("parent").agg(F.sum("population").alias("population"))
    joined = attach(up, outcome, ["parent", "week_start"]).join(totals, "parent")
    return agg.add_rate(joined, "deaths", "population", "deaths_per_100k")


def region_panel(parents: DataFrame, n_parents: int = 2) -> DataFrame:
    """Parents -> region, weeks that every parent has."""
    return agg.region_rollup(parents, n_parents, outcome="deaths")


def regression_table(master: DataFrame, scores: DataFrame, entities: Sequence[str]) -> DataFrame:
    """Modelling table of some entities: level rank, its lags, the lagged outcome and quarter indicators."""
    from weekwise.functions.numbers import one_hot, ordinal
    from weekwise.operators.window import add_lags

    rows = attach(master, scores, KEYS).where(F.col("entity").isin(*entities))
    rows = rows.withColumns({"dust_ordinal": ordinal("level"), "quarter": F.quarter("week_start")})
    rows = rows.withColumns(one_hot("quarter", [1, 2, 3, 4], "Q_"))
    rows = add_lags(rows, "dust_ordinal", [1, 2], "entity")
    return add_lags(rows, "deaths_week", [1], "entity")
