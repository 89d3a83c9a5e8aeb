"""Analysis jobs: exposure-outcome report, regression comparison and the audit of a master panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weekwise.operators import models, quality, report, resample, stats
from weekwise.operators._util import join_nullsafe

from .domain import WEATHER_RANGES


def exposure_outcome_report(panel: DataFrame, level: str = "level", score: str = "score", y: str = "deaths_week") -> dict[str, DataFrame]:
    """The result tables of an exposure-outcome study; each is lazy and independent of the others."""
    return {
        "outcome_by_level": report.outcome_by_level(panel, level, y),
        "anova": stats.anova(panel, level, y, "entity"),
        "pairwise": stats.pairwise_ttests(panel, level, y, by="entity", against="intense"),
        "lags": stats.lag_corr(panel, score, y, [0, 1, 2], [1, 2], "entity"),
        "lags_deseasonalised": stats.lag_corr(panel, score, y, [0, 1, 2], [1, 2], "entity", season=F.weekofyear("week_start")),
        "months": report.level_by_month(panel, level),
        "seasonality": report.seasonality(panel, y, F.month("week_start"), "month", "entity"),
        "findings": stats.findings(panel, score, level, y, "entity"),
    }


def regression_report(rows: DataFrame, y: str = "deaths_week") -> dict[str, DataFrame]:
    """Model 1 (level, temperature, quarters) and model 3 (with the lagged outcome), per entity."""
    base = ["dust_ordinal", "temp_c_mean", "Q_1", "Q_2", "Q_3"]
    full = [*base, f"{y.replace('_week', '')}_lag1" if f"{y.replace('_week', '')}_lag1" in rows.columns else f"{y}_lag1"]
    m1, m3 = models.ols(rows, base, y, "entity"), models.ols(rows, full, y, "entity")
    res1 = models.residuals(rows, m1, base, y, "entity")
    res3 = models.residuals(rows, m3, full, y, "entity")
    watson = models.durbin_watson(res1, "entity").withColumn("model", F.lit("M1")).unionByName(
        models.durbin_watson(res3, "entity").withColumn("model", F.lit("M3"))
    )
    comparison = models.compare_models({"M1": m1, "M3": m3}, "entity")
    return {
        "comparison": join_nullsafe(comparison, watson, ["entity", "model"]),
        "coefficients": models.coefficients(m3, "entity"),
        "vif": models.vif(rows, base, "entity"),
        "normality": models.jarque_bera(res3, "residual", "entity"),
    }


def master_audit(panel: DataFrame, y: str = "deaths_week", x: str = "PM10") -> dict[str, DataFrame]:
    """Structure, ranges, extremes and missingness of a master panel, with the traffic-light verdict."""
    structure = quality.audit_structure(panel, y, "entity")
    verdict = structure.withColumn(
        "verdict", quality.traffic_light(F.col("null_pct"), F.col("duplicates"), F.col("missing_pct"))
    )
    logic = {"tmax<tmin": ("tmax_c_mean", F.col("tmax_c_mean") < F.col("tmin_c_mean"))}
    return {
        "structure": verdict,
        "structure_flags": quality.structure_flags(panel, y, "entity"),
        "ranges": quality.audit_ranges(panel, WEATHER_RANGES, "entity", logic),
        "range_flags": quality.range_flags(panel, WEATHER_RANGES, ["entity", "week_start"], logic),
        "missing": quality.missing_table(panel, by="entity"),
        "extremes": resample.extreme_audit(panel, x, y, "entity"),
    }
