"""Window operators on the panel."""

from pyspark.sql import functions as F

from weekwise.operators import window as win
from weekwise.operators.aggregate import z_anomaly
from weekwise.operators.clean import interpolate
from weekwise.operators.score import threshold_flags

from . import query
from .base import FULL, PANEL, SCORED, full_panel, on, panel, rounded, scored, tidy

W = "OVER (PARTITION BY entity ORDER BY week_start"


@query(on(FULL, f"""
  SELECT entity, week_start, outcome, lag(exposure, 1) {W}) AS exposure_lag1, lag(exposure, 2) {W}) AS exposure_lag2,
         lead(outcome, 1) {W}) AS outcome_lead1, lead(outcome, 2) {W}) AS outcome_lead2 FROM full_panel"""))
def lags_and_leads(spark, sf):
    df = win.add_lags(full_panel(spark, sf), "exposure", [1, 2], "entity")
    df = win.add_leads(df, "outcome", [1, 2], "entity")
    return df.select("entity", "week_start", "outcome", "exposure_lag1", "exposure_lag2", "outcome_lead1", "outcome_lead2")


@query(rounded(on(FULL, f"""
  SELECT entity, week_start, avg(outcome) {W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS outcome_ma8
  FROM full_panel"""), "outcome_ma8"))
def moving_average(spark, sf):
    df = win.moving_avg(full_panel(spark, sf), "outcome", 8, "entity")
    return tidy(df.select("entity", "week_start", "outcome_ma8"))


@query(rounded(on(FULL, """
  SELECT entity, week_start,
         outcome - avg(outcome) OVER (PARTITION BY entity, weekofyear(week_start)) AS outcome_anom,
         exposure - avg(exposure) OVER (PARTITION BY entity, weekofyear(week_start)) AS exposure_anom
  FROM full_panel"""), "outcome_anom exposure_anom"))
def seasonal_anomaly(spark, sf):
    df = win.anomaly(full_panel(spark, sf), ["outcome", "exposure"], F.weekofyear("week_start"), "entity")
    return tidy(df.select("entity", "week_start", "outcome_anom", "exposure_anom"))


@query(rounded(on(FULL, """
  SELECT entity, CAST(month(week_start) AS INTEGER) AS month, avg(exposure) AS exposure_clim, avg(outcome) AS outcome_clim
  FROM full_panel GROUP BY 1, 2"""), "exposure_clim outcome_clim"))
def climatology_by_month(spark, sf):
    return tidy(win.climatology(full_panel(spark, sf), ["exposure", "outcome"], F.month("week_start"), "month", "entity"))


@query(rounded(on(SCORED, """
  , lv AS (SELECT *, month(week_start) AS month,
             CASE level WHEN 'none' THEN 0 WHEN 'possible' THEN 1 WHEN 'probable' THEN 2 ELSE 3 END AS lev FROM scored),
  b AS (SELECT entity, month, avg(peak) AS baseline_mean, stddev_samp(peak) AS baseline_std
        FROM lv WHERE lev = 0 OR lev IS NULL GROUP BY 1, 2)
  SELECT l.entity, l.week_start, b.baseline_mean, b.baseline_std,
         (l.peak - b.baseline_mean) / nullif(b.baseline_std, 0) AS z
  FROM lv l LEFT JOIN b ON l.entity = b.entity AND l.month = b.month"""), "baseline_mean baseline_std z"))
def standardised_anomaly(spark, sf):
    from weekwise.functions.numbers import ordinal

    df = scored(spark, sf).withColumns({"month": F.month("week_start"), "lev": ordinal("level")})
    out = z_anomaly(df, "peak", ["entity", "month"], "lev")
    return tidy(out.select("entity", "week_start", "baseline_mean", "baseline_std", "z"))


FLAGGED = FULL + """,
thr AS (SELECT entity, quantile_cont(exposure, 0.9) AS q FROM full_panel GROUP BY entity),
flagged AS (SELECT f.*, CAST(coalesce(f.exposure > t.q, false) AS INTEGER) AS hot
            FROM full_panel f JOIN thr t ON f.entity = t.entity),
marked AS (SELECT *, CASE WHEN hot = 1 AND coalesce(lag(hot) OVER (PARTITION BY entity ORDER BY week_start), 0) = 0
                          THEN 1 ELSE 0 END AS st FROM flagged),
numbered AS (SELECT *, CASE WHEN hot = 1 THEN CAST(sum(st) OVER (PARTITION BY entity ORDER BY week_start
                          ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS episode_id FROM marked)"""


def flagged(spark, sf):
    return threshold_flags(full_panel(spark, sf), "exposure", {"hot": 0.9}, "entity", strict=True, bounded=True)


@query(on(FLAGGED, "SELECT entity, week_start, hot, episode_id FROM numbered"))
def episode_ids(spark, sf):
    return win.episodes(flagged(spark, sf), "hot", "entity").select("entity", "week_start", "hot", "episode_id")


@query(rounded(on(FLAGGED, """
  SELECT entity, episode_id, min(week_start) AS start, max(week_start) AS "end", count(*) AS weeks,
         max(exposure) AS peak, avg(exposure) AS mean, sum(exposure) AS total,
         CAST(sum(CAST(urgent > 0 AS INTEGER)) AS BIGINT) AS overlap_weeks, max(CAST(urgent > 0 AS INTEGER)) AS overlaps,
         CASE WHEN count(*) = 1 THEN '1-week' ELSE '2+ weeks' END AS episode_type
  FROM numbered WHERE episode_id IS NOT NULL GROUP BY 1, 2"""), "peak mean total"))
def episode_table(spark, sf):
    df = win.episodes(flagged(spark, sf), "hot", "entity").withColumn("urgent", (F.col("urgent") > 0).cast("int"))
    return tidy(win.episode_table(df, "entity", x="exposure", overlap="urgent"))


@query(on(PANEL, """
  , thr AS (SELECT entity, quantile_cont(exposure, 0.6) AS q FROM panel GROUP BY entity),
  f AS (SELECT p.entity, p.week_start, CAST(coalesce(p.exposure >= t.q, false) AS INTEGER) AS hot,
               lag(p.week_start) OVER (PARTITION BY p.entity ORDER BY p.week_start) AS prev
        FROM panel p JOIN thr t ON p.entity = t.entity),
  m AS (SELECT *, CASE WHEN hot = 1 AND (coalesce(lag(hot) OVER (PARTITION BY entity ORDER BY week_start), 0) = 0
                       OR week_start - prev > 7) THEN 1 ELSE 0 END AS st FROM f)
  SELECT entity, week_start, CASE WHEN hot = 1 THEN CAST(sum(st) OVER (PARTITION BY entity ORDER BY week_start
         ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS episode_id FROM m"""))
def episode_ids_by_calendar(spark, sf):
    df = threshold_flags(panel(spark, sf), "exposure", {"hot": 0.6}, "entity", bounded=True)
    return win.episodes(df, "hot", "entity", by="calendar").select("entity", "week_start", "episode_id")


@query(on(FULL, f"""
  , c AS (SELECT *, CASE WHEN lag(missing) {W}) = missing THEN 0 ELSE 1 END AS ch FROM full_panel),
  r AS (SELECT *, CAST(sum(ch) {W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM c)
  SELECT entity, run_id, min(missing) AS value, min(week_start) AS start, max(week_start) AS "end", count(*) AS length
  FROM r GROUP BY 1, 2"""))
def run_lengths(spark, sf):
    return win.runs(full_panel(spark, sf), "missing", "entity")


@query(on(FULL, f"""
  , p AS (SELECT *, week_start - CAST(7 * row_number() {W}) AS INTEGER) AS g
          FROM (SELECT entity, week_start, CASE WHEN missing = 1 THEN 0 ELSE least(outcome / 7, 1) END AS cov FROM full_panel)
          WHERE cov < 4 / 7)
  SELECT entity, min(week_start) AS gap_start, max(week_start) + 6 AS gap_end, count(*) AS weeks FROM p GROUP BY entity, g"""))
def coverage_gaps(spark, sf):
    df = panel(spark, sf).withColumn("cov", F.least(F.col("outcome") / 7, F.lit(1.0)))
    return win.detect_gaps(df, "entity", "cov")


@query(on(SCORED, f"""
  SELECT entity, CAST(count(*) FILTER (WHERE prev IS NULL OR prev <> level) AS BIGINT) AS changes
  FROM (SELECT *, lag(level) {W}) AS prev FROM scored) GROUP BY entity"""))
def level_changes(spark, sf):
    return win.count_changes(scored(spark, sf), "level", "entity", "week_start")


@query(rounded(on(FULL, """
  , i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY week_start) AS rn FROM full_panel),
  n AS (SELECT *,
      last_value(exposure IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN exposure IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS i0,
      first_value(exposure IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN exposure IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS i1
    FROM i WINDOW b AS (PARTITION BY entity ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  a AS (PARTITION BY entity ORDER BY week_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT entity, week_start, coalesce(exposure, CASE WHEN i1 > i0 THEN v0 + (v1 - v0) * (rn - i0) / (i1 - i0) END,
         v0, v1, 0) AS exposure FROM n"""), "exposure"))
def linear_interpolation(spark, sf):
    df = interpolate(full_panel(spark, sf), ["exposure"], "entity")
    return tidy(df.select("entity", "week_start", "exposure"))


@query(rounded(on(FULL, """
  SELECT entity, week_start, coalesce(exposure, quantile_cont(exposure, 0.5) OVER (PARTITION BY entity)) AS exposure,
         coalesce(peak, quantile_cont(peak, 0.5) OVER (PARTITION BY entity)) AS peak
  FROM full_panel"""), "exposure peak"))
def median_imputation(spark, sf):
    df = win.impute_median(full_panel(spark, sf), ["exposure", "peak"], "entity")
    return tidy(df.select("entity", "week_start", "exposure", "peak"))


EDGES5 = ", ".join(f"quantile_cont(outcome, {i / 5})" for i in range(6))


@query(on(FULL, f"""
  , e AS (SELECT list_distinct([{EDGES5}]) AS edges FROM full_panel)
  SELECT entity, week_start, CAST(greatest(len(list_filter(edges, lambda x: x < outcome)) - 1, 0) AS INTEGER) AS bin
  FROM full_panel, e"""))
def quantile_bins(spark, sf):
    """Pooled over all entities, so the edges come from the ladder."""
    return win.quantile_bins(full_panel(spark, sf), "outcome", 5, "bin").select("entity", "week_start", "bin")


EDGES10 = ", ".join(f"quantile_cont(exposure, {i / 10})" for i in range(11))


@query(on(FULL, f"""
  , e AS (SELECT entity, list_distinct([{EDGES10}]) AS edges FROM full_panel GROUP BY entity)
  SELECT f.entity, week_start, CASE WHEN exposure IS NOT NULL
         THEN CAST(greatest(len(list_filter(edges, lambda x: x < exposure)) - 1, 0) AS INTEGER) END AS bin
  FROM full_panel f JOIN e ON f.entity = e.entity"""))
def quantile_bins_per_entity(spark, sf):
    df = win.quantile_bins(full_panel(spark, sf), "exposure", 10, "bin", "entity", bounded=True)
    return df.select("entity", "week_start", "bin")


@query(on(FULL, f"""
  SELECT entity, week_start, CAST(row_number() {W}) - 1 AS INTEGER) AS row_index,
         CAST((row_number() {W}) - 1) % 2 AS INTEGER) AS parity FROM full_panel"""))
def row_positions(spark, sf):
    return win.row_index(full_panel(spark, sf), "entity").select("entity", "week_start", "row_index", "parity")


@query(on(FLAGGED, f"""
  , b AS (SELECT *, CAST(hot = 1 AND missing = 0 AND urgent = 1 AS INTEGER) AS hot_and_urgent,
                 CAST(hot = 1 AND NOT (urgent = 1) AS INTEGER) AS hot_not_urgent FROM flagged)
  SELECT entity, week_start, hot_and_urgent, hot_not_urgent, lag(hot_and_urgent, 1) {W}) AS hot_and_urgent_lag1,
         lag(hot_not_urgent, 1) {W}) AS hot_not_urgent_lag1 FROM b"""))
def interaction_flags_with_lags(spark, sf):
    df = win.interaction_flags(flagged(spark, sf), "hot", "urgent", [1], "entity")
    return df.select("entity", "week_start", "hot_and_urgent", "hot_not_urgent", "hot_and_urgent_lag1", "hot_not_urgent_lag1")


@query(on(FULL, "SELECT entity, week_start, outcome FROM full_panel QUALIFY week_start > min(week_start) OVER (PARTITION BY entity)"))
def drop_leading_period(spark, sf):
    from weekwise.operators.clean import drop_first_period

    return drop_first_period(full_panel(spark, sf), "week_start", "entity").select("entity", "week_start", "outcome")
