"""Threshold flags, composite scores and levels."""

from pyspark.sql import functions as F

from weekwise.functions.numbers import cut_right, map_values, ordinal, score_to_level
from weekwise.operators import score as sc
from weekwise.operators.aggregate import z_anomaly
from weekwise.operators.clean import interpolate

from . import query
from .base import FULL, SCORED, full_panel, on, rounded, scored, table, tidy
from .panels import SPANS, spans


@query(rounded(on(SCORED, "SELECT entity, week_start, score, level FROM scored"), "score"))
def composite_score_and_level(spark, sf):
    return tidy(scored(spark, sf).select("entity", "week_start", "score", "level"))


@query(rounded(on(FULL, """
  , t AS (SELECT entity, quantile_cont(exposure, 0.9) AS e90, quantile_cont(exposure, 0.95) AS e95,
            quantile_cont(peak, 0.25) AS p25, quantile_cont(outcome, 0.75) AS o75 FROM full_panel GROUP BY entity),
  s AS (SELECT f.entity, f.week_start, (CASE WHEN exposure >= e90 THEN 1.0 ELSE 0 END + CASE WHEN exposure >= e95 THEN 1.0 ELSE 0 END
     + CASE WHEN peak <= p25 THEN 1.0 ELSE 0 END + CASE WHEN urgent > 0 THEN 1.0 ELSE 0 END
     + CASE WHEN outcome >= o75 THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM full_panel f JOIN t ON f.entity = t.entity)
  SELECT *, CASE WHEN score >= 3 THEN 'intense' WHEN score >= 2 THEN 'probable' WHEN score >= 1 THEN 'possible' ELSE 'none' END AS level FROM s"""),
  "score"))
def percentile_score_per_entity(spark, sf):
    rules = (
        sc.Rule("exposure", ">=", quantile=0.90), sc.Rule("exposure", ">=", quantile=0.95),
        sc.Rule("peak", "<=", quantile=0.25), sc.Rule("urgent", ">", 0), sc.Rule("outcome", ">=", weight=0.5, quantile=0.75),
    )
    out = sc.score_and_level(full_panel(spark, sf), rules, "entity", (1, 2, 3), normalize=False, bounded=True)
    return tidy(out.select("entity", "week_start", "score", "level"))


@query(on(FULL, """
  , t AS (SELECT quantile_cont(exposure, 0.9) AS e90, quantile_cont(exposure, 0.95) AS e95, quantile_cont(peak, 0.25) AS p25 FROM full_panel),
  s AS (SELECT entity, week_start, (CASE WHEN exposure >= e90 THEN 1 ELSE 0 END + CASE WHEN exposure >= e95 THEN 1 ELSE 0 END
     + CASE WHEN peak <= p25 THEN 1 ELSE 0 END)::DOUBLE AS score FROM full_panel, t)
  SELECT * FROM s"""))
def percentile_score_pooled(spark, sf):
    rules = (sc.Rule("exposure", ">=", quantile=0.90), sc.Rule("exposure", ">=", quantile=0.95), sc.Rule("peak", "<=", quantile=0.25))
    return sc.composite_score(full_panel(spark, sf), rules, normalize=False).select("entity", "week_start", "score")


@query(on(FULL, """
  , s AS (SELECT entity, week_start, (CASE WHEN exposure >= 300 THEN 2 ELSE 0 END + CASE WHEN peak >= 400 THEN 1 ELSE 0 END
     + CASE WHEN urgent > 0 THEN 1 ELSE 0 END + CASE WHEN outcome <= 2 THEN 1 ELSE 0 END)::DOUBLE AS score FROM full_panel)
  SELECT *, CASE WHEN score >= 4 THEN 'intense' WHEN score >= 3 THEN 'probable' WHEN score >= 2 THEN 'possible' ELSE 'none' END AS level FROM s"""))
def integer_weight_score(spark, sf):
    rules = (sc.Rule("exposure", ">=", 300, 2), sc.Rule("peak", ">=", 400), sc.Rule("urgent", ">", 0), sc.Rule("outcome", "<=", 2))
    out = sc.score_and_level(full_panel(spark, sf), rules, cuts=(2, 3, 4), normalize=False)
    return out.select("entity", "week_start", "score", "level")


@query(on(FULL, """
  SELECT entity, week_start, CAST(coalesce(exposure >= quantile_cont(exposure, 0.9) OVER (PARTITION BY entity), false) AS INTEGER) AS p90,
         CAST(coalesce(exposure >= quantile_cont(exposure, 0.95) OVER (PARTITION BY entity), false) AS INTEGER) AS p95,
         CAST(coalesce(exposure >= quantile_cont(exposure, 0.99) OVER (PARTITION BY entity), false) AS INTEGER) AS p99 FROM full_panel"""))
def quantile_flags_per_entity(spark, sf):
    out = sc.threshold_flags(full_panel(spark, sf), "exposure", {"p90": 0.9, "p95": 0.95, "p99": 0.99}, "entity", bounded=True)
    return out.select("entity", "week_start", "p90", "p95", "p99")


@query("""
  WITH t AS (SELECT quantile_cont(l_extendedprice, 0.9) AS q90, quantile_cont(l_extendedprice, 0.99) AS q99 FROM lineitem)
  SELECT l_shipdate::DATE AS date, CAST(sum(CAST(l_extendedprice >= q90 AS INTEGER)) AS BIGINT) AS n90,
         CAST(sum(CAST(l_extendedprice >= q99 AS INTEGER)) AS BIGINT) AS n99 FROM lineitem, t GROUP BY 1""")
def quantile_flags_over_table(spark, sf):
    rows = table(spark, sf, "lineitem", "l_shipdate", "l_extendedprice")
    out = sc.threshold_flags(rows, "l_extendedprice", {"f90": 0.9, "f99": 0.99})
    return out.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("f90").alias("n90"), F.sum("f99").alias("n99"))


@query(on(FULL, """
  SELECT entity, week_start, CAST(coalesce(outcome > quantile_cont(outcome, 0.9) OVER (PARTITION BY entity), false) AS INTEGER) AS extreme
  FROM full_panel"""))
def strict_quantile_flags(spark, sf):
    out = sc.threshold_flags(full_panel(spark, sf), "outcome", {"extreme": 0.9}, "entity", strict=True, bounded=True)
    return out.select("entity", "week_start", "extreme")


TERCILE = """CASE WHEN coalesce({x}, 0) <= 0 THEN 0 WHEN {x} <= q33 THEN 1 WHEN {x} <= q66 THEN 2 ELSE 3 END"""


@query(on(FULL, f"""
  , q AS (SELECT quantile_cont(urgent, 0.33) AS q33, quantile_cont(urgent, 0.66) AS q66 FROM full_panel WHERE urgent > 0)
  SELECT entity, week_start, {TERCILE.format(x="urgent")} AS severity FROM full_panel, q"""))
def tercile_severity(spark, sf):
    return sc.tercile_level(full_panel(spark, sf), "urgent", "severity").select("entity", "week_start", "severity")


@query(on(FULL, f"""
  , q AS (SELECT entity, quantile_cont(exposure, 0.33) AS q33, quantile_cont(exposure, 0.66) AS q66
          FROM full_panel WHERE exposure > 0 GROUP BY entity)
  SELECT f.entity, week_start, {TERCILE.format(x="exposure")} AS severity FROM full_panel f LEFT JOIN q ON f.entity = q.entity"""))
def tercile_severity_per_entity(spark, sf):
    out = sc.tercile_level(full_panel(spark, sf), "exposure", "severity", "entity", bounded=True)
    return out.select("entity", "week_start", "severity")


@query(on(FULL, """
  SELECT entity, week_start, CASE WHEN outcome > -1 AND outcome <= 0 THEN 0 WHEN outcome > 0 AND outcome <= 1 THEN 1
    WHEN outcome > 1 AND outcome <= 3 THEN 2 WHEN outcome > 3 AND outcome <= 7 THEN 3 END AS bin FROM full_panel"""))
def right_closed_bins(spark, sf):
    return full_panel(spark, sf).select("entity", "week_start", cut_right("outcome", [-1, 0, 1, 3, 7], [0, 1, 2, 3]).alias("bin"))


@query(on(SCORED, """
  SELECT entity, week_start, level, CASE level WHEN 'none' THEN 0 WHEN 'possible' THEN 1 WHEN 'probable' THEN 2 WHEN 'intense' THEN 3 END AS level_ord,
    CAST(quarter(week_start) = 1 AS INTEGER) AS Q_1, CAST(quarter(week_start) = 2 AS INTEGER) AS Q_2,
    CAST(quarter(week_start) = 3 AS INTEGER) AS Q_3, CAST(quarter(week_start) = 4 AS INTEGER) AS Q_4 FROM scored"""))
def ordinal_and_one_hot(spark, sf):
    from weekwise.functions.numbers import one_hot

    df = scored(spark, sf)
    return df.select("entity", "week_start", "level", ordinal("level").alias("level_ord"),
                     *[e.alias(n) for n, e in one_hot(F.quarter("week_start"), [1, 2, 3, 4], "Q_").items()])


@query(on(SCORED, "SELECT entity, week_start, CASE level WHEN 'none' THEN 'quiet' WHEN 'intense' THEN 'loud' END AS label FROM scored"))
def lookup_in_literal_map(spark, sf):
    return scored(spark, sf).select("entity", "week_start", map_values("level", {"none": "quiet", "intense": "loud"}).alias("label"))


@query("""
  WITH v AS (SELECT CAST(ts AS DATE) AS date, user_id % 3 AS station, value FROM events),
  h AS (SELECT date, bool_or(CASE WHEN station = 0 THEN value < 1 END) AS a, bool_or(CASE WHEN station = 1 THEN value < 1 END) AS b FROM v GROUP BY date)
  SELECT date, CAST(coalesce(a, false) AND coalesce(b, false) AS INTEGER) AS agree FROM h""")
def two_station_agreement(spark, sf):
    e = table(spark, sf, "events", "ts", "user_id", "value").select(
        F.to_date("ts").alias("date"), (F.col("user_id") % 3).alias("station"), "value"
    )
    return sc.agreement_flag(e, "date", "station", [0, 1], F.col("value") < 1, "agree")


@query(rounded(on(SCORED, """
  , i AS (SELECT *, month(week_start) AS mo, row_number() OVER (PARTITION BY entity ORDER BY week_start) AS rn FROM scored),
  b AS (SELECT entity, mo, avg(peak) AS bm, stddev_samp(peak) AS bs FROM i WHERE level = 'none' GROUP BY 1, 2),
  z AS (SELECT i.*, (peak - bm) / nullif(bs, 0) AS z FROM i LEFT JOIN b ON i.entity = b.entity AND i.mo = b.mo),
  n AS (SELECT *, last_value(z IGNORE NULLS) OVER bw AS v0, last_value(CASE WHEN z IS NOT NULL THEN rn END IGNORE NULLS) OVER bw AS i0,
      first_value(z IGNORE NULLS) OVER aw AS v1, first_value(CASE WHEN z IS NOT NULL THEN rn END IGNORE NULLS) OVER aw AS i1
    FROM z WINDOW bw AS (PARTITION BY entity ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  aw AS (PARTITION BY entity ORDER BY week_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  f AS (SELECT entity, week_start, outcome, urgent, coalesce(z, CASE WHEN i1 > i0 THEN v0 + (v1 - v0) * (rn - i0) / (i1 - i0) END, v0, v1, 0) AS z FROM n)
  SELECT entity, week_start, (CASE WHEN z > 0.5 THEN 0.5 ELSE 0 END + CASE WHEN urgent > 0 THEN 0.5 ELSE 0 END
     + CASE WHEN outcome >= 3 THEN 1.0 ELSE 0 END)::DOUBLE / 2 AS score FROM f"""), "score"))
def anomaly_score_with_imputation(spark, sf):
    df = scored(spark, sf).drop("score").withColumns({"mo": F.month("week_start"), "lev": ordinal("level")})
    z = interpolate(z_anomaly(df, "peak", ["entity", "mo"], "lev"), ["z"], "entity")
    rules = (sc.Rule("z", ">", 0.5, 0.5), sc.Rule("urgent", ">", 0, 0.5), sc.Rule("outcome", ">=", 3, 1.0))
    return tidy(sc.composite_score(z, rules).select("entity", "week_start", "score"))


@query(f"""WITH {SPANS}
  SELECT o_orderkey, CASE WHEN e - s > 90 THEN 'intense' WHEN e - s > 60 THEN 'probable' WHEN e - s > 30 THEN 'possible' ELSE 'none' END AS level
  FROM spans""")
def score_to_level_cuts(spark, sf):
    days = F.datediff("e", "s")
    return spans(spark, sf).select("o_orderkey", score_to_level(days, (31, 61, 91)).alias("level"))
