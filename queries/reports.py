"""Report tables on the scored panel."""

from pyspark.sql import functions as F

from weekwise.functions.numbers import cut_right
from weekwise.operators import report as rp
from weekwise.operators.score import threshold_flags

from . import query
from .base import FULL, PARENTS, SCORED, full_panel, on, parents, rounded, scored, table, tidy

MOMENTS = "count({y}) AS n, avg({y}) AS mean, stddev_samp({y}) AS std, min({y}) AS min, max({y}) AS max"
M = MOMENTS.format(y="outcome")


@query(rounded(on(SCORED, f"""
  , l AS (SELECT * FROM (VALUES ('none', 0), ('possible', 1), ('probable', 2), ('intense', 3), ('extreme', 4)) t(level, level_order)),
  s AS (SELECT level, {M}, quantile_cont(outcome, 0.5) AS median FROM scored WHERE outcome IS NOT NULL GROUP BY level)
  SELECT l.level, level_order, coalesce(n, 0) AS n, mean, std, min, max, median FROM l LEFT JOIN s ON l.level = s.level"""), "mean std median"))
def outcome_by_level(spark, sf):
    """A fifth level that never occurs shows that empty levels are kept."""
    order = ["none", "possible", "probable", "intense", "extreme"]
    return tidy(rp.outcome_by_level(scored(spark, sf), "level", "outcome", order))


@query(rounded(on(SCORED, f"""
  , s AS (SELECT level, {M} FROM scored GROUP BY level)
  SELECT *, std / sqrt(n) AS se, mean - 1.96::DOUBLE * std / sqrt(n) AS ci_low, mean + 1.96::DOUBLE * std / sqrt(n) AS ci_high FROM s"""),
  "mean std se ci_low ci_high"))
def mean_with_interval(spark, sf):
    return tidy(rp.mean_ci(scored(spark, sf), "level", "outcome"))


HOT = SCORED + """,
t90 AS (SELECT entity, quantile_cont(peak, 0.9) AS q FROM scored GROUP BY entity),
hot AS (SELECT s.*, CAST(coalesce(peak >= q, false) AS INTEGER) AS heat, CAST(level IN ('probable', 'intense') AS INTEGER) AS dust
        FROM scored s JOIN t90 t ON s.entity = t.entity)"""


def hot(spark, sf):
    df = threshold_flags(scored(spark, sf), "peak", {"heat": 0.9}, "entity", bounded=True)
    return df.withColumn("dust", F.col("level").isin("probable", "intense").cast("int"))


@query(rounded(on(HOT, f"""
  , s AS (SELECT heat, dust, {M}, quantile_cont(outcome, 0.5) AS median FROM hot GROUP BY 1, 2),
  g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(heat, dust))
  SELECT g.heat, g.dust, n, mean, std, min, max, median FROM g LEFT JOIN s ON g.heat = s.heat AND g.dust = s.dust"""), "mean std median"))
def interaction_grid(spark, sf):
    return tidy(rp.interaction_table(hot(spark, sf), "heat", "dust", "outcome", full=True))


@query(rounded(on(HOT, f"SELECT heat, dust, {M}, quantile_cont(outcome, 0.5) AS median FROM hot GROUP BY 1, 2"), "mean std median"))
def interaction_cells(spark, sf):
    return tidy(rp.interaction_table(hot(spark, sf), "heat", "dust", "outcome"))


@query(on(HOT, """
  SELECT CASE WHEN heat = 1 AND dust = 1 THEN 'both' WHEN heat = 1 THEN 'heat_only' WHEN dust = 1 THEN 'dust_only' ELSE 'neither' END AS combo,
         count(*) AS n FROM hot GROUP BY 1"""))
def combination_labels(spark, sf):
    df = hot(spark, sf).withColumn("combo", rp.combo_label("heat", "dust", "heat", "dust"))
    return rp.group_counts(df, "combo")


@query(rounded("""
  WITH e AS (SELECT event_type AS a, CASE WHEN value >= 40 THEN 'high' ELSE 'low' END AS b FROM events),
  c AS (SELECT a, b, count(*) AS n, CAST(grouping(a) AS INTEGER) AS is_total_a, CAST(grouping(b) AS INTEGER) AS is_total_b FROM e GROUP BY CUBE (a, b)),
  tot AS (SELECT count(*) AS t FROM e)
  SELECT c.a, c.b, c.n, c.is_total_a, c.is_total_b, c.n / r.n AS row_share, c.n / k.n AS col_share, c.n / t AS share
  FROM c JOIN c r ON r.is_total_b = 1 AND r.is_total_a = c.is_total_a AND r.a IS NOT DISTINCT FROM c.a
  JOIN c k ON k.is_total_a = 1 AND k.is_total_b = c.is_total_b AND k.b IS NOT DISTINCT FROM c.b, tot""", "row_share col_share share"))
def crosstab_with_margins(spark, sf):
    e = table(spark, sf, "events", "event_type", "value").select(
        F.col("event_type").alias("a"), F.when(F.col("value") >= 40, "high").otherwise("low").alias("b"))
    df = rp.crosstab(e, "a", "b")
    return tidy(df.withColumns({c: F.col(c).cast("int") for c in ("is_total_a", "is_total_b")}))


@query(on(SCORED, """
  SELECT CAST(month(week_start) AS INTEGER) AS month, count(*) FILTER (WHERE level = 'none') AS none, count(*) FILTER (WHERE level = 'possible') AS possible,
    count(*) FILTER (WHERE level = 'probable') AS probable, count(*) FILTER (WHERE level = 'intense') AS intense FROM scored GROUP BY 1"""))
def levels_by_month(spark, sf):
    return rp.level_by_month(scored(spark, sf), "level")


@query(rounded("""
  WITH e AS (SELECT CASE WHEN event_type <> 'view' THEN event_type END AS kind FROM events)
  SELECT kind, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM e) AS pct FROM e GROUP BY 1""", "pct"))
def value_counts_with_null(spark, sf):
    e = table(spark, sf, "events", "event_type").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"))
    return tidy(rp.value_counts(e, "kind"))


@query(on(SCORED, "SELECT score, level, count(*) AS n FROM scored GROUP BY 1, 2"))
def score_level_groups(spark, sf):
    return rp.group_counts(scored(spark, sf), ["score", "level"])


Q5 = ", ".join(f"quantile_cont(exposure, {q}) AS q{round(100 * q):02d}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))


@query(rounded(on(SCORED, f"SELECT level, {Q5} FROM scored WHERE exposure IS NOT NULL GROUP BY level"), "q10 q25 q50 q75 q90"))
def quantile_table_by_level(spark, sf):
    return tidy(rp.quantiles_by(scored(spark, sf), "level", "exposure"))


def _summary_sql(c: str) -> str:
    v = f"{c}::DOUBLE"
    return f"""SELECT '{c}' AS "column", {MOMENTS.format(y=v)}, quantile_cont({v}, 0.25) AS p25, quantile_cont({v}, 0.5) AS p50,
      quantile_cont({v}, 0.75) AS p75 FROM full_panel"""


@query(rounded(on(FULL, " UNION ALL ".join(map(_summary_sql, ("outcome", "exposure", "peak")))), "mean std p25 p50 p75"))
def numeric_summary(spark, sf):
    return tidy(rp.num_summary(full_panel(spark, sf), ["outcome", "exposure", "peak"]))


@query(rounded(f"""
  SELECT l_returnflag, {MOMENTS.format(y="l_extendedprice")}, count(DISTINCT l_extendedprice) AS n_unique, skewness(l_extendedprice) AS skew,
    quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS p75,
    quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.95) AS p95, quantile_cont(l_extendedprice, 0.99) AS p99,
    quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr,
    quantile_cont(l_extendedprice, 0.95) / quantile_cont(l_extendedprice, 0.5) AS p95_over_median,
    max(l_extendedprice) / quantile_cont(l_extendedprice, 0.95) AS max_over_p95
  FROM lineitem GROUP BY 1""", "mean std skew p25 median p75 p90 p95 p99 iqr p95_over_median max_over_p95", 5))
def distribution_shape(spark, sf):
    return tidy(rp.dist_stats(table(spark, sf, "lineitem", "l_returnflag", "l_extendedprice"), "l_extendedprice", "l_returnflag"), 5)


@query(on(FULL, """
  SELECT CAST(month(week_start) AS INTEGER) AS month, count(outcome) AS n, round(avg(outcome) + 0.00012345678::DOUBLE, 2) AS mean,
         round(stddev_samp(outcome) + 0.00012345678::DOUBLE, 2) AS std, CAST(min(outcome) AS DOUBLE) AS min, CAST(max(outcome) AS DOUBLE) AS max FROM full_panel GROUP BY 1"""))
def seasonality_by_month(spark, sf):
    df = rp.seasonality(full_panel(spark, sf).withColumn("outcome", F.col("outcome").cast("double")), "outcome", F.month("week_start"), "month")
    return df


@query(rounded(on(FULL, """
  , q AS (SELECT entity, CAST(quarter(week_start) AS INTEGER) AS p, avg(outcome) AS m FROM full_panel GROUP BY 1, 2)
  SELECT entity, (list(p ORDER BY m, p))[1] AS lowest, min(m) AS lowest_mean, (list(p ORDER BY m DESC, p))[1] AS highest,
         max(m) AS highest_mean, max(m) - min(m) AS range FROM q GROUP BY entity"""), "lowest_mean highest_mean range"))
def seasonality_extremes(spark, sf):
    return tidy(rp.seasonality_summary(full_panel(spark, sf), "outcome", F.quarter("week_start"), "entity"))


CLASSES = SCORED + """,
yc AS (SELECT entity, year(week_start) AS year, CASE WHEN avg(CAST(level = 'intense' AS INTEGER)) > 0.1 THEN 'high' ELSE 'low' END AS year_class
       FROM scored GROUP BY 1, 2)"""


@query(rounded(on(CLASSES, f"""
  SELECT year_class, CAST(month(week_start) AS INTEGER) AS month, {M} FROM scored s JOIN yc ON s.entity = yc.entity AND year(s.week_start) = yc.year GROUP BY 1, 2"""), "mean std"))
def year_classes_by_month(spark, sf):
    return tidy(rp.classify_years(scored(spark, sf), F.col("level") == "intense", "outcome", "entity", month=True))


@query(rounded(on(SCORED, """
  SELECT entity, CAST(year(week_start) AS INTEGER) AS year, count(*) AS weeks, CAST(sum(CAST(level = 'intense' AS INTEGER)) AS BIGINT) AS hits,
         avg(CAST(level = 'intense' AS INTEGER)) AS share, CASE WHEN avg(CAST(level = 'intense' AS INTEGER)) > 0.1 THEN 'high' ELSE 'low' END AS year_class
  FROM scored GROUP BY 1, 2"""), "share"))
def year_classification(spark, sf):
    return tidy(rp.year_classes(scored(spark, sf), F.col("level") == "intense", "entity"))


@query(rounded(on(SCORED, """
  SELECT entity, CAST(date_trunc('month', week_start) AS DATE) AS month_start, count(*) AS weeks,
         avg(CASE WHEN peak IS NOT NULL THEN CAST(peak >= 400 AS INTEGER) END) AS flag_share, avg(exposure) AS mean_severity FROM scored GROUP BY 1, 2"""),
  "flag_share mean_severity"))
def monthly_overview(spark, sf):
    df = scored(spark, sf).withColumn("flag", (F.col("peak") >= 400).cast("int"))
    return tidy(rp.monthly_overview(df, "flag", "exposure", "entity"))


@query(rounded(on(HOT, """
  SELECT CAST(year(week_start) AS INTEGER) AS year, count(*) AS weeks, count(*) FILTER (WHERE heat = 1) AS events, avg(heat) AS event_rate,
         avg(share) AS coverage_mean, min(share) AS coverage_min FROM hot GROUP BY 1"""), "event_rate coverage_mean coverage_min"))
def yearly_event_rates(spark, sf):
    return tidy(rp.yearly_rates(hot(spark, sf), "heat", "share"))


@query(on(HOT, """
  SELECT entity, CAST(year(week_start) AS INTEGER) AS year, CAST(sum(heat) AS BIGINT) AS heat, CAST(sum(dust) AS BIGINT) AS dust FROM hot GROUP BY 1, 2"""))
def extremes_per_year(spark, sf):
    return rp.extremes_by_year(hot(spark, sf), ["heat", "dust"], "entity")


@query(on(SCORED + "," + PARENTS, """
  , m AS (SELECT entity, avg(CASE WHEN level = 'intense' THEN outcome END) AS mean_top, avg(CASE WHEN level = 'none' THEN outcome END) AS mean_bottom FROM scored GROUP BY 1),
  d AS (SELECT m.*, population, mean_top - mean_bottom AS delta FROM m JOIN parents p ON m.entity = p.entity),
  r AS (SELECT *, round(delta / population * 100000, 3) AS delta_per_100k FROM d)
  SELECT entity, population, round(mean_top, 6) AS mean_top, round(mean_bottom, 6) AS mean_bottom, round(delta, 6) AS delta, delta_per_100k,
         round(delta_per_100k * 23.0::DOUBLE, 1) AS extrapolated FROM r"""))
def normalized_effect_by_entity(spark, sf):
    df = rp.normalized_effect(scored(spark, sf), "entity", "level", "outcome", parents(spark, sf), 2_300_000)
    return df.withColumns({c: F.round(c, 6) for c in ("mean_top", "mean_bottom", "delta")})


@query(rounded(on(HOT, """
  SELECT CAST(quarter(week_start) AS INTEGER) AS quarter, CASE WHEN dust = 1 THEN 'confirmed' ELSE 'unconfirmed' END AS status, count(*) AS n,
         avg(outcome) AS outcome_mean, avg(exposure) AS exposure_mean, stddev_samp(outcome) AS outcome_std, stddev_samp(exposure) AS exposure_std
  FROM hot WHERE heat = 1 GROUP BY 1, 2"""), "outcome_mean exposure_mean outcome_std exposure_std"))
def label_agreement_profile(spark, sf):
    df = hot(spark, sf).withColumn("quarter", F.quarter("week_start"))
    return tidy(rp.label_agreement_profile(df, F.col("heat") == 1, F.col("dust") == 1, ["outcome", "exposure"], "quarter"))


@query(rounded(on(HOT, """
  SELECT entity, count(*) AS overlap_n, avg(CAST(heat = dust AS INTEGER)) * 100 AS agree_pct,
         100.0::DOUBLE * count(*) FILTER (WHERE heat = 1 AND dust = 1) / nullif(count(*) FILTER (WHERE dust = 1), 0) AS a_given_b_pct,
         100.0::DOUBLE * count(*) FILTER (WHERE heat = 1 AND dust = 1) / nullif(count(*) FILTER (WHERE heat = 1), 0) AS b_given_a_pct
  FROM hot GROUP BY entity"""), "agree_pct a_given_b_pct b_given_a_pct"))
def label_agreement(spark, sf):
    return tidy(rp.agreement(hot(spark, sf), "heat", "dust", "entity").withColumn("agree_pct", F.col("agree_pct").cast("double")))


@query(on(HOT, """
  SELECT 'weeks' AS metric, CAST(count(*) AS VARCHAR) AS value FROM hot UNION ALL SELECT 'first_week', CAST(min(week_start) AS VARCHAR) FROM hot
  UNION ALL SELECT 'hot_weeks', CAST(sum(heat) AS VARCHAR) FROM hot UNION ALL SELECT 'total_outcome', CAST(sum(outcome) AS VARCHAR) FROM hot"""))
def key_numbers(spark, sf):
    return rp.key_numbers(hot(spark, sf), {
        "weeks": F.count("*"), "first_week": F.min("week_start"), "hot_weeks": F.sum("heat"), "total_outcome": F.sum("outcome")})


@query(rounded(on(SCORED, f"""
  SELECT CASE WHEN outcome > 0 AND outcome <= 1 THEN 'one' WHEN outcome > 1 AND outcome <= 3 THEN 'few' WHEN outcome > 3 AND outcome <= 100 THEN 'many' END AS bin,
         {MOMENTS.format(y="score")} FROM scored GROUP BY 1"""), "mean std min max"))
def score_by_outcome_bin(spark, sf):
    binned = cut_right("outcome", [0, 1, 3, 100], ["one", "few", "many"])
    return tidy(rp.dist_by_bin(scored(spark, sf), binned, "score"))
