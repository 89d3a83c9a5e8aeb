"""Grain changes, event feeds and roll-ups."""

from pyspark.sql import functions as F

from weekwise.functions.dates import week_start
from weekwise.functions.numbers import flag, null_if_nan
from weekwise.operators import aggregate as agg
from weekwise.operators.score import quantile_flag
from weekwise.operators.window import climatology

from weekwise.session import scratch_path
from weekwise.sources.grids import read_grid, write_grid

from . import query
from .base import FULL, PANEL, PARENTS, SCORED, full_panel, on, panel, parents, rounded, scored, table, tidy
from .panels import SPANS, spans

# events as sub-daily observations of a station: value is NULL where the event is a signup
OBS = """obs AS (SELECT user_id AS station, ts, event_type,
                      CASE WHEN event_type <> 'signup' THEN value END AS v, value AS w FROM events)"""


def obs(spark, sf):
    e = table(spark, sf, "events", "user_id", "ts", "event_type", "value")
    return e.select(
        F.col("user_id").alias("station"), "ts", "event_type",
        F.when(F.col("event_type") != "signup", F.col("value")).alias("v"), F.col("value").alias("w"),
    )


@query(rounded(f"""WITH {OBS}
  SELECT station, CAST(date_trunc('week', ts) AS DATE) AS week_start, avg(v) AS v_mean, max(v) AS v_max, min(v) AS v_min,
         coalesce(sum(CASE WHEN event_type = 'error' THEN v END), 0::DOUBLE) AS error_sum, (max(w) + min(w)) / 2 AS mid_range,
         count(v) AS n_present, count(*) FILTER (WHERE v IS NULL) AS n_missing,
         count(DISTINCT CASE WHEN v IS NOT NULL THEN CAST(ts AS DATE) END) / 7::DOUBLE AS coverage
  FROM obs GROUP BY 1, 2""", "v_mean error_sum mid_range coverage"))
def weekly_means_and_coverage(spark, sf):
    o = obs(spark, sf)
    return tidy(agg.weekly_agg(o, "station", "ts", {
        "v_mean": F.avg("v"), "v_max": F.max("v"), "v_min": F.min("v"),
        "error_sum": agg.sum_or_zero(F.when(F.col("event_type") == "error", F.col("v"))),
        "mid_range": (F.max("w") + F.min("w")) / 2,
        "n_present": F.count("v"), "n_missing": agg.n_missing("v"),
        "coverage": agg.coverage(F.col("v").isNotNull(), F.to_date("ts"), 7),
    }))


@query(rounded(f"""WITH {OBS}
  SELECT station, CAST(ts AS DATE) AS date, avg(v) AS v_mean, max(v) AS v_max, min(v) AS v_min,
         count(DISTINCT CASE WHEN v IS NOT NULL THEN hour(ts) END) AS hours_with_data, count(v) AS n_obs,
         count(DISTINCT CASE WHEN v IS NOT NULL THEN hour(ts) END) / 24::DOUBLE AS coverage,
         quantile_cont(v, 0.9) AS v_p90
  FROM obs GROUP BY 1, 2""", "v_mean coverage v_p90"))
def daily_means_with_p90(spark, sf):
    return tidy(agg.daily_agg(obs(spark, sf), "station", "ts", ["v"], 24, qs={"p90": 0.9}))


@query(rounded(f"""WITH {OBS}, d AS (
    SELECT station, CAST(ts AS DATE) AS date, avg(v) AS v_mean, max(v) AS v_max, min(v) AS v_min FROM obs GROUP BY 1, 2)
  SELECT station, CAST(date_trunc('week', date) AS DATE) AS week_start, avg(v_mean) AS v_mean, max(v_max) AS v_max,
         min(v_min) AS v_min, count(DISTINCT CASE WHEN v_mean IS NOT NULL THEN date END) AS days_with_data,
         count(DISTINCT CASE WHEN v_mean IS NOT NULL THEN date END) / 7::DOUBLE AS coverage
  FROM d GROUP BY 1, 2""", "v_mean coverage"))
def weekly_from_daily(spark, sf):
    daily = agg.daily_agg(obs(spark, sf), "station", "ts", ["v"], 24)
    return tidy(agg.weekly_from_daily(daily, "station", ["v"]))


@query(rounded(f"""WITH {OBS}, d AS (
    SELECT station, CAST(ts AS DATE) AS date, avg(v) AS v_mean, count(v) AS n_obs FROM obs GROUP BY 1, 2),
  f AS (SELECT *, CAST(coalesce(v_mean >= (SELECT quantile_cont(v_mean, 0.9) FROM d), false) AS INTEGER) AS high FROM d)
  SELECT station, CAST(date_trunc('week', date) AS DATE) AS week_start, avg(v_mean) AS v_mean,
         CAST(sum(n_obs) AS BIGINT) AS n_obs, CAST(sum(high) AS BIGINT) AS high_days FROM f GROUP BY 1, 2""", "v_mean"))
def weekly_high_days(spark, sf):
    daily = agg.daily_agg(obs(spark, sf), "station", "ts", ["v"], 24, stats=["mean"])
    flagged = quantile_flag(daily, "v_mean", 0.9, "high")
    return tidy(agg.weekly_agg(flagged, "station", "date", {
        "v_mean": F.avg("v_mean"), "n_obs": F.sum("n_obs"), "high_days": F.sum("high"),
    }))


@query(f"""WITH {OBS}
  SELECT station, CAST(ts AS DATE) AS date, max(v) AS v, max(w) AS w, bool_or(v IS NOT NULL) AS v_has_data
  FROM obs GROUP BY 1, 2""")
def daily_maximum(spark, sf):
    o = obs(spark, sf).withColumn("date", F.to_date("ts"))
    return agg.daily_max(o, "station", "date", ["v", "w"], "v", "v_has_data")


STATION_DAYS = OBS + """,
sd AS (SELECT station, CAST(ts AS DATE) AS date, station % 7 AS area, min(v) AS vis, max(w) AS rh FROM obs GROUP BY 1, 2, 3),
fl AS (SELECT *, CAST(coalesce(vis < 5 OR (vis < 15 AND rh < 70), false) AS INTEGER) AS confirmed,
              CAST(coalesce(vis IS NULL AND rh < 30, false) AS INTEGER) AS possible FROM sd),
ad AS (SELECT area, date, CAST(sum(confirmed) AS BIGINT) AS confirmed_stations, CAST(sum(possible) AS BIGINT) AS possible_stations,
              count(DISTINCT station) AS stations_obs, min(vis) AS vis_min, min(rh) AS rh_min FROM fl GROUP BY 1, 2),
days AS (SELECT *, CAST(confirmed_stations >= 1 AS INTEGER) AS confirmed_day,
                CAST(possible_stations >= 1 AS INTEGER) AS possible_day,
                CAST(confirmed_stations >= 1 OR possible_stations >= 1 AS INTEGER) AS any_day FROM ad)"""


def area_days(spark, sf):
    o = obs(spark, sf).withColumns({"date": F.to_date("ts"), "area": F.col("station") % 7})
    sd = o.groupBy("station", "date", "area").agg(F.min("v").alias("vis"), F.max("w").alias("rh"))
    vis, rh = F.col("vis"), F.col("rh")
    fl = sd.withColumns({
        "confirmed": flag((vis < 5) | ((vis < 15) & (rh < 70))), "possible": flag(vis.isNull() & (rh < 30)),
    })
    return agg.entity_day_flags(
        fl, "area", "station", "date", {"confirmed": "confirmed", "possible": "possible"}, ["vis", "rh"]
    )


@query(f"WITH {STATION_DAYS} SELECT * FROM days")
def stations_to_entity_day(spark, sf):
    return area_days(spark, sf)


@query(f"""WITH {STATION_DAYS}
  SELECT area, CAST(date_trunc('week', date) AS DATE) AS week_start,
    CAST(sum(confirmed_day) AS BIGINT) AS confirmed_days_week, max(confirmed_day) AS confirmed_any_week,
    CAST(sum(possible_day) AS BIGINT) AS possible_days_week, max(possible_day) AS possible_any_week,
    CAST(sum(any_day) AS BIGINT) AS any_days_week, max(any_day) AS any_any_week,
    max(confirmed_stations) AS confirmed_stations_max_week, max(possible_stations) AS possible_stations_max_week,
    max(stations_obs) AS stations_obs_max_week, min(vis_min) AS vis_min_week, min(rh_min) AS rh_min_week
  FROM days GROUP BY 1, 2""")
def entity_day_to_week(spark, sf):
    return agg.entity_week_flags(area_days(spark, sf), "area", "date", ["confirmed", "possible"], ["vis", "rh"])


@query(f"""WITH {STATION_DAYS}
  SELECT area, min(vis_min) FILTER (WHERE confirmed_day = 1) AS vis_when_confirmed,
         max(rh_min) FILTER (WHERE possible_day = 1) AS rh_when_possible, count(*) AS days
  FROM days GROUP BY area""")
def conditional_aggregates(spark, sf):
    return area_days(spark, sf).groupBy("area").agg(
        agg.agg_if(F.min, "vis_min", F.col("confirmed_day") == 1).alias("vis_when_confirmed"),
        agg.agg_if(F.max, "rh_min", F.col("possible_day") == 1).alias("rh_when_possible"),
        F.count("*").alias("days"),
    )


@query(rounded(on(SCORED, """
  SELECT entity, CAST(month(week_start) AS INTEGER) AS month, avg(peak) AS baseline_mean, stddev_samp(peak) AS baseline_std
  FROM scored WHERE level = 'none' GROUP BY 1, 2"""), "baseline_mean baseline_std"))
def non_event_baseline(spark, sf):
    from weekwise.functions.numbers import ordinal

    df = scored(spark, sf).withColumns({"month": F.month("week_start"), "lev": ordinal("level")})
    return tidy(agg.baseline(df, "peak", ["entity", "month"], "lev", null_is_quiet=False))


ALERTS = """alerts AS (
  SELECT user_id % 7 AS area, ts, CAST(event_type = 'error' AS INTEGER) AS dust, CAST(event_type = 'purchase' AS INTEGER) AS heat,
         CASE WHEN value >= 120 THEN 4 WHEN value >= 80 THEN 3 WHEN value >= 40 THEN 2 WHEN value >= 10 THEN 1 ELSE 0 END
           AS level_score FROM events)"""


def alerts(spark, sf):
    e = table(spark, sf, "events", "user_id", "ts", "event_type", "value")
    v = F.col("value")
    return e.select(
        (F.col("user_id") % 7).alias("area"), "ts", flag(F.col("event_type") == "error").alias("dust"),
        flag(F.col("event_type") == "purchase").alias("heat"),
        F.when(v >= 120, 4).when(v >= 80, 3).when(v >= 40, 2).when(v >= 10, 1).otherwise(0).alias("level_score"),
    )


@query(rounded(f"""WITH {ALERTS}, w AS (
  SELECT area, CAST(date_trunc('week', ts) AS DATE) AS week_start,
         coalesce(max(CASE WHEN dust = 1 THEN level_score END), 0) AS dust_level_max_week,
         coalesce(max(CASE WHEN heat = 1 THEN level_score END), 0) AS heat_level_max_week,
         count(DISTINCT CAST(ts AS DATE)) AS days_with_alerts FROM alerts WHERE ts IS NOT NULL GROUP BY 1, 2)
  SELECT *, CAST(dust_level_max_week >= 2 AS INTEGER) AS dust_yellow_plus_week,
         CAST(heat_level_max_week >= 2 AS INTEGER) AS heat_yellow_plus_week, days_with_alerts / 7::DOUBLE AS coverage_week FROM w""",
  "coverage_week"))
def alerts_by_week(spark, sf):
    return tidy(agg.alerts_weekly(alerts(spark, sf), "area", "ts", {"dust": "dust", "heat": "heat"}))


@query(f"""WITH {SPANS}, d AS (
    SELECT o_orderkey % 5 AS zone, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS date, intensity
    FROM spans WHERE e >= s)
  SELECT zone, CAST(date_trunc('week', date) AS DATE) AS week_start, max(intensity) AS intensity
  FROM d GROUP BY 1, 2""")
def event_intensity_by_week(spark, sf):
    events = spans(spark, sf).withColumn("zone", F.col("o_orderkey") % 5)
    return agg.event_intensity_weekly(events, "zone", "s", "e", "intensity")


@query(f"""WITH {SPANS}, d AS (
    SELECT CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS date, intensity FROM spans WHERE e >= s)
  SELECT date, max(intensity) AS intensity FROM d GROUP BY 1""")
def event_intensity_by_day(spark, sf):
    return agg.event_intensity_daily(spans(spark, sf), [], "s", "e", "intensity")


@query("""
  WITH r AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start,
      max(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END) AS m
      FROM orders GROUP BY 1)
  SELECT week_start, CASE m WHEN 0 THEN '5-LOW' WHEN 1 THEN '4-NOT SPECIFIED' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '2-HIGH' ELSE '1-URGENT' END
    AS worst FROM r""")
def weekly_highest_level(spark, sf):
    orders = table(spark, sf, "orders", "o_orderdate", "o_orderpriority").withColumn("week_start", week_start("o_orderdate"))
    order = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    return agg.ordinal_max(orders, "week_start", "o_orderpriority", order, "worst")


ROLLUP = SCORED + "," + PARENTS + """,
tot AS (SELECT parent, CAST(sum(population) AS BIGINT) AS total FROM parents GROUP BY parent),
wk AS (SELECT p.parent, s.week_start, CAST(sum(CASE WHEN level = 'intense' THEN population ELSE 0 END) AS BIGINT) AS weight_exposed,
         sum(CASE level WHEN 'none' THEN 0 WHEN 'possible' THEN 1 WHEN 'probable' THEN 2 ELSE 3 END * population) AS num,
         sum(population) AS den FROM scored s JOIN parents p ON s.entity = p.entity GROUP BY 1, 2),
up AS (SELECT w.parent, week_start, weight_exposed, (CAST(num AS DOUBLE) / CAST(den AS DOUBLE)) / 3 AS score,
         weight_exposed / CAST(total AS DOUBLE) AS share_exposed FROM wk w JOIN tot t ON w.parent = t.parent),
rolled AS (SELECT *, share_exposed >= 0.5 AS exposed, CASE WHEN score >= 0.75 THEN 'intense' WHEN score >= 0.5 THEN 'probable'
             WHEN score >= 0.25 THEN 'possible' ELSE 'none' END AS level FROM up)"""


def rolled(spark, sf):
    return agg.weighted_rollup(scored(spark, sf), parents(spark, sf), "entity", "level")


@query(rounded(on(ROLLUP, "SELECT * FROM rolled"), "score share_exposed"))
def population_weighted_rollup(spark, sf):
    return tidy(rolled(spark, sf))


@query(rounded(on(ROLLUP, """
  , po AS (SELECT p.parent, f.week_start, CAST(sum(outcome) AS BIGINT) AS outcome FROM full_panel f JOIN parents p ON f.entity = p.entity GROUP BY 1, 2)
  SELECT r.parent, r.week_start, total AS population, outcome, outcome * 100000.0::DOUBLE / total AS outcome_per_100k,
         weight_exposed, share_exposed, exposed FROM rolled r JOIN tot t ON r.parent = t.parent
  LEFT JOIN po ON r.parent = po.parent AND r.week_start = po.week_start"""), "outcome_per_100k share_exposed"))
def parent_master(spark, sf):
    return tidy(parent_level(spark, sf))


def parent_level(spark, sf):
    people = parents(spark, sf)
    up = agg.weighted_rollup(scored(spark, sf), people, "entity", "level", extra={"outcome": F.sum("outcome")})
    totals = people.groupBy("parent").agg(F.sum("population").alias("population"))
    return agg.add_rate(up.drop("score", "level").join(totals, "parent"), "outcome", "population", "outcome_per_100k")


@query(rounded(on(ROLLUP, """
  , po AS (SELECT p.parent, f.week_start, sum(outcome) AS outcome FROM full_panel f JOIN parents p ON f.entity = p.entity GROUP BY 1, 2),
  m AS (SELECT r.parent, r.week_start, total, outcome, weight_exposed, exposed FROM rolled r JOIN tot t ON r.parent = t.parent
        LEFT JOIN po ON r.parent = po.parent AND r.week_start = po.week_start),
  g AS (SELECT week_start, CAST(sum(outcome) AS BIGINT) AS outcome, CAST(sum(total) AS BIGINT) AS population,
          CAST(sum(weight_exposed) AS BIGINT) AS weight_exposed, bool_or(exposed) AS any_exposed, bool_and(exposed) AS all_exposed
        FROM m GROUP BY week_start HAVING count(*) = 5),
  s AS (SELECT *, weight_exposed / CAST(population AS DOUBLE) AS share_exposed, outcome * 100000.0::DOUBLE / population AS outcome_per_100k FROM g)
  SELECT *, CASE WHEN share_exposed >= 0.75 THEN 'intense' WHEN share_exposed >= 0.5 THEN 'probable'
                 WHEN share_exposed >= 0.25 THEN 'possible' ELSE 'none' END AS level FROM s"""), "share_exposed outcome_per_100k"))
def region_master(spark, sf):
    return tidy(agg.region_rollup(parent_level(spark, sf), 5))


@query(rounded("""
  WITH g AS (SELECT date_trunc('hour', ts) AS time, user_id % 10 AS latitude, user_id // 10 AS longitude, value FROM events),
  c AS (SELECT time, latitude, longitude, avg(value) AS value FROM g WHERE latitude BETWEEN 2 AND 7 AND longitude BETWEEN 1 AND 12 GROUP BY 1, 2, 3)
  SELECT time, avg(value) * 1000 AS value FROM c GROUP BY time""", "value", 4))
def grid_area_mean(spark, sf):
    e = table(spark, sf, "events", "ts", "user_id", "value").select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), (F.col("user_id") % 10).alias("latitude"),
        F.floor(F.col("user_id") / 10).alias("longitude"), "value",
    )
    return tidy(agg.grid_mean(e, "time", ["value"], 1000.0, (2, 1, 7, 12)), 4)


@query(rounded("""
  WITH g AS (SELECT date_trunc('hour', ts) AS time, user_id % 10 * 3.5 - 20 AS latitude, user_id // 10 * 1.25 + 4 AS longitude, value FROM events WHERE ts >= TIMESTAMP '2024-01-10'),
  c AS (SELECT time, latitude, longitude, avg(value) AS value FROM g WHERE latitude BETWEEN -16.5 AND 8 AND longitude BETWEEN 6.5 AND 14 GROUP BY 1, 2, 3)
  SELECT time, avg(value) * 1000 AS value FROM c GROUP BY time""", "value", 4))
def grid_box_along_a_curve(spark, sf):
    """The fields stored in the order of a space-filling curve; a box of them is read by ranges of codes."""
    path = scratch_path(spark, "grid")
    e = table(spark, sf, "events", "ts", "user_id", "value").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    write_grid(e.select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), (F.col("user_id") % 10 * 3.5 - 20).alias("latitude"),
        (F.floor(F.col("user_id") / 10) * 1.25 + 4).alias("longitude"), "value"), path)
    return tidy(agg.grid_mean(read_grid(spark, path, (-16.5, 6.5, 8, 14)), "time", ["value"], 1000.0), 4)


@query(rounded(on(FULL, """
  SELECT entity, CAST(weekofyear(week_start) AS INTEGER) AS iso_week, avg(peak) AS peak_clim FROM full_panel GROUP BY 1, 2"""), "peak_clim"))
def climatology_by_iso_week(spark, sf):
    return tidy(climatology(full_panel(spark, sf), ["peak"], F.weekofyear("week_start"), "iso_week", "entity"))


@query(rounded(on(PANEL, "SELECT entity, week_start, nullif(exposure, 'nan'::DOUBLE) AS exposure FROM panel"), "exposure"))
def nan_as_missing(spark, sf):
    return tidy(panel(spark, sf).select("entity", "week_start", null_if_nan("exposure").alias("exposure")))
