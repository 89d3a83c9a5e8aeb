"""Whole feeds as one plan each, from raw rows to the weekly table."""

from pyspark.sql import functions as F

from weekwise.plans import feeds

from . import query
from .base import on, rounded, table, tidy
from .panels import SPANS, spans

VISIBILITY = """ob AS (SELECT user_id AS station, ts, CASE WHEN event_type <> 'signup' AND event_id % 10 <> 9 THEN value * 500 END AS vis_m, value / 10 AS dew FROM events),
nr AS (SELECT *, CAST(ts AS DATE) AS date, abs(hour(ts) * 60 + minute(ts) - 720) AS dist FROM ob WHERE abs(hour(ts) * 60 + minute(ts) - 720) <= 90),
pk AS (SELECT *, station % 7 AS entity, 100 * exp(17.625::DOUBLE * dew / (243.04::DOUBLE + dew) - 17.625::DOUBLE * 20 / (243.04::DOUBLE + 20)) AS rh FROM nr
       QUALIFY row_number() OVER (PARTITION BY station, date ORDER BY dist, ts) = 1),
fl AS (SELECT *, CAST(coalesce(vis_m < 9999 OR (vis_m < 20000 AND rh < 70), false) AS INTEGER) AS c, CAST(coalesce(vis_m IS NULL AND rh < 30, false) AS INTEGER) AS p FROM pk),
dy AS (SELECT entity, date, sum(c) AS cs, sum(p) AS ps, count(DISTINCT station) AS so, min(vis_m) AS vm, min(rh) AS rm FROM fl GROUP BY 1, 2),
dd AS (SELECT *, CAST(cs >= 1 AS INTEGER) AS cd, CAST(ps >= 1 AS INTEGER) AS pd, CAST(cs >= 1 OR ps >= 1 AS INTEGER) AS ad FROM dy)"""


@query(rounded(on(VISIBILITY, """
  SELECT entity, CAST(date_trunc('week', date) AS DATE) AS week_start, CAST(sum(cd) AS BIGINT) AS low_vis_confirmed_days_week, max(cd) AS low_vis_confirmed_any_week,
    CAST(sum(pd) AS BIGINT) AS low_vis_possible_days_week, max(pd) AS low_vis_possible_any_week, CAST(sum(ad) AS BIGINT) AS low_vis_any_days_week, max(ad) AS low_vis_any_week,
    CAST(max(cs) AS BIGINT) AS confirmed_stations_max_week, CAST(max(ps) AS BIGINT) AS possible_stations_max_week, max(so) AS stations_obs_max_week,
    min(vm) AS vis_min_m_week, min(rm) AS rh_min_pct_week FROM dd GROUP BY 1, 2"""), "vis_min_m_week rh_min_pct_week"))
def visibility_feed(spark, sf):
    e = table(spark, sf, "events", "event_id", "user_id", "ts", "event_type", "value")
    obs = e.select(
        F.col("user_id").alias("station"), F.col("ts").alias("dt_utc"),
        F.when(F.col("event_type") != "signup", F.col("value") * 500).alias("vis_m"), F.lit(20.0).alias("temp_c"),
        (F.col("value") / 10).alias("dewpoint_c"), (F.col("event_id") % 10).alias("vis_qc"))
    places = e.select(F.col("user_id").alias("station"), (F.col("user_id") % 7).alias("entity")).distinct()
    return tidy(feeds.visibility_weekly(obs, places))


@query(on(SPANS, """
  , ev AS (SELECT o_orderkey % 5 AS zone, s, e, intensity FROM spans WHERE e >= s),
  ds AS (SELECT zone, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS d, intensity FROM ev),
  wk AS (SELECT zone, CAST(date_trunc('week', d) AS DATE) AS week_start, max(intensity) AS x FROM ds GROUP BY 1, 2),
  bd AS (SELECT zone, min(week_start) AS lo, max(week_start) AS hi FROM wk GROUP BY 1),
  cl AS (SELECT zone, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_start FROM bd),
  fu AS (SELECT cl.zone, cl.week_start, coalesce(x, 0) AS dust_dai_week FROM cl LEFT JOIN wk ON cl.zone = wk.zone AND cl.week_start = wk.week_start),
  th AS (SELECT zone, quantile_cont(dust_dai_week, 0.33) AS a, quantile_cont(dust_dai_week, 0.66) AS b FROM fu WHERE dust_dai_week > 0 GROUP BY 1)
  SELECT fu.zone, week_start, dust_dai_week, CASE WHEN dust_dai_week <= 0 THEN 0 WHEN dust_dai_week <= a THEN 1 WHEN dust_dai_week <= b THEN 2 ELSE 3 END AS dust_level_week
  FROM fu LEFT JOIN th ON fu.zone = th.zone"""))
def interval_event_feed(spark, sf):
    """Events written with day-first text dates, to weekly intensity and tercile level per zone."""
    raw = spans(spark, sf).select(
        (F.col("o_orderkey") % 5).alias("zone"), F.date_format("s", "dd/MM/yyyy").alias("Fecha ini"),
        F.date_format("e", "dd/MM/yyyy").alias("Fecha fin"), F.col("intensity").cast("string").alias("DAI"))
    return feeds.dust_weekly(raw, entity="zone")


OUTCOME = """og AS (SELECT c_nationkey AS n, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
nm AS (SELECT lower(n_name) AS entity, og.week_start, CASE WHEN c = 3 THEN NULL ELSE c * 1000 + 0.5 END::DOUBLE AS v FROM og JOIN nation ON n = n_nationkey),
bd AS (SELECT entity, min(week_start) AS lo, max(week_start) AS hi FROM nm GROUP BY 1),
cl AS (SELECT entity, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_start FROM bd)"""


@query(on(OUTCOME, """
  SELECT cl.entity, cl.week_start, v AS deaths_week, CAST(v IS NULL AS INTEGER) AS deaths_missing_week
  FROM cl LEFT JOIN nm ON cl.entity = nm.entity AND cl.week_start = nm.week_start"""))
def outcome_feed(spark, sf):
    """Weekly counts written as delimited-text rows (ISO periods, European numbers, spelled names) and parsed."""
    from weekwise.functions.dates import iso_year

    orders = table(spark, sf, "orders", "o_custkey", "o_orderdate")
    customer, nation = table(spark, sf, "customer", "c_custkey", "c_nationkey"), table(spark, sf, "nation", "n_nationkey", "n_name")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).withColumn("d", F.col("o_orderdate").cast("date"))
    weekly = rows.groupBy("c_nationkey", iso_year("d").alias("y"), F.weekofyear("d").alias("w")).agg(F.count("*").alias("c"))
    named = weekly.join(nation, weekly.c_nationkey == nation.n_nationkey)
    total = F.when(F.col("c") != 3, F.translate(F.format_number(F.col("c") * 1000 + 0.5, 1), ",.", ".,")).otherwise(" ")
    raw = named.select(
        F.concat(F.lit(" "), F.upper("n_name"), F.lit(" ")).alias("Islas"), F.lit("Dato base").alias("Tipo de dato"),
        F.concat(F.col("y").cast("string"), F.lit("SM"), F.lpad(F.col("w").cast("string"), 2, "0")).alias("Periodo"), total.alias("Total"))
    rates = raw.withColumns({"Tipo de dato": F.lit("Tasa"), "Total": F.lit("1")})
    aliases = nation.select(F.col("n_name").alias("alias"), F.lower("n_name").alias("canonical"))
    return feeds.outcome_weekly(raw.unionByName(rates), aliases)
