"""Long series: the events of users of whom one has most rows, cut into time ranges."""

from pyspark.sql import functions as F

from weekwise.operators import scan

from . import query
from .base import on, rounded, table, tidy

ROWS = 500  # small, so that the series are cut on small tables too
EVENTS = """ev AS (
  SELECT event_id, ts, CASE WHEN user_id % 10 < 7 THEN 0 ELSE user_id END AS user_id, event_type, value,
         CAST(value > 20 AS INTEGER) AS high, CASE WHEN event_id % 4 < 2 THEN value END AS known FROM events)"""
W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


def series(spark, sf):
    rows = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")
    return rows.withColumns({
        "user_id": F.when(F.col("user_id") % 10 < 7, 0).otherwise(F.col("user_id")), "high": (F.col("value") > 20).cast("int"),
        "known": F.when(F.col("event_id") % 4 < 2, F.col("value")),
    })


def cut(fn, rows, *args, **kw):
    return fn(rows, *args, entity="user_id", order="ts", ties=["event_id"], rows=ROWS, **kw)


@query(on(EVENTS, f"SELECT event_id, lag(value, 1) {W}) AS value_lag1, lag(value, 24) {W}) AS value_lag24 FROM ev"))
def long_series_lags(spark, sf):
    return cut(scan.lags, series(spark, sf), "value", [1, 24]).select("event_id", "value_lag1", "value_lag24")


@query(on(EVENTS, f"SELECT event_id, lead(value, 1) {W}) AS value_lead1, lead(value, 3) {W}) AS value_lead3 FROM ev"))
def long_series_leads(spark, sf):
    return cut(scan.leads, series(spark, sf), "value", [1, 3]).select("event_id", "value_lead1", "value_lead3")


@query(on(EVENTS, f"SELECT event_id, row_number() {W}) AS row_number, CAST(sum(high) {W}) AS BIGINT) AS high_so_far FROM ev"))
def long_series_positions(spark, sf):
    rows = cut(scan.row_numbers, series(spark, sf))
    return cut(scan.running_sums, rows, {"high_so_far": "high"}).select("event_id", "row_number", "high_so_far")


@query(rounded(on(EVENTS, f"SELECT event_id, avg(known) {W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS known_ma7 FROM ev"), "known_ma7"))
def long_series_moving_average(spark, sf):
    return tidy(cut(scan.moving_avg, series(spark, sf), "known", 7).select("event_id", "known_ma7"))


@query(on(EVENTS, f"""
  , b AS (SELECT *, CASE WHEN high = 1 AND coalesce(lag(high) {W}), 0) = 0 THEN 1 ELSE 0 END AS starts FROM ev)
  SELECT event_id, CASE WHEN high = 1 THEN CAST(sum(starts) {W}) AS BIGINT) END AS episode_id FROM b"""))
def long_series_episodes(spark, sf):
    return cut(scan.episodes, series(spark, sf), "high").select("event_id", "episode_id")


@query(on(EVENTS, f"""
  , b AS (SELECT *, CASE WHEN high = 1 AND (coalesce(lag(high) {W}), 0) = 0 OR ts > lag(ts) {W}) + INTERVAL 2 HOUR) THEN 1 ELSE 0 END AS starts FROM ev)
  SELECT event_id, CASE WHEN high = 1 THEN CAST(sum(starts) {W}) AS BIGINT) END AS episode_id FROM b"""))
def long_series_episodes_with_gaps(spark, sf):
    return cut(scan.episodes, series(spark, sf), "high", gap="INTERVAL 2 HOURS").select("event_id", "episode_id")


@query(on(EVENTS, f"""
  , b AS (SELECT *, CASE WHEN event_type = lag(event_type) {W}) THEN 0 ELSE 1 END AS starts FROM ev),
  r AS (SELECT *, CAST(sum(starts) {W}) AS BIGINT) AS run_id FROM b)
  SELECT user_id, run_id, min(event_type) AS value, min(ts) AS "start", max(ts) AS "end", count(*) AS length FROM r GROUP BY 1, 2"""))
def long_series_runs(spark, sf):
    return cut(scan.runs, series(spark, sf), "event_type")


@query(rounded(on(EVENTS, f"""
  , i AS (SELECT *, row_number() {W}) AS i FROM ev),
  n AS (SELECT *, max(CASE WHEN known IS NOT NULL THEN i END) {W}) AS a,
          min(CASE WHEN known IS NOT NULL THEN i END) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM i)
  SELECT n.event_id, coalesce(n.known, x.known + (y.known - x.known) * (n.i - n.a) / (n.b - n.a), x.known, y.known, 0) AS known FROM n
    LEFT JOIN i x ON x.user_id = n.user_id AND x.i = n.a LEFT JOIN i y ON y.user_id = n.user_id AND y.i = n.b"""), "known"))
def long_series_interpolation(spark, sf):
    return tidy(cut(scan.interpolate, series(spark, sf), ["known"]).select("event_id", "known"))


@query(on(EVENTS, f"""
  , n AS (SELECT event_id, user_id, ts, max(CASE WHEN known IS NOT NULL THEN ts END) {W}) AS last_ts FROM ev)
  SELECT event_id, last_ts FROM n"""))
def long_series_last_known(spark, sf):
    rows = series(spark, sf).withColumn("known_ts", F.when(F.col("known").isNotNull(), F.col("ts")))
    return cut(scan.last_known, rows, {"last_ts": "known_ts"}).select("event_id", "last_ts")
