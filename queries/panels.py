"""The flagship panel, calendars and master tables."""

from pyspark.sql import functions as F

from weekwise.functions.dates import analysis_window, week_start
from weekwise.functions.numbers import rate_per
from weekwise.operators import calendar as cal
from weekwise.operators import clean, intervals
from weekwise.operators.aggregate import weekly_agg
from weekwise.operators.joins import build_master

from . import query
from .base import FULL, PANEL, PARENTS, full_panel, on, panel, parents, rounded, table, tidy

SHIPPED = """shipped AS (
  SELECT c_nationkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start,
         count(*) AS n_lines, round(sum(l_quantity), 4) AS quantity, avg(l_discount) AS discount_mean
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def shipped(spark, sf):
    """Second feed: lines shipped per entity and week."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_shipdate", "l_quantity", "l_discount")
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    customer = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    owner = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey"), F.col("c_nationkey").alias("entity")
    )
    rows = lines.join(owner, lines.l_orderkey == owner.o_orderkey)
    return weekly_agg(rows, "entity", "l_shipdate", {
        "n_lines": F.count("*"), "quantity": F.round(F.sum("l_quantity"), 4), "discount_mean": F.avg("l_discount"),
    })


@query(rounded(on(FULL + "," + SHIPPED + "," + PARENTS, """
  SELECT f.entity, f.week_start, f.outcome, f.exposure, f.peak, f.urgent, f.missing, s.n_lines, s.quantity,
         s.discount_mean, p.population, f.outcome * 100000.0::DOUBLE / p.population AS outcome_per_100k
  FROM full_panel f LEFT JOIN shipped s ON f.entity = s.entity AND f.week_start = s.week_start
  JOIN parents p ON f.entity = p.entity"""), "exposure peak quantity discount_mean outcome_per_100k"))
def weekly_exposure_outcome_panel(spark, sf):
    feed = full_panel(spark, sf).drop("share")
    master = build_master(feed, [shipped(spark, sf)], ["entity", "week_start"])
    people = parents(spark, sf).select("entity", "population")
    return tidy(master.join(people, "entity").withColumn("outcome_per_100k", rate_per("outcome", "population")))


@query(rounded(on(FULL + "," + SHIPPED, """
  , cal AS (SELECT e.entity, CAST(w.week_start AS DATE) AS week_start
            FROM (SELECT DISTINCT entity FROM panel) e,
                 (SELECT unnest(generate_series(DATE '1996-01-01', DATE '2000-12-25', INTERVAL 7 DAY)) AS week_start) w)
  SELECT c.entity, c.week_start, p.outcome, p.exposure, s.n_lines, s.quantity, s.discount_mean
  FROM cal c LEFT JOIN panel p ON c.entity = p.entity AND c.week_start = p.week_start
  LEFT JOIN shipped s ON c.entity = s.entity AND c.week_start = s.week_start"""), "exposure quantity discount_mean"))
def master_on_fixed_window(spark, sf):
    """Analysis window of whole years as the calendar of every entity; both feeds joined onto it."""
    feed = panel(spark, sf).select("entity", "week_start", "outcome", "exposure")
    lo, hi = analysis_window(1996, 2000)
    full = cal.complete_calendar(feed, "entity", start=lo, end=hi)
    return tidy(build_master(full, [shipped(spark, sf)], ["entity", "week_start"]))


@query(on(FULL, "SELECT * FROM full_panel"))
def complete_calendar_with_fills(spark, sf):
    return full_panel(spark, sf)


@query(on(FULL, """
  SELECT s.entity, s.week_start FROM spine s
  WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.entity = s.entity AND p.week_start = s.week_start)"""))
def missing_weeks(spark, sf):
    feed = panel(spark, sf)
    return cal.missing_keys(feed, cal.entity_calendar(feed, "entity"), ["entity", "week_start"])


@query("""
  WITH d AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS date),
       n AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n_orders FROM orders GROUP BY 1)
  SELECT d.date, CAST(year(d.date) AS INTEGER) AS year, n.n_orders FROM d LEFT JOIN n ON d.date = n.date""")
def daily_calendar_with_gaps(spark, sf):
    days = cal.daily_calendar(spark, 1995, 2001)
    orders = table(spark, sf, "orders", "o_orderdate")
    per_day = orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("n_orders"))
    return days.join(per_day, "date", "left")


@query(on(PANEL, """
  , r AS (SELECT entity, min(week_start) AS lo, max(week_start) AS hi FROM panel GROUP BY entity),
  c AS (SELECT *, CAST(unnest(generate_series(lo, hi, INTERVAL 60 DAY)) AS DATE) AS chunk_start FROM r)
  SELECT entity, chunk_start, least(chunk_start + 59, hi) AS chunk_end FROM c"""))
def date_chunks_by_days(spark, sf):
    ranges = panel(spark, sf).groupBy("entity").agg(F.min("week_start").alias("lo"), F.max("week_start").alias("hi"))
    return cal.date_chunks(ranges, "lo", "hi", days=60).select("entity", "chunk_start", "chunk_end")


@query(on(PANEL, """
  , r AS (SELECT entity, CAST(date_trunc('month', min(week_start)) AS DATE) AS lo, max(week_start) AS hi
          FROM panel GROUP BY entity),
  c AS (SELECT *, CAST(unnest(generate_series(lo, hi, INTERVAL 3 MONTH)) AS DATE) AS chunk_start FROM r)
  SELECT entity, chunk_start, least(CAST(chunk_start + INTERVAL 3 MONTH AS DATE) - 1, hi) AS chunk_end FROM c"""))
def date_chunks_by_months(spark, sf):
    ranges = panel(spark, sf).groupBy("entity").agg(
        F.date_trunc("month", F.min("week_start")).cast("date").alias("lo"), F.max("week_start").alias("hi")
    )
    return cal.date_chunks(ranges, "lo", "hi", months=3).select("entity", "chunk_start", "chunk_end")


@query("""
  WITH r AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY user_id),
  c AS (SELECT *, unnest(generate_series(lo, hi, INTERVAL 86400 SECOND)) AS chunk_start FROM r)
  SELECT user_id, chunk_start, least(chunk_start + INTERVAL 86399 SECOND, hi) AS chunk_end FROM c""")
def date_chunks_by_seconds(spark, sf):
    ranges = table(spark, sf, "events", "user_id", "ts").groupBy("user_id").agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    return cal.second_chunks(ranges, "lo", "hi", 86400).select("user_id", "chunk_start", "chunk_end")


SPANS = """spans AS (
  SELECT o_orderkey, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(l_shipdate) AS DATE) AS e, max(l_quantity) AS intensity
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"""


def spans(spark, sf):
    """Interval events: an order from its date to its last shipment; intensity = largest quantity."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_shipdate", "l_quantity").groupBy("l_orderkey").agg(
        F.max("l_shipdate").cast("date").alias("e"), F.max("l_quantity").alias("intensity")
    )
    orders = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("s"), "e", "intensity"
    )


@query(f"""WITH {SPANS}
  SELECT CAST(date_trunc('week', d) AS DATE) AS week_start, count(*) AS event_days FROM (
    SELECT unnest(generate_series(s, e, INTERVAL 1 DAY)) AS d FROM spans WHERE e >= s) GROUP BY 1""")
def interval_expansion_days(spark, sf):
    return intervals.interval_days_per_week(spans(spark, sf), [], "s", "e")


DAYS_OPEN = f"""WITH {SPANS}
  SELECT CAST(d AS DATE) AS date, count(*) AS open FROM (
    SELECT unnest(generate_series(s, e, INTERVAL 1 DAY)) AS d FROM spans WHERE e >= s) GROUP BY 1"""


@query(DAYS_OPEN)
def intervals_open_per_day(spark, sf):
    return intervals.open_per_day(spans(spark, sf), [], "s", "e")


@query(DAYS_OPEN)
def interval_expansion_rows(spark, sf):
    return cal.expand_intervals(spans(spark, sf), "s", "e").groupBy("date").agg(F.count("*").alias("open"))


@query(f"""WITH {SPANS}
  SELECT o_orderkey, greatest(s, DATE '1997-01-01') AS s, least(e, DATE '1998-12-31') AS e,
         CAST(least(e, DATE '1998-12-31') - greatest(s, DATE '1997-01-01') + 1 AS INTEGER) AS days
  FROM spans WHERE e >= DATE '1997-01-01' AND s <= DATE '1998-12-31'""")
def interval_clip_and_duration(spark, sf):
    from weekwise.functions.dates import duration_days

    kept = clean.clip_intervals(spans(spark, sf).drop("intensity"), "s", "e", "1997-01-01", "1998-12-31")
    return kept.withColumn("days", duration_days("s", "e"))


@query(on(PANEL, "SELECT entity, week_start + 1 AS week_start, outcome FROM panel"))
def shifted_period_key(spark, sf):
    return cal.shift_key(panel(spark, sf).select("entity", "week_start", "outcome"), "week_start", 1)
