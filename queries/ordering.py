"""Dedup, top-k, unions and exact order statistics over whole tables."""

from pyspark.sql import functions as F

from weekwise.functions.dates import week_start
from weekwise.operators import dedup, ordered

from . import query
from .base import PANEL, on, panel, rounded, table, tidy

EVENT_COLS = "event_id, ts, user_id, event_type, value"


def events(spark, sf):
    return table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")


@query(f"SELECT {EVENT_COLS} FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1")
def dedup_keep_last(spark, sf):
    e = events(spark, sf).withColumn("date", F.to_date("ts"))
    return dedup.dedup_last(e, ["user_id", "date"], ["ts", "event_id"]).drop("date")


@query(f"SELECT {EVENT_COLS} FROM events QUALIFY row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) = 1")
def dedup_keep_first(spark, sf):
    e = events(spark, sf).withColumn("date", F.to_date("ts"))
    return dedup.dedup_first(e, ["event_type", "date"], ["ts", "event_id"]).drop("date")


@query("""
  WITH a AS (SELECT user_id % 7 AS area, CAST(ts AS DATE) AS date, user_id, max(CASE WHEN event_type <> 'signup' THEN value END) AS v FROM events GROUP BY 1, 2, 3)
  SELECT area, date, user_id, v FROM a WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY area, date ORDER BY user_id) = 1""")
def station_by_priority(spark, sf):
    a = events(spark, sf).groupBy((F.col("user_id") % 7).alias("area"), F.to_date("ts").alias("date"), "user_id").agg(
        F.max(F.when(F.col("event_type") != "signup", F.col("value"))).alias("v"))
    return dedup.pick_by_priority(a, ["area", "date"], "user_id", F.col("v").isNotNull())


@query("""
  WITH x AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS chunk_key, user_id AS identifier, event_type AS path, event_id AS info_pos, value FROM events)
  SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY chunk_key, identifier ORDER BY path DESC, info_pos DESC) = 1""")
def alert_dedup(spark, sf):
    x = events(spark, sf).select(F.date_trunc("month", "ts").cast("date").alias("chunk_key"), F.col("user_id").alias("identifier"),
                                 F.col("event_type").alias("path"), F.col("event_id").alias("info_pos"), "value")
    return dedup.dedup_alerts(x)


@query(on(PANEL, "SELECT entity, week_start, exposure FROM panel ORDER BY exposure DESC NULLS LAST, entity, week_start LIMIT 25"))
def top_exposure_weeks(spark, sf):
    rows = panel(spark, sf).select("entity", "week_start", "exposure")
    return dedup.top_k(rows, [F.desc_nulls_last("exposure"), "entity", "week_start"], 25)


@query("""
  SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, 'orders' AS feed, count(*) AS n FROM orders GROUP BY 1
  UNION ALL SELECT CAST(date_trunc('week', l_shipdate) AS DATE), 'lines', count(*) FROM lineitem GROUP BY 1""")
def union_of_feeds(spark, sf):
    def weekly(name, c, label):
        t = table(spark, sf, name, c)
        return t.groupBy(week_start(c).alias("week_start")).agg(F.count("*").alias("n")).withColumn("feed", F.lit(label))

    return dedup.union_panels([weekly("orders", "o_orderdate", "orders"), weekly("lineitem", "l_shipdate", "lines")])


@query("""
  WITH h AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1),
  w AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01' GROUP BY 1)
  SELECT week_start, n, NULL::DOUBLE AS top FROM w UNION ALL SELECT week_start, n, top FROM h WHERE week_start NOT IN (SELECT week_start FROM w)""")
def append_newer_source(spark, sf):
    hist = table(spark, sf, "orders", "o_orderdate", "o_totalprice").groupBy(week_start("o_orderdate").alias("week_start")).agg(
        F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    lines = table(spark, sf, "lineitem", "l_shipdate").where("l_shipdate >= timestamp_ntz'2001-01-01'")
    new = lines.groupBy(week_start("l_shipdate").alias("week")).agg(F.count("*").alias("lines"))
    return dedup.append_mapped(hist, new, {"week": "week_start", "lines": "n"}, "week_start")


@query("""
  WITH u AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, o_orderpriority AS extract_name, count(*) AS n FROM orders GROUP BY 1, 2)
  SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY week_start ORDER BY extract_name DESC) = 1""")
def latest_extract_per_week(spark, sf):
    o = table(spark, sf, "orders", "o_orderdate", "o_orderpriority")
    u = o.groupBy(week_start("o_orderdate").alias("week_start"), F.col("o_orderpriority").alias("extract_name")).agg(F.count("*").alias("n"))
    return dedup.concat_latest(u, "week_start", "extract_name")


@query(rounded("""
  SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS q10, quantile_cont(l_extendedprice, 0.5) AS q50,
         quantile_cont(l_extendedprice, 0.975) AS q97 FROM lineitem GROUP BY 1""", "q10 q50 q97"))
def exact_quantiles_by_group(spark, sf):
    x = table(spark, sf, "lineitem", "l_returnflag", "l_extendedprice")
    return tidy(ordered.quantiles(x, "l_extendedprice", {"q10": 0.1, "q50": 0.5, "q97": 0.975}, "l_returnflag"))


@query("""
  SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
    + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rk FROM lineitem""")
def average_ranks(spark, sf):
    x = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return ordered.average_ranks(x, "l_quantity", "rk", "l_returnflag").select("l_orderkey", "l_linenumber", "rk")


@query("""
  WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)
  SELECT l_returnflag, l_quantity, n, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - n AS BIGINT) AS n_before,
         CAST(sum(n) OVER (PARTITION BY l_returnflag) AS BIGINT) AS n_total FROM c""")
def cumulative_counts(spark, sf):
    return ordered.ladder(table(spark, sf, "lineitem", "l_returnflag", "l_quantity"), "l_quantity", "l_returnflag")
