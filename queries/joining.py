"""Joins, lookups, patching, interval and nearest-observation queries."""

from pyspark.sql import functions as F

from weekwise.functions.dates import week_start
from weekwise.operators import joins as jn
from weekwise.operators.aggregate import weekly_agg
from weekwise.operators.calendar import common_keys, key_alignment

from . import query
from .base import PANEL, PARENTS, SCORED, full_panel, on, panel, parents, rounded, scored, table, tidy
from .panels import SHIPPED, shipped


@query(rounded(on(SCORED, """
  SELECT f.entity, f.week_start, f.outcome, s.score, s.level FROM full_panel f LEFT JOIN scored s
  ON f.entity = s.entity AND f.week_start = s.week_start"""), "score"))
def attach_score_to_panel(spark, sf):
    base = full_panel(spark, sf).select("entity", "week_start", "outcome").withColumn("level", F.lit("stale"))
    return tidy(jn.attach(base, scored(spark, sf).select("entity", "week_start", "score", "level"), ["entity", "week_start"]))


@query(on(PANEL + "," + SHIPPED, """
  SELECT p.entity, p.week_start, outcome, n_lines FROM panel p JOIN shipped s ON p.entity = s.entity AND p.week_start = s.week_start"""))
def inner_join_of_feeds(spark, sf):
    a, b = panel(spark, sf), shipped(spark, sf)
    return jn.join_inner(a, b, ["entity", "week_start"]).select("entity", "week_start", "outcome", "n_lines")


@query(on(PANEL, """
  , a AS (SELECT week_start, CAST(sum(outcome) AS BIGINT) AS outcome, CAST(sum(urgent) AS BIGINT) AS urgent FROM panel WHERE entity < 10 GROUP BY 1),
  b AS (SELECT week_start, CAST(sum(outcome) AS BIGINT) AS outcome, CAST(sum(urgent) AS BIGINT) AS urgent FROM panel WHERE entity >= 10 GROUP BY 1)
  SELECT a.week_start, a.outcome AS outcome_a, a.urgent AS urgent_a, b.outcome AS outcome_b, b.urgent AS urgent_b
  FROM a JOIN b ON a.week_start = b.week_start"""))
def suffixed_join(spark, sf):
    def half(cond):
        return panel(spark, sf).where(cond).groupBy("week_start").agg(
            F.sum("outcome").alias("outcome"), F.sum("urgent").alias("urgent"))

    return jn.join_suffixed(half(F.col("entity") < 10), half(F.col("entity") >= 10), "week_start", ("_a", "_b"))


@query(on(PANEL + "," + PARENTS, """
  SELECT p.entity, week_start, outcome, parent, population FROM panel p LEFT JOIN parents q ON p.entity = q.entity"""))
def lookup_join(spark, sf):
    return jn.lookup(panel(spark, sf).select("entity", "week_start", "outcome"), "entity", parents(spark, sf), "entity")


DONOR = """donor AS (
  SELECT c_nationkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, avg(l_extendedprice) / 100 AS exposure,
         CASE WHEN count(*) % 3 = 0 THEN NULL ELSE count(*) END AS outcome
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' GROUP BY 1, 2)"""


def donor(spark, sf):
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_shipdate", "l_extendedprice", "l_returnflag").where("l_returnflag = 'R'")
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    customer = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    return weekly_agg(rows.withColumnRenamed("c_nationkey", "entity"), "entity", "l_shipdate", {
        "exposure": F.avg("l_extendedprice") / 100,
        "outcome": F.when(F.count("*") % 3 != 0, F.count("*")),
    })


def main_feed(spark, sf):
    return panel(spark, sf).select("entity", "week_start", "outcome", "exposure", "urgent")


PATCH = """SELECT m.entity, m.week_start, m.urgent, CASE WHEN d.entity IS NOT NULL THEN d.outcome ELSE m.outcome END AS outcome,
    CASE WHEN d.entity IS NOT NULL THEN d.exposure ELSE m.exposure END AS exposure,
    CAST(d.entity IS NOT NULL AS INTEGER) AS patched, CASE WHEN d.entity IS NOT NULL THEN 'returns' END AS donor_station
  FROM panel m LEFT JOIN donor d ON m.entity = d.entity AND m.week_start = d.week_start"""


@query(rounded(on(PANEL + "," + DONOR, PATCH), "exposure", 3))
def patch_from_donor(spark, sf):
    return tidy(jn.patch_from_donor(main_feed(spark, sf), donor(spark, sf), ["entity", "week_start"], "patched", "returns"), 3)


@query(rounded(on(PANEL + "," + DONOR, PATCH + """ UNION ALL
  SELECT entity, week_start, NULL, outcome, exposure, 1, 'returns' FROM donor d
  WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.entity = d.entity AND p.week_start = d.week_start)"""), "exposure", 3))
def patch_and_append_from_donor(spark, sf):
    return tidy(jn.patch_from_donor(
        main_feed(spark, sf), donor(spark, sf), ["entity", "week_start"], "patched", "returns", append=True), 3)


@query(on(PANEL + "," + DONOR, """
  SELECT entity, count(*) FILTER (WHERE hit) AS in_both, count(*) FILTER (WHERE NOT hit) AS donor_only FROM (
    SELECT d.entity, EXISTS (SELECT 1 FROM panel p WHERE p.entity = d.entity AND p.week_start = d.week_start) AS hit FROM donor d)
  GROUP BY entity"""))
def donor_overlap_split(spark, sf):
    m, d, keys = main_feed(spark, sf), donor(spark, sf), ["entity", "week_start"]
    parts = jn.rows_in_both(d, m, keys).withColumn("hit", F.lit(True)).unionByName(
        jn.rows_only_in(d, m, keys).withColumn("hit", F.lit(False)))
    return parts.groupBy("entity").agg(F.count_if("hit").alias("in_both"), F.count_if(~F.col("hit")).alias("donor_only"))


@query(on(PANEL + "," + SHIPPED, """
  SELECT entity, week_start, 'orders' AS side FROM (SELECT entity, week_start FROM panel EXCEPT SELECT entity, week_start FROM shipped)
  UNION ALL SELECT entity, week_start, 'shipments' FROM (SELECT entity, week_start FROM shipped EXCEPT SELECT entity, week_start FROM panel)"""))
def key_alignment_audit(spark, sf):
    return key_alignment(panel(spark, sf), shipped(spark, sf), ["entity", "week_start"], ("orders", "shipments"))


@query(on(PANEL + "," + SHIPPED, "SELECT entity, week_start FROM panel INTERSECT SELECT entity, week_start FROM shipped"))
def key_intersection(spark, sf):
    return common_keys(panel(spark, sf), shipped(spark, sf), ["entity", "week_start"])


@query("""
  WITH m AS (SELECT *, CAST(ts AS DATE) AS date, CAST(abs(hour(ts) * 60 + minute(ts) - 720) AS INTEGER) AS abs_min_from_target FROM events)
  SELECT user_id, date, ts, event_id, value, abs_min_from_target FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, date ORDER BY abs_min_from_target, ts, event_id) AS rn
    FROM m WHERE abs_min_from_target <= 90) WHERE rn = 1""")
def nearest_to_noon(spark, sf):
    e = table(spark, sf, "events", "user_id", "ts", "event_id", "value")
    return jn.nearest_in_day(e, ["user_id"], "ts", 720, 90)


@query("""
  WITH a AS (SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS alias, min(p_brand) OVER (PARTITION BY p_name) AS brand FROM part WHERE p_size < 20)
  SELECT p_partkey, a.brand FROM part LEFT JOIN a ON trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) = a.alias""")
def canonical_names(spark, sf):
    part = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size")
    aliases = part.where("p_size < 20").groupBy(F.col("p_name").alias("alias")).agg(F.min("p_brand").alias("canonical"))
    return jn.canonical_entity(part, "p_name", aliases, "brand").select("p_partkey", "brand")


@query(on(PANEL, "SELECT entity, week_start, CASE entity WHEN 0 THEN 'zero' WHEN 7 THEN 'seven' END AS label FROM panel"))
def mapped_column(spark, sf):
    return jn.map_column(panel(spark, sf).select("entity", "week_start"), "entity", {0: "zero", 7: "seven"}, "label")


@query("""
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, l_returnflag, count(*) AS n FROM lineitem SEMI JOIN orders
  ON l_orderkey = o_orderkey AND o_orderpriority = '1-URGENT' GROUP BY 1, 2""")
def semi_join_weeks(spark, sf):
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_shipdate", "l_returnflag")
    urgent = table(spark, sf, "orders", "o_orderkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'")
    kept = jn.rows_in_both(lines, urgent.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    return kept.groupBy(week_start("l_shipdate").alias("week_start"), "l_returnflag").agg(F.count("*").alias("n"))


STATIONS = """wk AS (SELECT entity, week_start, outcome AS n_days, least(outcome / 7, 1) AS coverage, exposure FROM panel),
bnd AS (SELECT entity, min(week_start) AS lo, max(week_start) AS hi FROM panel GROUP BY entity),
spn AS (SELECT entity, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_start FROM bnd),
gw AS (SELECT s.entity, s.week_start FROM spn s LEFT JOIN wk ON s.entity = wk.entity AND s.week_start = wk.week_start WHERE coalesce(coverage, 0) < 4 / 7),
stn AS (SELECT c_nationkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, l_returnflag AS station, count(*) AS n_days,
   least(count(*) / 7, 1) AS coverage, avg(l_extendedprice) / 100 AS exposure
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
dn AS (SELECT stn.* FROM stn JOIN gw ON stn.entity = gw.entity AND stn.week_start = gw.week_start
       QUALIFY row_number() OVER (PARTITION BY stn.entity, stn.week_start ORDER BY station DESC) = 1)"""


@query(rounded(on(PANEL + "," + STATIONS, """
  SELECT wk.entity, wk.week_start, CASE WHEN dn.entity IS NULL THEN wk.n_days ELSE dn.n_days END AS n_days,
    CASE WHEN dn.entity IS NULL THEN wk.coverage ELSE dn.coverage END AS coverage, CASE WHEN dn.entity IS NULL THEN wk.exposure ELSE dn.exposure END AS exposure,
    CAST(dn.entity IS NOT NULL AS INTEGER) AS imputed_from_donor, dn.station AS donor_station
  FROM wk LEFT JOIN dn ON wk.entity = dn.entity AND wk.week_start = dn.week_start
  UNION ALL SELECT entity, week_start, n_days, coverage, exposure, 1, station FROM dn
  WHERE NOT EXISTS (SELECT 1 FROM wk WHERE wk.entity = dn.entity AND wk.week_start = dn.week_start)"""), "coverage exposure", 4))
def gap_repair_by_station_priority(spark, sf):
    """Weeks of coverage gaps, in all entities at once, replaced by the preferred of three donor series."""
    from weekwise.plans.feeds import repair_gaps

    weekly = panel(spark, sf).select("entity", "week_start", F.col("outcome").alias("n_days"),
                                     F.least(F.col("outcome") / 7, F.lit(1.0)).alias("coverage"), "exposure")
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_shipdate", "l_extendedprice", "l_returnflag")
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    customer = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    rows = rows.withColumnsRenamed({"c_nationkey": "entity", "l_returnflag": "station"})
    stations = weekly_agg(rows, ["entity", "station"], "l_shipdate", {
        "n_days": F.count("*"), "coverage": F.least(F.count("*") / 7, F.lit(1.0)), "exposure": F.avg("l_extendedprice") / 100})
    ranked = stations.withColumn("priority", -F.ascii("station"))
    return tidy(repair_gaps(weekly, ranked), 4)


@query(on(SCORED, "SELECT f.entity, f.week_start, f.outcome, s.level FROM full_panel f JOIN scored s ON f.entity = s.entity AND f.week_start = s.week_start"))
def one_to_one_join(spark, sf):
    """A join whose keys are checked on both sides; a repeated key on either side is an error before any row is joined."""
    from weekwise.operators.quality import assert_one_to_one

    keys = ["entity", "week_start"]
    a, b = full_panel(spark, sf).select(*keys, "outcome"), scored(spark, sf).select(*keys, "level")
    assert_one_to_one(a, b, keys)
    try:
        assert_one_to_one(a, b.unionByName(b.limit(1)), keys)
    except ValueError:
        return jn.join_inner(a, b, keys)
    raise AssertionError("a repeated key went unnoticed")
