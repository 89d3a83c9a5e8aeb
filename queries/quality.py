"""Contracts and audits."""

from pyspark.sql import functions as F

from weekwise.functions.numbers import ordinal
from weekwise.operators import quality as ql

from . import query
from .base import FULL, PANEL, SCORED, full_panel, on, panel, rounded, scored, table, tidy


def broken(spark, sf):
    """The gappy panel with faults: repeated weeks, keys off Monday and unknown outcomes."""
    df = panel(spark, sf)
    extra = df.where("outcome = 5").withColumn("outcome", F.lit(None).cast("long"))
    moved = df.where("outcome = 6").withColumn("week_start", F.date_add("week_start", 1))
    return df.unionByName(extra).unionByName(moved)


BROKEN = PANEL + """,
broken AS (SELECT entity, week_start, outcome, exposure, peak FROM panel UNION ALL SELECT entity, week_start, NULL, exposure, peak FROM panel WHERE outcome = 5
  UNION ALL SELECT entity, week_start + 1, outcome, exposure, peak FROM panel WHERE outcome = 6)"""


@query(on(FULL, "SELECT count(*) FILTER (WHERE exposure IS NULL) AS null_keys FROM full_panel"))
def null_key_count(spark, sf):
    return ql.check_key_valid(full_panel(spark, sf), "exposure")


@query(on(BROKEN, "SELECT entity, week_start, count(*) AS copies FROM broken GROUP BY 1, 2 HAVING count(*) > 1"))
def duplicate_keys(spark, sf):
    return ql.check_unique(broken(spark, sf), ["entity", "week_start"])


@query(on(BROKEN, "SELECT entity, week_start FROM broken WHERE dayofweek(week_start) <> 1"))
def keys_off_monday(spark, sf):
    return ql.check_monday(broken(spark, sf)).select("entity", "week_start")


@query("SELECT l_orderkey, l_linenumber, l_discount * 12 AS coverage FROM lineitem WHERE l_discount * 12 > 1 OR l_discount * 12 < 0")
def coverage_outside_unit(spark, sf):
    x = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_discount").withColumn("coverage", F.col("l_discount") * 12)
    return ql.check_unit_interval(x, "coverage").drop("l_discount")


@query(on(PANEL, """
  SELECT entity, CAST((max(week_start) - min(week_start)) // 7 + 1 AS BIGINT) AS expected, count(DISTINCT week_start) AS actual, count(*) AS rows,
         (max(week_start) - min(week_start)) // 7 + 1 = count(*) AS complete FROM panel GROUP BY entity"""))
def panel_completeness(spark, sf):
    return ql.check_complete(panel(spark, sf), "entity")


@query(on(BROKEN, """
  , k AS (SELECT entity, week_start, count(*) AS n FROM broken GROUP BY 1, 2), d AS (SELECT CAST(sum(n - 1) AS BIGINT) AS v FROM k),
  m AS (SELECT count(*) FILTER (WHERE outcome IS NULL) + count(*) FILTER (WHERE exposure IS NULL) AS v FROM broken)
  SELECT 'required_columns' AS "check", false AS ok, 1::BIGINT AS detail UNION ALL SELECT 'key_parses', true, 0
  UNION ALL SELECT 'duplicate_keys', v = 0, v FROM d UNION ALL SELECT 'missing_cells', v = 0, v FROM m UNION ALL SELECT 'negative_values', true, 0"""))
def generic_checks(spark, sf):
    return ql.checks(broken(spark, sf), ["outcome", "exposure", "no_such_column"], ["entity", "week_start"], "week_start", ["exposure"])


def _missing(c: str, src: str = "full_panel") -> str:
    return f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS missing, round(count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*), 4) AS missing_pct FROM {src}"""


@query(on(FULL, " UNION ALL ".join(map(_missing, ("outcome", "exposure", "peak", "share")))))
def missing_by_column(spark, sf):
    return ql.missing_table(full_panel(spark, sf), ["outcome", "exposure", "peak", "share"])


@query(rounded(on(FULL, """
  SELECT entity, CAST(year(week_start) AS INTEGER) AS year, count(*) AS n, avg(CAST(exposure IS NULL AS INTEGER)) AS missing_rate FROM full_panel GROUP BY 1, 2"""), "missing_rate"))
def missing_by_year(spark, sf):
    return tidy(ql.missing_by(full_panel(spark, sf), "exposure", F.year("week_start"), "year", "entity"))


@query(on(FULL, """
  SELECT entity, 'exposure' AS "column", min(week_start) FILTER (WHERE exposure IS NULL) AS first_null, max(week_start) FILTER (WHERE exposure IS NULL) AS last_null,
         count(*) FILTER (WHERE exposure IS NULL) AS n_null FROM full_panel GROUP BY entity"""))
def null_period(spark, sf):
    return ql.null_periods(full_panel(spark, sf), ["exposure"], by="entity")


def _audit(c: str, t: str) -> str:
    zero = f"count(*) FILTER (WHERE {c} <> 0)" if t != "date" else f"count({c})"
    return f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(DISTINCT {c}) AS "distinct", {zero} AS non_zero, '{t}' AS dtype FROM full_panel"""


@query(on(FULL, " UNION ALL ".join(_audit(c, t) for c, t in (("week_start", "date"), ("outcome", "bigint"), ("exposure", "double"), ("missing", "int")))))
def column_audit(spark, sf):
    return ql.column_audit(full_panel(spark, sf), ["week_start", "outcome", "exposure", "missing"])


@query("SELECT dayname(o_orderdate) AS weekday, count(*) AS n FROM orders GROUP BY 1")
def weekday_distribution(spark, sf):
    return ql.weekday_counts(table(spark, sf, "orders", "o_orderdate"), "o_orderdate")


STRUCTURE = BROKEN + """,
k AS (SELECT entity, week_start, count(*) AS n FROM broken GROUP BY 1, 2),
dk AS (SELECT entity, CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) AS actual_weeks FROM k GROUP BY 1),
ag AS (SELECT entity, count(*) AS rows, count(*) FILTER (WHERE outcome IS NULL) AS nulls, min(week_start) AS first_week, max(week_start) AS last_week,
  min(outcome) AS y_min, max(outcome) AS y_max, avg(outcome) AS y_mean FROM broken GROUP BY 1),
au AS (SELECT ag.*, duplicates, actual_weeks, CAST(floor((last_week - first_week) / 7 + 1) AS BIGINT) AS expected_weeks FROM ag JOIN dk ON ag.entity = dk.entity),
st AS (SELECT *, expected_weeks - actual_weeks AS missing_weeks, nulls * 100.0::DOUBLE / rows AS null_pct,
  (expected_weeks - actual_weeks) * 100.0::DOUBLE / expected_weeks AS missing_pct FROM au)"""


@query(rounded(on(STRUCTURE, """
  SELECT *, CASE WHEN null_pct > 5 OR missing_pct > 10 THEN 'red' WHEN null_pct < 1 AND duplicates = 0 AND missing_pct < 2 THEN 'green' ELSE 'yellow' END AS verdict FROM st"""),
  "y_mean null_pct missing_pct"))
def structure_audit(spark, sf):
    out = ql.audit_structure(broken(spark, sf), "outcome", "entity").withColumns(
        {c: F.col(c).cast("double") for c in ("null_pct", "missing_pct")})
    return tidy(out.withColumn("verdict", ql.traffic_light(F.col("null_pct"), F.col("duplicates"), F.col("missing_pct"))))


@query(on(BROKEN, """
  , b AS (SELECT entity, min(week_start) AS lo, max(week_start) AS hi FROM broken GROUP BY 1),
  s AS (SELECT entity, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_start FROM b)
  SELECT entity, week_start, 'null_outcome' AS issue FROM broken WHERE outcome IS NULL
  UNION ALL SELECT entity, week_start, 'duplicate_week' FROM broken GROUP BY 1, 2 HAVING count(*) > 1
  UNION ALL SELECT entity, week_start, 'not_monday' FROM broken WHERE dayofweek(week_start) <> 1
  UNION ALL SELECT entity, week_start, 'missing_week' FROM s WHERE NOT EXISTS (SELECT 1 FROM broken k WHERE k.entity = s.entity AND k.week_start = s.week_start)"""))
def structure_flags(spark, sf):
    return ql.structure_flags(broken(spark, sf), "outcome", "entity")


RANGES = {"exposure": (60.0, 450.0), "share": (None, 0.9), "gust": (0.0, 80.0)}


def logic():
    return {"peak<exposure": ("peak", F.col("peak") < F.col("exposure")), "few_urgent": ("urgent", F.col("urgent") > F.col("outcome") - 1)}


@query(on(FULL, """
  SELECT entity, count(*) AS rows, count(*) FILTER (WHERE exposure < 60 OR exposure > 450) AS exposure_violations,
    count(*) FILTER (WHERE share > 0.9) AS share_violations, -1::BIGINT AS gust_violations, count(*) FILTER (WHERE peak < exposure) AS "peak<exposure_violations",
    count(*) FILTER (WHERE urgent > outcome - 1) AS few_urgent_violations,
    count(*) FILTER (WHERE exposure < 60 OR exposure > 450) + count(*) FILTER (WHERE share > 0.9) + count(*) FILTER (WHERE peak < exposure)
      + count(*) FILTER (WHERE urgent > outcome - 1) AS total_violations FROM full_panel GROUP BY entity"""))
def range_audit(spark, sf):
    return ql.audit_ranges(full_panel(spark, sf), RANGES, "entity", logic())


@query(on(FULL, """
  SELECT entity, week_start, 'exposure' AS variable, exposure AS value, '[60.0, 450.0]' AS bounds, 'OUTLIER' AS status FROM full_panel WHERE exposure < 60 OR exposure > 450
  UNION ALL SELECT entity, week_start, 'share', share, '[-inf, 0.9]', 'VIOLATION' FROM full_panel WHERE share > 0.9
  UNION ALL SELECT entity, week_start, 'peak<exposure', peak, 'peak<exposure', 'LOGIC' FROM full_panel WHERE peak < exposure
  UNION ALL SELECT entity, week_start, 'few_urgent', CAST(urgent AS DOUBLE), 'few_urgent', 'LOGIC' FROM full_panel WHERE urgent > outcome - 1"""))
def range_violations(spark, sf):
    return ql.range_flags(full_panel(spark, sf), RANGES, ["entity", "week_start"], logic())


@query("""
  WITH t AS (SELECT user_id, CASE WHEN event_type = 'error' THEN ts ELSE date_trunc('day', ts) + to_hours(CAST(hour(ts) // 6 * 6 AS INTEGER)) END AS t FROM events),
  d AS (SELECT user_id, t, count(*) AS n FROM t GROUP BY 1, 2)
  SELECT user_id, CAST((date_diff('hour', date_trunc('day', min(t)), date_trunc('day', max(t))) + 24) // 6 AS BIGINT) AS expected,
    count(*) FILTER (WHERE hour(t) % 6 = 0 AND date_trunc('hour', t) = t) AS present,
    CAST(coalesce(sum(n) FILTER (WHERE NOT (hour(t) % 6 = 0 AND date_trunc('hour', t) = t)), 0) AS BIGINT) AS invalid_rows,
    CAST((date_diff('hour', date_trunc('day', min(t)), date_trunc('day', max(t))) + 24) // 6 AS BIGINT) - count(*) FILTER (WHERE hour(t) % 6 = 0 AND date_trunc('hour', t) = t) AS missing
  FROM d GROUP BY user_id""")
def six_hourly_completeness(spark, sf):
    e = table(spark, sf, "events", "user_id", "ts", "event_type")
    day = F.to_date("ts").cast("timestamp_ntz")
    step = day + F.make_dt_interval(hours=(F.floor(F.hour("ts") / 6) * 6).cast("int"))
    t = e.select("user_id", F.when(F.col("event_type") == "error", F.col("ts")).otherwise(step).alias("t"))
    return ql.audit_subdaily(t, "t", "user_id", 6)


@query("""
  WITH d AS (SELECT user_id % 7 AS area, CASE WHEN event_type <> 'signup' THEN CAST(ts AS DATE) END AS date FROM events), k AS (SELECT area, date, count(*) AS n FROM d GROUP BY 1, 2)
  SELECT area, CAST(coalesce(sum(n) FILTER (WHERE date IS NULL), 0) AS BIGINT) AS null_dates, count(*) FILTER (WHERE date IS NOT NULL AND n > 1) AS duplicate_dates FROM k GROUP BY area""")
def daily_contract(spark, sf):
    e = table(spark, sf, "events", "user_id", "ts", "event_type").select(
        (F.col("user_id") % 7).alias("area"), F.when(F.col("event_type") != "signup", F.to_date("ts")).alias("date"))
    return ql.check_daily(e, ["area"], "date", "area")


@query(rounded(on(FULL, """
  , b AS (SELECT entity, week_start, outcome + 1 AS outcome, CASE WHEN missing = 0 THEN exposure * 1.5 ELSE 0 END AS exposure FROM full_panel WHERE outcome <> 4),
  j AS (SELECT a.outcome AS ao, b.outcome AS bo, a.exposure AS ae, b.exposure AS be, b.entity IS NULL AS un FROM full_panel a LEFT JOIN b ON a.entity = b.entity AND a.week_start = b.week_start)
  SELECT 'outcome' AS "column", max(abs(ao - bo))::DOUBLE AS max_abs_diff, count(*) FILTER (WHERE (ao IS NULL) <> (bo IS NULL)) AS null_mismatch, count(*) FILTER (WHERE un) AS unmatched_rows FROM j
  UNION ALL SELECT 'exposure', max(abs(ae - be)), count(*) FILTER (WHERE (ae IS NULL) <> (be IS NULL)), count(*) FILTER (WHERE un) FROM j"""), "max_abs_diff"))
def stored_copies_compared(spark, sf):
    a = full_panel(spark, sf)
    b = a.where("outcome <> 4").withColumns({
        "outcome": F.col("outcome") + 1, "exposure": F.when(F.col("missing") == 0, F.col("exposure") * 1.5).otherwise(0.0)})
    return tidy(ql.table_diff(a, b, ["entity", "week_start"], ["outcome", "exposure"]))


@query(rounded(on(SCORED, """
  SELECT entity, count(*) AS rows, min(week_start) AS first_week, max(week_start) AS last_week, 100.0::DOUBLE * count(*) FILTER (WHERE score IS NULL) / count(*) AS missing_pct,
    avg(score) AS mean, stddev_samp(score) AS std, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.9) AS p90, quantile_cont(score, 0.99) AS p99,
    count(DISTINCT score) AS n_unique, max(CASE level WHEN 'none' THEN 0 WHEN 'possible' THEN 1 WHEN 'probable' THEN 2 ELSE 3 END) AS top_level FROM scored GROUP BY entity"""),
  "missing_pct mean std median p90 p99"))
def score_audit(spark, sf):
    """Score audit per entity; an entity's weeks are few, so the built-in percentile is safe here."""
    score = F.col("score")
    return tidy(scored(spark, sf).groupBy("entity").agg(
        F.count("*").alias("rows"), F.min("week_start").alias("first_week"), F.max("week_start").alias("last_week"),
        (F.count_if(score.isNull()) * F.lit(100.0) / F.count("*")).alias("missing_pct"), F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("std"), *[F.percentile(score, q).alias(n) for n, q in (("median", 0.5), ("p90", 0.9), ("p99", 0.99))],
        F.count_distinct(score).alias("n_unique"), F.max(ordinal("level")).alias("top_level")))
