"""Parsing and scalar functions, applied to text that Spark derives from the tables."""

from pyspark.sql import functions as F

from weekwise.functions import dates, numbers, text

from . import query
from .base import PANEL, on, panel, rounded, table, tidy


@query("""
  WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
  SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(date_trunc('week', d) AS DATE) END AS week_start FROM d""")
def iso_period_text(spark, sf):
    """Orders' weeks written as 1998SM40, every 11th broken (week 60), and read back."""
    d = F.col("o_orderdate").cast("date")
    week = F.when(F.col("o_orderkey") % 11 == 0, 60).otherwise(F.weekofyear(d))
    period = F.concat(dates.iso_year(d).cast("string"), F.lit("SM"), F.lpad(week.cast("string"), 2, "0"))
    return table(spark, sf, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", dates.iso_period_to_week(period).alias("week_start"))


@query("""
  WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)
  SELECT y, CASE WHEN weekofyear(make_date(y, 12, 28)) = 53 THEN CAST(date_trunc('week', make_date(y, 12, 28)) AS DATE) END AS week53 FROM y""")
def invalid_week_53(spark, sf):
    years = table(spark, sf, "orders", "o_orderdate").select(F.year("o_orderdate").alias("y")).distinct()
    return years.select("y", dates.iso_period_to_week(F.concat(F.col("y").cast("string"), F.lit("SM53"))).alias("week53"))


@query("SELECT event_id, CAST(date_trunc('week', ts) AS DATE) AS week_start, CAST(ts AS DATE) AS naive FROM events")
def monday_of_timestamp(spark, sf):
    e = table(spark, sf, "events", "event_id", "ts")
    instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    return e.select("event_id", dates.week_start("ts").alias("week_start"), dates.week_naive(instant).alias("naive"))


@query("""
  SELECT event_id, epoch_us(ts) // 1000 AS back_ms, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS back_s, CAST(ts AS DATE) AS iso_date FROM events""")
def epoch_round_trip(spark, sf):
    e = table(spark, sf, "events", "event_id", "ts")
    millis = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return e.select(
        "event_id",
        F.unix_millis(dates.epoch_to_ts(millis.cast("string"), "ms")).alias("back_ms"),
        F.unix_seconds(dates.epoch_to_ts(F.floor(millis / 1000), "s")).alias("back_s"),
        F.to_date(dates.epoch_to_ts(F.col("ts").cast("string"), "iso")).alias("iso_date"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS eu, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS comma FROM orders")
def european_numbers(spark, sf):
    """Prices written as 1.234.567,89 and 1234567,89 and parsed back; every 13th is text."""
    o = table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    us = F.format_number("o_totalprice", 2)
    eu = F.translate(us, ",.", ".,")
    bad = F.col("o_orderkey") % 13 == 0
    return o.select(
        "o_orderkey", numbers.parse_eu_number(F.when(bad, " ").otherwise(eu)).alias("eu"),
        numbers.parse_comma_decimal(F.when(bad, "Ip").otherwise(F.concat(F.lit('"'), F.regexp_replace(eu, r"\.", ""), F.lit('"')))).alias("comma"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS v FROM events")
def coerced_numbers(spark, sf):
    e = table(spark, sf, "events", "event_id", "event_type", "value")
    raw = F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("value").cast("string"))
    return e.select("event_id", numbers.to_double(raw).alias("v"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders")
def mixed_dates(spark, sf):
    """Dates written as spreadsheet serial, day-first text, ISO text or junk, read by one expression."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    raw = (
        F.when(k == 0, F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string"))
        .when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise("no date"))
    return table(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", dates.parse_mixed_date(raw).alias("date"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders")
def dayfirst_dates(spark, sf):
    raw = F.date_format(F.col("o_orderdate").cast("date"), "d/M/yyyy")
    return table(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", dates.parse_dayfirst(raw).alias("date"))


@query("SELECT event_id, date_trunc('hour', ts) AS at FROM events")
def hour_ending_labels(spark, sf):
    """Hours written 1..24 (the hour that ends there) and turned back into timestamps."""
    e = table(spark, sf, "events", "event_id", "ts")
    return e.select("event_id", dates.date_hour_to_ts(F.to_date("ts"), F.hour("ts") + 1).alias("at"))


@query("""
  WITH h AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d, CASE WHEN hour(ts) = 0 THEN 24 ELSE hour(ts) END AS h FROM events),
  z AS (SELECT *, CASE WHEN h = 24 THEN 0 ELSE h END AS z FROM h),
  f AS (SELECT user_id, bool_and(z BETWEEN 1 AND 24) AS ok FROM z GROUP BY user_id)
  SELECT event_id, d + to_hours(CAST(CASE WHEN ok THEN z - 1 ELSE z END AS INTEGER)) AS at FROM z JOIN f ON z.user_id = f.user_id""")
def hour_labels_historical_order(spark, sf):
    e = table(spark, sf, "events", "event_id", "user_id", "ts").withColumns({
        "d": F.to_date("ts"), "h": F.when(F.hour("ts") == 0, 24).otherwise(F.hour("ts"))})
    ok = e.groupBy("user_id").agg(dates.one_based_hours("h").alias("ok"))
    return e.join(ok, "user_id").select("event_id", dates.date_hour_to_ts("d", "h", F.col("ok")).alias("at"))


@query("""
  SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
    CAST(weekofyear(o_orderdate) AS INTEGER) AS iso_week, CAST(isoyear(o_orderdate) AS INTEGER) AS iso_year, monthname(o_orderdate) AS month_name,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders""")
def calendar_parts(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate").withColumn("d", F.col("o_orderdate").cast("date"))
    return dates.add_calendar_parts(o, "d").drop("d", "o_orderdate")


@query("SELECT event_id, CAST(abs(hour(ts) * 60 + minute(ts) - 780) AS INTEGER) AS minutes FROM events")
def minutes_from_target(spark, sf):
    return table(spark, sf, "events", "event_id", "ts").select("event_id", dates.minutes_from("ts", 780).alias("minutes"))


@query(rounded("""
  SELECT l_orderkey, l_linenumber, 100 * exp(17.625::DOUBLE * (t - 5) / (243.04::DOUBLE + t - 5) - 17.625::DOUBLE * t / (243.04::DOUBLE + t)) AS rh
  FROM (SELECT l_orderkey, l_linenumber, l_quantity - 10 AS t FROM lineitem)""", "rh"))
def humidity_from_dew_point(spark, sf):
    x = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").withColumn("t", F.col("l_quantity") - 10)
    return tidy(x.select("l_orderkey", "l_linenumber", numbers.relative_humidity("t", F.col("t") - 5).alias("rh")))


@query("SELECT p_partkey, replace(lower(trim(p_name)), ' ', '_') AS slug FROM part")
def name_slug(spark, sf):
    return table(spark, sf, "part", "p_partkey", "p_name").select("p_partkey", text.slug("p_name").alias("slug"))


@query("SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def accent_free_text(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.md5(text.strip_accents("text")).alias("digest"))


@query("""
  SELECT doc_id, md5(trim(regexp_replace(replace(strip_accents(lower(trim(text))), 'sta.', 'sta'), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents""")
def normalized_names(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.md5(text.normalize_name("text", [("sta.", "sta")])).alias("digest"))


KEYWORDS = {"red": ["red", "rot", "rouge"], "dotted": ["tion.", "the."]}


@query("""
  SELECT doc_id, CAST(regexp_matches(lower(text), 'red|rot|rouge') AS INTEGER) AS red, CAST(regexp_matches(lower(text), 'tion\\.|the\\.') AS INTEGER) AS dotted
  FROM documents""")
def keyword_flags(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", *[e.alias(n) for n, e in text.keyword_flags(["text"], KEYWORDS).items()])


@query("""
  SELECT event_id, CAST(regexp_matches(lower(event_type), 'err|fail') AS INTEGER) AS dust, CAST(regexp_matches(lower(event_type), 'purchase|sign-?up') AS INTEGER) AS heat FROM events""")
def event_classes(spark, sf):
    e = table(spark, sf, "events", "event_id", "event_type")
    rules = {"dust": "err|fail", "heat": "purchase|sign-?up"}
    return e.select("event_id", *[x.alias(n) for n, x in text.event_class(["event_type"], rules).items()])


@query("""
  WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' Minor' WHEN 1 THEN 'moderate' WHEN 2 THEN 'SEVERE' WHEN 3 THEN 'Extreme' ELSE '' END AS sev,
                    CASE o_orderkey % 3 WHEN 0 THEN 'Aviso amarillo' WHEN 1 THEN 'code red today' ELSE 'reddish' END AS txt FROM orders)
  SELECT o_orderkey, greatest(CASE lower(trim(sev)) WHEN 'minor' THEN 1 WHEN 'moderate' THEN 2 WHEN 'severe' THEN 3 WHEN 'extreme' THEN 4 ELSE 0 END,
    CASE WHEN lower(txt) LIKE '%rojo%' OR ' ' || lower(txt) || ' ' LIKE '% red %' THEN 4 WHEN lower(txt) LIKE '%amarillo%' THEN 2 ELSE 0 END) AS level FROM x""")
def alert_levels(spark, sf):
    k = F.col("o_orderkey")
    sev = F.when(k % 5 == 0, " Minor").when(k % 5 == 1, "moderate").when(k % 5 == 2, "SEVERE").when(k % 5 == 3, "Extreme").otherwise("")
    txt = F.when(k % 3 == 0, "Aviso amarillo").when(k % 3 == 1, "code red today").otherwise("reddish")
    return table(spark, sf, "orders", "o_orderkey").select("o_orderkey", text.alert_level(sev, txt).alias("level"))


@query("""
  SELECT user_id, event_id, CAST(coalesce(vis < 9999 OR (vis < 20000 AND rh < 70), false) AS INTEGER) AS confirmed,
         CAST(coalesce(vis IS NULL AND rh < 30, false) AS INTEGER) AS possible
  FROM (SELECT user_id, event_id, CASE WHEN event_type <> 'signup' THEN value * 500 END AS vis, value AS rh FROM events)""")
def low_visibility_rule(spark, sf):
    e = table(spark, sf, "events", "user_id", "event_id", "event_type", "value")
    vis = F.when(F.col("event_type") != "signup", F.col("value") * 500)
    confirmed, possible = numbers.low_visibility(vis, "value")
    return e.select("user_id", "event_id", confirmed.alias("confirmed"), possible.alias("possible"))


@query(on(PANEL, """
  SELECT entity, week_start, least(exposure, peak, CASE WHEN outcome > 1 THEN 100 END::DOUBLE) AS lo,
         greatest(exposure, peak, CASE WHEN outcome > 1 THEN 100 END::DOUBLE) AS hi FROM panel"""))
def row_minimum_and_maximum(spark, sf):
    third = F.when(F.col("outcome") > 1, 100.0)
    return panel(spark, sf).select("entity", "week_start", numbers.row_min("exposure", "peak", third).alias("lo"),
                                   numbers.row_max("exposure", "peak", third).alias("hi"))


@query("SELECT o_orderkey, substr(md5(CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '|' || CAST(CAST(o_orderdate AS DATE) + 6 AS VARCHAR)), 1, 12) AS key FROM orders")
def chunk_keys(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", text.chunk_key(d.cast("string"), F.date_add(d, 6).cast("string")).alias("key"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def decoded_bytes(spark, sf):
    """Texts as UTF-8 bytes for even ids and, where they fit, as Latin-1 bytes for odd ids, decoded by one rule."""
    d = table(spark, sf, "documents", "doc_id", "text")
    fits = (F.col("doc_id") % 2 == 1) & ~F.col("text").rlike(r"[^\x00-\xFF]") & F.col("text").rlike("[À-ÿ][a-z ]")
    raw = F.when(fits, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return d.select("doc_id", F.md5(text.decode_bytes(raw)).alias("digest"))


@query(on(PANEL, "SELECT entity, week_start, 100000.0::DOUBLE * outcome / nullif(urgent, 0) AS rate FROM panel"))
def rate_with_empty_population(spark, sf):
    return panel(spark, sf).select("entity", "week_start", numbers.rate_per("outcome", F.nullif(F.col("urgent"), F.lit(0))).alias("rate"))
