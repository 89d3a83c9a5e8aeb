"""Readers and writers on data derived from the tables: round trips through the shared folder, and
documents, records and sheets that Spark writes from the tables and the parsers read back."""

import gzip
import uuid

import pandas as pd
from pyspark.sql import functions as F

from weekwise.functions.dates import week_start
from weekwise.functions.text import chunk_key, clean_xml_text
from weekwise.operators.joins import build_master
from weekwise.session import scratch_path
from weekwise.sources import alerts as al
from weekwise.sources import files as fs
from weekwise.sources import records as rc
from weekwise.streaming import incremental as inc

from . import query
from .base import FULL, PANEL, SCHEMAS, full_panel, on, panel, rounded, table, tidy


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice AS price, o_orderpriority FROM orders")
def delimited_text_scan(spark, sf):
    from weekwise.functions.dates import parse_dayfirst
    from weekwise.functions.numbers import parse_comma_decimal

    path = scratch_path(spark, "delimited")
    table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority").select(
        "o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("fecha"),
        F.regexp_replace(F.col("o_totalprice").cast("string"), r"\.", ",").alias("total"), "o_orderpriority",
    ).write.csv(path, sep=";", header=True)
    raw = fs.read_delimited(spark, path, ["o_orderkey", "fecha", "total"])
    return raw.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), parse_dayfirst("fecha").alias("date"),
                      parse_comma_decimal("total").alias("price"), "o_orderpriority")


@query("SELECT doc_id, coalesce(lang, '') AS lang, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents")
def delimited_with_line_breaks(spark, sf):
    """Whole texts, line ends and quotes included, as quoted values of delimited files."""
    path = scratch_path(spark, "quoted")
    table(spark, sf, "documents", "doc_id", "lang", "text").select(
        "doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "text")]
    ).write.csv(path, sep=";", header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    raw = fs.read_delimited(spark, path, ["doc_id", "text"], multi_line=True, encoding="utf-8")
    text = F.coalesce("text", F.lit(""))
    return raw.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"),
                      F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("digest"))


@query(on(PANEL, "SELECT entity, week_start, outcome, peak FROM panel"))
def typed_csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    fs.write_table(panel(spark, sf).select("entity", "week_start", "outcome", "peak"), path, ["entity", "week_start"])
    return fs.read_typed_csv(spark, path, "entity INT, week_start DATE, outcome BIGINT, peak DOUBLE")


@query(on(FULL, "SELECT entity, week_start, outcome, exposure FROM full_panel"))
def panel_round_trip(spark, sf):
    path = scratch_path(spark, "panel")
    fs.write_panel(full_panel(spark, sf).select("entity", "week_start", "outcome", "exposure"), path)
    return fs.read_panel(spark, path)


@query(rounded(on(FULL, """
  SELECT entity, week_start, CASE WHEN missing = 0 THEN outcome END AS outcome, CASE WHEN missing = 0 THEN urgent END AS urgent, exposure, peak, share FROM full_panel"""), "exposure peak share"))
def master_of_bucketed_feeds(spark, sf):
    """Calendar and two feeds stored in buckets, joined bucket by bucket."""
    rows, run = panel(spark, sf), uuid.uuid4().hex
    parts = {"calendar": full_panel(spark, sf).select("entity", "week_start"), "outcome": rows.select("entity", "week_start", "outcome", "urgent"),
             "exposure": rows.select("entity", "week_start", "exposure", "peak", "share")}
    calendar, *feeds = [fs.write_feed(df, f"{name}_{run}", buckets=16, path=scratch_path(spark, name)) for name, df in parts.items()]
    return tidy(build_master(calendar, feeds, ["entity", "week_start"]))


CHUNKED = """c AS (SELECT event_id, value, CAST(year(ts) AS INTEGER) AS year_onset,
  substr(md5(CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) || '|' || CAST(CAST(date_trunc('week', ts) AS DATE) + 6 AS VARCHAR)), 1, 12) AS chunk_key FROM events)"""


@query(f"WITH {CHUNKED} SELECT event_id, value * 2 AS value, year_onset, chunk_key FROM c WHERE year_onset >= 2024")
def idempotent_partitioned_sink(spark, sf):
    """Written three times: as is, replaced chunk by chunk with doubled values, then resumed without effect."""
    e = table(spark, sf, "events", "event_id", "value", "ts")
    start = week_start("ts")
    rows = e.select("event_id", "value", F.year("ts").alias("year_onset"),
                    chunk_key(start.cast("string"), F.date_add(start, 6).cast("string")).alias("chunk_key"))
    path = scratch_path(spark, "chunks")
    fs.write_partitioned_idempotent(rows, path)
    fs.write_partitioned_idempotent(rows.withColumn("value", F.col("value") * 2), path)
    fs.write_partitioned_idempotent(rows, path, resume=True)
    return fs.read_chunks(spark, path).where("year_onset >= 2024").select("event_id", "value", "year_onset", "chunk_key")


@query(on(PANEL, """
  SELECT entity, week_start, CASE WHEN week_start >= DATE '1998-01-01' THEN outcome * 10 ELSE outcome END AS outcome FROM panel WHERE week_start < DATE '2000-01-01'
  UNION ALL SELECT entity, week_start, outcome * 10 FROM panel WHERE week_start >= DATE '2000-01-01'"""))
def overlapping_extracts(spark, sf):
    """Two stored extracts that overlap: the later one wins on common weeks."""
    base = scratch_path(spark, "extracts")
    df = panel(spark, sf).select("entity", "week_start", "outcome")
    df.where("week_start < '2000-01-01'").write.parquet(f"{base}/feed_1995_1999")
    df.where("week_start >= '1998-01-01'").withColumn("outcome", F.col("outcome") * 10).write.parquet(f"{base}/feed_1998_2001")
    return fs.read_latest_rows(spark, f"{base}/feed_*", ["entity", "week_start"], ["outcome"])


@query(on(PANEL, "SELECT entity, week_start, outcome FROM panel WHERE week_start >= DATE '1998-01-01'"))
def latest_extract_only(spark, sf):
    base = scratch_path(spark, "latest")
    df = panel(spark, sf).select("entity", "week_start", "outcome")
    df.where("week_start < '2000-01-01'").write.parquet(f"{base}/feed_1995_1999")
    df.where("week_start >= '1998-01-01'").write.parquet(f"{base}/feed_1998_2001")
    return spark.read.parquet(fs.latest_match(spark, f"{base}/feed_*"))


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS fecha, CAST(value AS VARCHAR) AS tmed, user_id AS station FROM events")
def json_records(spark, sf):
    path = scratch_path(spark, "json")
    table(spark, sf, "events", "event_id", "ts", "value", "user_id").select(
        "event_id", F.to_date("ts").cast("string").alias("fecha"), F.col("value").cast("string").alias("tmed"),
        F.col("user_id").alias("station")).write.json(path)
    return fs.read_json_records(spark, path, "event_id BIGINT, fecha STRING, tmed STRING, station BIGINT", multi_line=False)


@query("""
  SELECT event_id, ts AS dt_utc, CASE WHEN event_type = 'view' THEN NULL ELSE floor(value * 100) END AS vis_m, CAST(event_id % 10 AS DOUBLE) AS vis_qc,
    CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id - 50 AS DOUBLE) / 10 END AS temp_c, 1::DOUBLE AS temp_qc,
    CAST(user_id AS DOUBLE) / 10 AS dewpoint_c, 5::DOUBLE AS dew_qc
  FROM (SELECT event_id, event_type, value, user_id, date_trunc('minute', ts) AS ts FROM events)""")
def fixed_width_records(spark, sf):
    """Events written as hourly surface-weather lines and read back; some lines are cut short. Values that the public
    record has no room for, or that are its codes for missing ones, go to a record of the same fields, 24 characters each."""
    e = table(spark, sf, "events", "event_id", "ts", "event_type", "value", "user_id")
    temp, cents = F.col("user_id") - 50, F.col("value") * 100
    unseen, failed = F.col("event_type") == "view", F.col("event_type") == "error"
    sign = F.when(temp < 0, "-").otherwise("+")
    head = F.concat(F.lpad(F.lit("0"), 15, "0"), F.date_format("ts", "yyyyMMddHHmm"))
    public = F.concat(
        head, F.lpad(F.lit("x"), 51, "x"),
        F.when(unseen, "999999").otherwise(F.lpad(F.floor(cents).cast("string"), 6, "0")),
        (F.col("event_id") % 10).cast("string"), F.lit("N1"),
        F.when(failed, "+9999").otherwise(F.concat(sign, F.lpad(F.abs(temp).cast("string"), 4, "0"))),
        F.lit("1"), F.lit("+"), F.lpad(F.col("user_id").cast("string"), 4, "0"), F.lit("5"))
    fits = (F.col("event_id") >= 0) & F.col("user_id").between(0, 9998) & (unseen | ((cents >= 0) & (cents < 999999)))
    code = "9" * 24
    whole = F.when(F.abs(cents) < 2.0**53, F.floor(cents).cast("string")).otherwise(cents.cast("string"))  # larger doubles have no fraction
    wide = F.concat(head, *[F.lpad(F.coalesce(c.cast("string"), F.lit("")), 24, " ") for c in (
        F.when(unseen, code).otherwise(whole), F.col("event_id") % 10, F.when(failed, code).otherwise(temp.cast("string")), F.lit(1), F.col("user_id"), F.lit(5))])
    wide_fields = [rc.Field(f.name, 28 + 24 * k, 24, f.scale, f.missing and code) for k, f in enumerate(rc.HOURLY_FIELDS)]

    def read_back(rows, line, fields):
        lines = rows.select("event_id", line.alias("value")).unionByName(rows.select("event_id", F.substring(line, 1, 20).alias("value")))
        return rc.parse_fixed_width(lines, fields=fields, keep=["event_id"])

    roomy = F.coalesce(fits, F.lit(False))
    out = read_back(e.where(roomy), public, rc.HOURLY_FIELDS).unionByName(read_back(e.where(~roomy), wide, wide_fields))
    return out.withColumn("dt_utc", F.convert_timezone(F.current_timezone(), F.current_timezone(), F.col("dt_utc").cast("timestamp_ntz")))


@query("""
  SELECT event_id, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS PM10,
    value / 2 AS "PM2.5", NULL::DOUBLE AS SO2, value * 3 AS NO2, NULL::DOUBLE AS O3 FROM events WHERE event_type <> 'signup'""")
def station_sheets(spark, sf):
    """A sheet with blank headers, a decimal-comma header, a second block and unreadable dates."""
    e = table(spark, sf, "events", "event_id", "ts", "event_type", "value")
    date = F.when(F.col("event_type") == "signup", "???").otherwise(F.date_format("ts", "dd/MM/yyyy"))
    pm10 = F.when(F.col("event_type") == "view", "-").otherwise(F.col("value").cast("string"))
    sheet = e.select("event_id", date, F.hour("ts").cast("string"), pm10, (F.col("value") / 2).cast("string"), F.lit("x"),
                     (F.col("value") * 3).cast("string"), F.lit("01/01/1900"), F.lit("7")).toDF(
        "event_id", " Fecha", "Hora", "PM10", "PM2,5", "Unnamed: 5", "NO2", "FECHA", "O3")
    return rc.normalize_station_sheet(sheet, keep=["event_id"])


@query("SELECT event_id, value AS PM10, value + 1 AS \"PM2.5\", value + 2 AS O3 FROM events")
def detected_headers(spark, sf):
    e = table(spark, sf, "events", "event_id", "value")
    raw = e.select("event_id", F.col("value"), F.col("value") + 1, F.col("value") + 2).toDF("event_id", "PM 10 (µg/m³)", "PM 2,5", "o3_max")
    return rc.normalize_headers(raw)


def alert_documents(spark, sf):
    """One XML alert per event: two info blocks for clicks, none for views, prefixed tags for errors, broken
    text for signups; some wrapped in noise."""
    e = table(spark, sf, "events", "event_id", "event_type", "value", "ts")
    p = F.when(F.col("event_type") == "error", "cap:").otherwise("")

    def tag(name, body):
        return F.concat(F.lit("<"), p, F.lit(f"{name}>"), body, F.lit("</"), p, F.lit(f"{name}>"))

    def info(kind, *areas):
        inner = [tag("event", F.lit(kind)), tag("severity", F.lit("Severe")), tag("onset", F.date_format("ts", "yyyy-MM-dd"))]
        inner += [tag("area", tag("areaDesc", F.lit(a))) for a in areas]
        return tag("info", F.concat(*inner))

    infos = F.when(F.col("event_type") == "click", F.concat(info("dust", "north", "south"), info("heat", "west"))).when(
        F.col("event_type") == "view", "").otherwise(info("wind & rain".replace("&", "&amp;"), "east"))
    body = F.concat(F.lit("<"), p, F.lit('alert xmlns="urn:x" xmlns:cap="urn:y">'), tag("identifier", F.col("event_id").cast("string")),
                    tag("sender", F.lit("office")), infos, F.lit("</"), p, F.lit("alert>"))
    noisy = F.concat(F.lit("\x00junk"), F.lit('<?xml version="1.0"?>'), body, F.lit("tail"))
    xml = F.when(F.col("event_type") == "signup", F.concat(F.lit("<alert><identifier>"), F.lit("</alert>"))).when(
        F.col("event_id") % 2 == 0, noisy).otherwise(body)
    return e.select(F.col("event_id").alias("path"), xml.alias("xml"))


ALERT_ROWS = """
  SELECT event_id AS path, i.pos AS info_pos, CAST(event_id AS VARCHAR) AS identifier, 'office' AS sender, i.event, i.severity,
    CASE WHEN event_type = 'view' THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS onset, i.area AS "areaDesc"
  FROM events JOIN (VALUES ('click', 0, 'dust', 'Severe', 'north | south'), ('click', 1, 'heat', 'Severe', 'west'), ('view', 0, '', '', ''),
    ('error', 0, 'wind & rain', 'Severe', 'east'), ('purchase', 0, 'wind & rain', 'Severe', 'east')) i(kind, pos, event, severity, area) ON event_type = i.kind"""


@query(ALERT_ROWS)
def flattened_alerts(spark, sf):
    return al.flatten_alerts(alert_documents(spark, sf)).select("path", "info_pos", "identifier", "sender", "event", "severity", "onset", "areaDesc")


@query("SELECT doc_id, md5('<alert>' || replace(text, '>', '') || '</alert>') AS digest FROM documents")
def xml_cut_from_noise(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    noisy = F.concat(F.lit("\x00\x00head "), F.lit("<alert>"), F.replace("text", F.lit(">"), F.lit("")), F.lit("</alert> pad\x00"))
    return d.select("doc_id", F.md5(clean_xml_text(noisy)).alias("digest"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, md5(text) AS digest FROM documents")
def unpacked_payloads(spark, sf):
    """Texts as payloads, every second one gzip-compressed, unpacked to documents again."""

    @F.pandas_udf("binary")
    def packed(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([gzip.compress(t.encode()) if i % 2 else t.encode() for i, t in zip(ids, texts)])

    d = table(spark, sf, "documents", "doc_id", "text")
    raw = d.select(F.col("doc_id").cast("string").alias("path"), packed("doc_id", "text").alias("content"))
    return al.unpack_archives(raw).select("path", F.md5("xml").alias("digest"))


@query(rounded("""
  SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week_start, avg(value) AS value_mean, max(value) AS value_max, count(*) AS n,
    count(DISTINCT CAST(ts AS DATE)) / 7::DOUBLE AS coverage FROM events GROUP BY 1, 2""", "value_mean coverage"))
def incremental_weekly_ingest(spark, sf):
    """The weekly aggregate kept up to date by a stream over the stored files."""
    stream = spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(sf)
    measures = {"value_mean": ("mean", F.col("value")), "value_max": ("max", F.col("value")), "n": ("count", F.lit(1)), "days": ("days", F.col("ts"))}
    path = scratch_path(spark, "stream")
    inc.ingest(stream.select("user_id", "ts", "value"), "user_id", "ts", measures, path, f"{path}/checkpoint")
    out = inc.current(spark, path, "user_id", {k: kind for k, (kind, _) in measures.items()})
    return tidy(out.withColumn("coverage", F.col("days") / F.lit(7.0)).drop("days"))


@query(rounded("""
  SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week_start, avg(value) AS value_mean, max(value) AS value_max, count(*) AS n FROM events GROUP BY 1, 2""", "value_mean"))
def incremental_ingest_of_late_rows(spark, sf):
    """The same table built by three runs over extracts that share weeks, the latest weeks first, compacted in between."""
    path, rows = scratch_path(spark, "late"), table(spark, sf, "events", "user_id", "ts", "value", "event_id")
    measures = {"value_mean": ("mean", F.col("value")), "value_max": ("max", F.col("value")), "n": ("count", F.lit(1))}
    kinds = {k: kind for k, (kind, _) in measures.items()}
    half = F.when(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"), 0).otherwise(1 + F.col("event_id") % 2)
    for k in range(3):
        rows.where(half == k).drop("event_id").write.mode("append").parquet(f"{path}/extracts")
        stream = spark.readStream.schema("user_id BIGINT, ts TIMESTAMP_NTZ, value DOUBLE").parquet(f"{path}/extracts")
        inc.ingest(stream, "user_id", "ts", measures, f"{path}/table", f"{path}/checkpoint")
        if k == 1:
            inc.compact(spark, f"{path}/table", "user_id", kinds)
    return tidy(inc.current(spark, f"{path}/table", "user_id", kinds))
