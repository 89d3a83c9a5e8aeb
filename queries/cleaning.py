"""Projection, filter and cleaning queries."""

from pyspark.sql import functions as F

from weekwise.functions.numbers import gate, valid_until
from weekwise.operators import clean

from . import query
from .base import FULL, PANEL, full_panel, on, panel, table


@query("SELECT o_orderkey, o_orderdate::DATE AS o_orderdate, o_totalprice FROM orders")
def required_projection(spark, sf):
    df = clean.select_required(table(spark, sf, "orders"), ["o_orderkey", "o_orderdate", "o_totalprice"], "orders")
    return df.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


@query(on(PANEL, "SELECT entity, week_start, outcome AS deaths_week FROM panel"))
def rename_and_drop_helpers(spark, sf):
    df = panel(spark, sf).select("entity", "week_start", "outcome", F.lit(2000).alias("year"), F.lit("x").alias("code"))
    return clean.rename_map(clean.drop_helpers(df), {"outcome": "deaths_week"})


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1997-03-01'")
def clip_to_period(spark, sf):
    return clean.clip_period(table(spark, sf, "orders", "o_orderkey", "o_orderdate"), "o_orderdate", "1996-03-01",
                             "1997-02-28").select("o_orderkey")


@query(on(PANEL, "SELECT entity, week_start, outcome FROM panel WHERE year(week_start) BETWEEN 1997 AND 1999"))
def clip_to_years(spark, sf):
    return clean.clip_years(panel(spark, sf), "week_start", 1997, 1999).select("entity", "week_start", "outcome")


@query("""
  WITH s AS (SELECT * FROM part WHERE trim(p_type) = 'ECONOMY'),
  b AS (SELECT p_brand, bool_or(p_size = 28) AS has FROM s GROUP BY 1)
  SELECT p_partkey, s.p_brand, CAST(p_size AS VARCHAR) AS kind FROM s JOIN b ON s.p_brand = b.p_brand WHERE p_size = 28 OR NOT has""")
def dimension_filter_prefers_base(spark, sf):
    part = table(spark, sf, "part", "p_partkey", "p_brand", "p_type", "p_size").withColumn("kind", F.col("p_size").cast("string"))
    return clean.filter_series(part, "p_type", "ECONOMY", "kind", "28", by="p_brand").select("p_partkey", "p_brand", "kind")


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS k FROM events) WHERE k IS NULL")
def blank_dimension_filter(spark, sf):
    e = table(spark, sf, "events", "event_id", "event_type").withColumn("k", F.when(F.col("event_type") != "view", F.col("event_type")))
    return clean.filter_series(e, "k", None).select("event_id")


@query(on(FULL, "SELECT entity, week_start FROM full_panel WHERE exposure IS NOT NULL AND peak IS NOT NULL"))
def drop_incomplete_rows(spark, sf):
    return clean.drop_incomplete(full_panel(spark, sf), ["exposure", "peak"]).select("entity", "week_start")


@query("""
  WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * 1000 - 5000 AS vis, CAST(l_linenumber + 3 AS INTEGER) AS qc FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE WHEN vis < 0 OR qc = 9 THEN NULL ELSE vis END AS vis,
         coalesce(CASE WHEN vis < 0 OR qc = 9 THEN NULL ELSE vis END IN (9999, 10000), false) AS capped FROM x""")
def sentinel_cleaning(spark, sf):
    x = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 1000 - 5000).alias("vis"), (F.col("l_linenumber") + 3).alias("qc"))
    return clean.clean_sentinels(x, "vis", "qc", capped_name="capped").drop("qc")


@query(on(PANEL, "SELECT entity, week_start, exposure AS picked FROM panel"))
def first_existing_column(spark, sf):
    df = panel(spark, sf)
    name = clean.first_column(df, ["temp_mean", "exposure", "peak"])
    return df.select("entity", "week_start", F.col(name).alias("picked"))


@query("SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'tion')")
def text_fallback_filter(spark, sf):
    """The flag is constant, so the filter falls back to the accent-free text."""
    d = table(spark, sf, "documents", "doc_id", "text").withColumn("has_area", F.lit(1))
    return clean.filter_by_flag_or_text(d, "has_area", "text", "tion").select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'fr'")
def flag_filter(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text", "lang").withColumn("has_area", (F.col("lang") == "fr").cast("int"))
    return clean.filter_by_flag_or_text(d, "has_area", "text", "tion").select("doc_id")


@query("SELECT l_orderkey, l_linenumber, CAST(coalesce(l_tax > l_discount, false) AS INTEGER) AS implausible FROM lineitem")
def implausible_pairs(spark, sf):
    x = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_tax", "l_discount")
    return clean.flag_implausible(x, F.col("l_tax") > F.col("l_discount")).drop("l_tax", "l_discount")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' ELSE event_type END AS event_type FROM events")
def unified_spelling(spark, sf):
    return clean.unify_spelling(table(spark, sf, "events", "event_id", "event_type"), "event_type", {"click": "tap", "view": "look"})


@query(on(PANEL, "SELECT entity, week_start, CASE WHEN outcome >= 2 AND share < 1 THEN exposure END AS exposure FROM panel"))
def quality_gate(spark, sf):
    cond = (F.col("outcome") >= 2) & (F.col("share") < 1)
    return panel(spark, sf).select("entity", "week_start", gate("exposure", cond).alias("exposure"))


@query(on(FULL, """
  SELECT entity, week_start, CASE WHEN week_start <= DATE '2000-03-18' THEN coalesce(CASE WHEN peak > 400 THEN 'red' END, 'blue') END AS label
  FROM full_panel"""))
def validity_horizon(spark, sf):
    df = full_panel(spark, sf).withColumn("raw", F.when(F.col("peak") > 400, "red"))
    return df.select("entity", "week_start", valid_until("raw", "week_start", "2000-03-18", "blue").alias("label"))
