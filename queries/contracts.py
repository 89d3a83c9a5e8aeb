"""Cases that feeds must not get wrong: ties with missing values, measure types, encodings, areas, nested archives, key contracts."""

import gzip
import io
import tarfile

import pyarrow as pa
from pyspark.sql import functions as F

from weekwise.functions import text
from weekwise.functions.dates import iso_year
from weekwise.operators import dedup
from weekwise.plans import feeds, master
from weekwise.sources import alerts as al

from . import query
from .base import PANEL, on, panel, rounded, table, tidy
from .panels import SHIPPED, shipped


@query("""
  WITH x AS (SELECT l_orderkey, l_returnflag, CASE WHEN l_linenumber % 2 = 1 THEN NULL ELSE l_extendedprice END AS price FROM lineitem)
  SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, CAST(price IS NULL AS INTEGER), price) = 1""")
def first_row_with_missing_values(spark, sf):
    """Equal order values: the row with a value wins over the one without."""
    x = table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber", "l_extendedprice")
    rows = x.select("l_orderkey", "l_returnflag", F.when(F.col("l_linenumber") % 2 != 1, F.col("l_extendedprice")).alias("price"))
    return dedup.dedup_first(rows, "l_orderkey", "l_returnflag")


@query("""
  SELECT lower(r_name) AS parent, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, count(*) * 1000 + 0.5::DOUBLE AS deaths
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def outcome_feed_of_parents(spark, sf):
    """Counts beside larger rates of the same parent and week: only the counts are taken."""
    orders, customer = table(spark, sf, "orders", "o_custkey", "o_orderdate"), table(spark, sf, "customer", "c_custkey", "c_nationkey")
    nation, region = table(spark, sf, "nation", "n_nationkey", "n_regionkey"), spark.read.schema("r_regionkey INT, r_name STRING").parquet(f"{sf}/region.parquet")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    d = F.col("o_orderdate").cast("date")
    weekly = rows.groupBy("n_regionkey", iso_year(d).alias("y"), F.weekofyear(d).alias("w")).agg(F.count("*").alias("c"))
    raw = weekly.join(region, weekly.n_regionkey == region.r_regionkey).select(
        F.concat(F.lit("0 "), "r_name").alias("Provincias"), F.lit(None).cast("string").alias("Islas"), F.lit("Dato base").alias("Tipo de dato"),
        F.concat(F.col("y").cast("string"), F.lit("SM"), F.lpad(F.col("w").cast("string"), 2, "0")).alias("Periodo"),
        F.translate(F.format_number(F.col("c") * 1000 + 0.5, 1), ",.", ".,").alias("Total"))
    rates = raw.withColumns({"Tipo de dato": F.lit("Tasa"), "Total": F.lit("99.999.999")})
    islands = raw.withColumns({"Islas": F.lit("x"), "Total": F.lit("5")})
    names = region.select(F.concat(F.lit("0 "), "r_name").alias("alias"), F.lower("r_name").alias("canonical"))
    return feeds.outcome_by_parent(raw.unionByName(rates).unionByName(islands), names)


@query("SELECT doc_id, md5('€ Šš ' || regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') || 'é') AS digest FROM documents")
def latin_9_bytes(spark, sf):
    """Bytes that are no UTF-8 and use code points in which ISO-8859-15 differs from ISO-8859-1."""
    d = table(spark, sf, "documents", "doc_id", "text")
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    raw = F.concat(F.unhex(F.lit("A420A6A820")), F.encode(plain, "UTF-8"), F.unhex(F.lit("E9")))
    return d.select("doc_id", F.md5(text.decode_bytes(raw)).alias("digest"))


AREAS = ("La Gomera", "El Hierro | Tenerife", "Santa Cruz de La Palma", "Lanzarote", "nowhere")


@query(rounded("""
  WITH a AS (SELECT event_id, ts, unnest(CASE user_id % 5 WHEN 0 THEN ['gomera'] WHEN 1 THEN ['hierro', 'tenerife'] WHEN 2 THEN ['la_palma'] WHEN 3 THEN ['lanzarote'] ELSE [] END) AS entity,
      CAST(event_type = 'error' AS INTEGER) AS dust, CAST(event_type = 'purchase' AS INTEGER) AS heat,
      CASE WHEN value >= 120 THEN 4 WHEN value >= 80 THEN 3 WHEN value >= 40 THEN 2 ELSE 1 END AS lv FROM events),
  w AS (SELECT entity, CAST(date_trunc('week', ts) AS DATE) AS week_start, coalesce(max(lv) FILTER (WHERE heat = 1), 0) AS h, coalesce(max(lv) FILTER (WHERE dust = 1), 0) AS d,
      count(DISTINCT CAST(ts AS DATE)) / 7::DOUBLE AS c FROM a GROUP BY 1, 2),
  b AS (SELECT entity, min(week_start) AS lo, max(week_start) AS hi FROM w GROUP BY 1),
  s AS (SELECT entity, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_start FROM b)
  SELECT s.entity, s.week_start, coalesce(h, 0) AS cap_heat_level_max_week, coalesce(d, 0) AS cap_dust_level_max_week, CAST(coalesce(h, 0) >= 2 AS INTEGER) AS cap_heat_yellow_plus_week,
    CAST(coalesce(d, 0) >= 2 AS INTEGER) AS cap_dust_yellow_plus_week, coalesce(c, 0) AS cap_coverage_week
  FROM s LEFT JOIN w ON s.entity = w.entity AND s.week_start = w.week_start""", "cap_coverage_week"))
def alert_feed_by_entity(spark, sf):
    """All areas in one pass; areas whose name is not their entity's id arrive under the id."""
    e = table(spark, sf, "events", "event_id", "user_id", "ts", "event_type", "value")
    v = F.col("value")
    flat = e.select(
        F.lit("k").alias("chunk_key"), F.lit("p").alias("path"), F.lit(0).alias("info_pos"), F.col("event_id").cast("string").alias("identifier"),
        F.when(F.col("event_type") == "error", "polvo").when(F.col("event_type") == "purchase", "temperaturas").otherwise("x").alias("event"),
        F.lit("").alias("headline"), F.lit("").alias("description"),
        F.when(v >= 120, "Extreme").when(v >= 80, "Severe").when(v >= 40, "Moderate").otherwise("Minor").alias("severity"),
        F.col("ts").cast("string").alias("onset"), F.lit("").alias("expires"),
        F.element_at(F.array(*map(F.lit, AREAS)), (F.col("user_id") % 5 + 1).cast("int")).alias("areaDesc"))
    return tidy(feeds.alerts_weekly_by_entity(feeds.classify_alerts(flat)))


def packer(limit: int = 4 << 20):
    """Batches of (path, text) -> (path, content): the text in tar in gzip in tar in gzip in tar. Archives leave in batches of about ``limit``
    bytes, so that a task never holds those of a whole batch of rows."""

    def tar(**members: bytes) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as archive:
            for name, data in members.items():
                info = tarfile.TarInfo(name.replace("_", "."))
                info.size = len(data)
                archive.addfile(info, io.BytesIO(data))
        return out.getvalue()

    def run(batches):
        paths, contents, size = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                t = batch.column(1)[i].as_py().encode()
                paths.append(batch.column(0)[i].as_py())
                contents.append(tar(inner_tgz=gzip.compress(tar(deep_tgz=gzip.compress(tar(t_xml=t), 1)), 1), plain_xml=t))
                size += len(contents[-1])
                if size >= limit:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                    paths, contents, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    return run


@query("SELECT CAST(doc_id AS VARCHAR) AS path, member, md5(text) AS digest FROM documents, (VALUES ('inner.tgz::deep.tgz::t.xml'), ('plain.xml')) AS m(member)")
def nested_archives(spark, sf):
    """Texts inside tar inside gzip inside tar inside gzip inside tar, unpacked to documents."""
    d = table(spark, sf, "documents", "doc_id", "text")
    raw = d.select(F.col("doc_id").cast("string").alias("path"), "text").mapInArrow(packer(), "path string, content binary")
    return al.unpack_archives(raw).where("error is null").select("path", "member", F.md5("xml").alias("digest"))


@query(on(PANEL + "," + SHIPPED, """
  , e AS (SELECT n_nationkey AS entity, upper(substr(n_name, 1, 3)) AS entity_code FROM nation),
  c AS (SELECT entity, entity_code, CAST(unnest(generate_series(DATE '1996-12-30', DATE '1998-12-28', INTERVAL 7 DAY)) AS DATE) AS week_start FROM e)
  SELECT c.entity, c.entity_code, c.week_start, CAST(year(c.week_start) AS INTEGER) AS year, outcome, n_lines
  FROM c LEFT JOIN (SELECT * FROM panel WHERE entity <> 3) p ON c.entity = p.entity AND c.week_start = p.week_start LEFT JOIN shipped s ON c.entity = s.entity AND c.week_start = s.week_start"""))
def master_contract(spark, sf):
    """Every week of every known entity, also of one without outcome rows; repeated keys in a feed or missing weeks are errors."""
    nation = table(spark, sf, "nation", "n_nationkey", "n_name")
    entities = nation.select(F.col("n_nationkey").alias("entity"), F.upper(F.substring("n_name", 1, 3)).alias("code"))
    outcome = panel(spark, sf).where("entity <> 3").select("entity", "week_start", "outcome")
    lines = shipped(spark, sf).select("entity", "week_start", "n_lines")
    out = master.master_panel(outcome, [lines], entities, "1996-12-30", "1998-12-28")
    master.assert_master(out, "1996-12-30", "1998-12-28")
    try:
        master.master_panel(outcome, [lines.unionByName(lines.limit(1))], entities, "1996-12-30", "1998-12-28")
    except ValueError:
        return out
    raise AssertionError("a repeated key went unnoticed")
