"""Parsers and scalar functions on literal edge cases."""

import datetime as dt
import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from weekwise.functions import dates, numbers, text

D = dt.date


def test_iso_period(one):
    got = one(["2020SM53", "2021SM53", "2025SM52", "2016SM01", "2020SM00", "20SM5", "x", None, " 2020SM10 "],
              dates.iso_period_to_week("x"))
    assert got == [D(2020, 12, 28), None, D(2025, 12, 22), D(2016, 1, 4), None, None, None, None, D(2020, 3, 2)]


def test_european_numbers(one):
    assert one(["1.234", "1.234,5", "", " ", None, "7", "abc", "NaN"], numbers.parse_eu_number("x")) == [
        1234.0, 1234.5, None, None, None, 7.0, None, None]


def test_comma_decimals(one):
    assert one(["12,3", '"4,5"', "Ip", "", "nan", "None", "-1,0", None], numbers.parse_comma_decimal("x")) == [
        12.3, 4.5, None, None, None, None, -1.0, None]


def test_mixed_dates(one):
    got = one(["42370", "31/12/2016", "2016-12-31", "2016-12-31 10:30:00", "1/2/2017 09:00", "junk", "19999", "2016", "", None, "42370.75"],
              dates.parse_mixed_date("x"))
    assert got == [D(2016, 1, 1), D(2016, 12, 31), D(2016, 12, 31), D(2016, 12, 31), D(2017, 2, 1), None, None, None, None, None,
                   D(2016, 1, 1)]


def test_dayfirst(one):
    assert one(["05/03/2020", "5/3/2020", "2020-03-05", "32/01/2020"], dates.parse_dayfirst("x")) == [
        D(2020, 3, 5), D(2020, 3, 5), None, None]


def test_hour_labels(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 24), ("b", 5), ("c", 0)], "k string, h int").withColumn(
        "d", F.lit("2020-01-01").cast("date"))
    plain = {(r.k, r.h): r.t for r in df.select("k", "h", dates.date_hour_to_ts("d", "h").alias("t")).collect()}
    assert plain[("a", 1)].hour == 0 and plain[("b", 24)].hour == 23 and plain[("c", 0)] is None
    ok = df.groupBy("k").agg(dates.one_based_hours("h").alias("ok"))
    old = {(r.k, r.h): r.t for r in df.join(ok, "k").select("k", "h", dates.date_hour_to_ts("d", "h", F.col("ok")).alias("t")).collect()}
    # a series with an hour 24 stays unshifted in the historical order
    assert old[("a", 5)].hour == 4 and old[("b", 5)].hour == 5 and old[("b", 24)].hour == 0


def test_epoch(one):
    assert one(["0", "1500", "x"], F.unix_millis(dates.epoch_to_ts("x", "ms"))) == [0, 1500, None]
    assert one(["86400"], F.unix_seconds(dates.epoch_to_ts("x", "s"))) == [86400]


def test_analysis_window(spark):
    lo, hi = spark.range(1).select(*dates.analysis_window(2016, 2025)).first()
    assert (lo, hi) == (D(2015, 12, 28), D(2025, 12, 29))


def test_accents(one):
    words = ["Güímar", "Ñandú", "ÁÉÍÓÚ", "İşğ", "plain", "é"]
    want = ["".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)) for w in words]
    assert one(words, text.strip_accents("x")) == want


def test_names_and_slug(one):
    assert one([" Santa  Cruz-Sur ", "Tío Pino"], text.normalize_name("x")) == ["santa cruz sur", "tio pino"]
    assert one([" La Palma "], text.slug("x")) == ["la_palma"]


def test_levels(one):
    assert one(["extreme", " Severe", "moderate", "MINOR", "?", None], text.severity_level("x")) == [4, 3, 2, 1, 0, 0]
    texts = ["aviso amarillo", "Aviso ROJO y verde", "red alert", "bored", "orange", "", None]
    assert one(texts, text.colour_level("x")) == [2, 4, 4, 0, 3, 0, 0]
    assert one([""], text.alert_level("x", F.lit("aviso amarillo"))) == [2]


def test_xml_cut(one):
    got = one(["junk<?xml v?><alert>a</alert>pad", "xx<ALERT>b</ALERT>", "<alert>open", "none", None,
               "<alert>1</alert><alert>2</alert>\x00"], text.clean_xml_text("x"))
    assert got == ["<?xml v?><alert>a</alert>", "<ALERT>b</ALERT>", None, None, None, "<alert>1</alert><alert>2</alert>"]


def test_bytes(one):
    got = one([bytearray("ñ€".encode()), bytearray("ñ".encode("latin-1"))], text.decode_bytes("x"), "binary")
    assert got == ["ñ€", "ñ"]


def test_cut_and_level(one):
    assert one([-1.0, 0.0, 1.0, 2.0, 7.0, 8.0, None], numbers.cut_right("x", [-1, 0, 1, 3, 7], [0, 1, 2, 3]), "double") == [
        None, 0, 1, 2, 3, None, None]
    assert one([0.0, 0.25, 0.5, 0.74, 0.75, None], numbers.score_to_level("x"), "double") == [
        "none", "possible", "probable", "probable", "intense", None]
    assert one(["probable", "other", None], numbers.ordinal("x")) == [2, None, None]


def test_low_visibility(spark):
    rows = [(9998.0, None), (9999.0, None), (9999.0, 69.9), (10000.0, 70.0), (19999.0, 60.0), (20000.0, 10.0), (None, 29.9), (None, 30.0), (None, None)]
    df = spark.createDataFrame(rows, "v double, h double").coalesce(1)
    c, p = numbers.low_visibility("v", "h")
    got = [tuple(r) for r in df.select(c, p).collect()]
    assert got == [(1, 0), (0, 0), (1, 0), (0, 0), (1, 0), (0, 0), (0, 1), (0, 0), (0, 0)]


def test_humidity(one):
    want = 100 * math.exp(17.625 * 10 / 253.04) / math.exp(17.625 * 20 / 263.04)
    assert one([20.0], numbers.relative_humidity("x", F.lit(10.0)), "double")[0] == pytest.approx(want)


def test_nan_is_missing(one):
    assert one([1.0, float("nan"), None], numbers.null_if_nan("x"), "double") == [1.0, None, None]
    assert one([float("nan"), 2.0, None], numbers.flag(numbers.null_if_nan("x") >= 1), "double") == [0, 1, 0]


def test_valid_until(spark):
    df = spark.createDataFrame([(D(2022, 3, 14), "a"), (D(2022, 3, 14), None), (D(2022, 3, 21), "a")], "w date, l string").coalesce(1)
    assert [r[0] for r in df.select(numbers.valid_until("l", "w", "2022-03-18", "blue")).collect()] == ["a", "blue", None]


def test_decode_latin_9(one):
    raw = bytes([0xA4, 0xA6, 0xA8, 0xB4, 0xB8, 0xBC, 0xBD, 0xBE, 0xE9])
    assert one([bytearray(raw)], text.decode_bytes("x"), "binary") == [raw.decode("iso-8859-15")]
