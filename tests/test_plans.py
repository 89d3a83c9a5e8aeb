"""Whole jobs on literal feeds: from raw rows to master, score, parents, region and reports."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekwise.operators import aggregate
from weekwise.plans import analysis, domain, feeds, master

D = dt.date


@pytest.fixture(scope="module")
def entities(spark):
    return domain.entity_table(spark)


def test_outcome_feed(spark):
    rows = [
        ("P", " Tenerife ", "Dato base", "2020SM52", "1.234"), ("P", "Tenerife", "Dato base", "2021SM01", "7,5"),
        ("P", "Tenerife", "Tasa", "2020SM52", "99"), ("P", "Tenerife", "Dato base", "2021SM53", "5"),
        ("P", "Palma, La", "Tasa", "2021SM02", ""), ("P", "Atlantis", "Dato base", "2021SM02", "1"), ("P", None, "Dato base", "2021SM02", "1"),
    ]
    raw = spark.createDataFrame(rows, ["Provincias", "Islas", "Tipo de dato", "Periodo", "Total"])
    got = {(r.entity, r.week_start): (r.deaths_week, r.deaths_missing_week) for r in feeds.outcome_weekly(raw, domain.alias_table(spark)).collect()}
    assert got == {
        ("tenerife", D(2020, 12, 21)): (1234.0, 0), ("tenerife", D(2020, 12, 28)): (None, 1), ("tenerife", D(2021, 1, 4)): (7.5, 0),
        ("la_palma", D(2021, 1, 11)): (None, 1)}


def test_outcome_by_parent(spark):
    rows = [("38 Santa Cruz", None, "2020SM52", "1.000"), ("38 Santa Cruz", "x", "2020SM52", "5")]
    raw = spark.createDataFrame(rows, "Provincias string, Islas string, Periodo string, Total string")
    names = spark.createDataFrame([("38 santa cruz", "sc_tenerife")], "alias string, canonical string")
    assert [tuple(r) for r in feeds.outcome_by_parent(raw, names).collect()] == [("sc_tenerife", D(2020, 12, 21), 1000.0)]


def test_outcome_by_parent_keeps_counts_only(spark):
    schema = "Provincias string, Islas string, `Tipo de dato` string, Periodo string, Total string"
    rows = [("38 Santa Cruz", None, "Dato base", "2020SM52", "7"), ("38 Santa Cruz", None, "Tasa", "2020SM52", "9,5")]
    names = spark.createDataFrame([("38 santa cruz", "sc_tenerife")], "alias string, canonical string")
    assert [tuple(r) for r in feeds.outcome_by_parent(spark.createDataFrame(rows, schema), names).collect()] == [("sc_tenerife", D(2020, 12, 21), 7.0)]
    with pytest.raises(Exception, match="repeated outcome row"):
        feeds.outcome_by_parent(spark.createDataFrame(rows[:1] * 2, schema), names).collect()


def weather_rows(spark, entity="tenerife", days=range(0, 21), **gap):
    rows = [(entity, str(D(2020, 1, 6) + dt.timedelta(days=i)), "20,5", "25,0", "15,0", "60", "Ip" if i < 7 else "1,5", "1015,0", "1005,0") for i in days]
    return spark.createDataFrame(rows, ["entity", "fecha", "tmed", "tmax", "tmin", "hrMedia", "prec", "presMax", "presMin"])


def test_weather_and_gap_repair(spark):
    weekly = feeds.weather_weekly(weather_rows(spark, days=[*range(0, 7), *range(14, 16), *range(21, 28)]))
    got = {r.week_start: r for r in weekly.collect()}
    assert got[D(2020, 1, 6)].prec_sum == 0.0 and got[D(2020, 1, 6)].pressure_hpa_mean == 1010.0
    assert got[D(2020, 1, 20)].coverage == pytest.approx(2 / 7) and D(2020, 1, 13) not in got
    donors = feeds.weather_weekly(
        weather_rows(spark, days=range(0, 28)).withColumns({"station": F.lit("S1"), "priority": F.lit(1)})
        .unionByName(weather_rows(spark, days=range(7, 14)).withColumns({"station": F.lit("S0"), "priority": F.lit(0)})),
        ["entity", "station", "priority"])
    fixed = {r.week_start: r for r in feeds.repair_gaps(weekly, donors).collect()}
    assert {w: (r.imputed_from_donor, r.donor_station, r.n_days) for w, r in fixed.items()} == {
        D(2020, 1, 6): (0, None, 7), D(2020, 1, 13): (1, "S0", 7), D(2020, 1, 20): (1, "S1", 7), D(2020, 1, 27): (0, None, 7)}


def test_air_quality(spark):
    day = D(2020, 1, 6)
    rows = [("tenerife", "A", 0, day, None, 1.0), ("tenerife", "B", 1, day, 40.0, 2.0), ("tenerife", "B", 1, day, 60.0, None),
            ("tenerife", "A", 0, D(2020, 1, 8), 10.0, None)]
    sheets = spark.createDataFrame(rows, "entity string, station string, priority int, date date, PM10 double, `PM2.5` double").withColumns(
        {c: F.lit(None).cast("double") for c in ("SO2", "NO2", "O3")})
    daily = feeds.air_quality_daily(sheets)
    assert {r.date: (r.station, r.PM10) for r in daily.collect()} == {day: ("B", 60.0), D(2020, 1, 8): ("A", 10.0)}
    week = feeds.air_quality_weekly(daily).first()
    assert (week.PM10, week.days_with_pm10, week.days_missing_pm10, week["PM2.5"]) == (35.0, 2, 1, 2.0)


def test_gridded(spark):
    rows = [("e", dt.datetime(2020, 1, 6, h), lat, 1.0, 1e-8 * (h + 1) * lat, 1e-8) for h in (0, 6, 12, 18) for lat in (1.0, 3.0, 50.0)]
    rows += [rows[0]]  # a repeated time step
    grid = spark.createDataFrame(rows, "entity string, time timestamp, latitude double, longitude double, pm10 double, pm2p5 double")
    row = feeds.gridded_weekly(grid, (0, 0, 10, 10)).first()
    assert row.PM10_mean == pytest.approx(20 * np.mean([1, 7, 13, 19])) and row.n_obs == 4 and row.coverage == 1.0


def test_visibility(spark):
    t = lambda d, h, m=0: dt.datetime(2020, 1, d, h, m)
    rows = [("S", t(6, 12), 9998.0, 20.0, 19.0, 1.0), ("S", t(6, 11, 30), 20000.0, 20.0, 19.0, 1.0), ("S", t(7, 12), 5000.0, 20.0, 19.0, 9.0),
            ("T", t(7, 12), None, 30.0, 0.0, 1.0), ("S", t(8, 10, 29), 10.0, 20.0, 19.0, 1.0)]
    obs = spark.createDataFrame(rows, "station string, dt_utc timestamp, vis_m double, temp_c double, dewpoint_c double, vis_qc double")
    places = spark.createDataFrame([("S", "e"), ("T", "e")], "station string, entity string")
    row = feeds.visibility_weekly(obs, places).first()
    assert (row.low_vis_confirmed_days_week, row.low_vis_possible_days_week, row.low_vis_any_days_week, row.vis_min_m_week) == (1, 1, 2, 9998.0)


def test_alert_feed(spark):
    fields = ["chunk_key", "path", "info_pos", "identifier", "event", "headline", "description", "severity", "onset", "expires", "areaDesc"]
    rows = [
        ("k", "p1", 0, "1", "polvo en suspensión", "aviso amarillo", "", "", "2020-02-24T06:00:00", "", "Tenerife"),
        ("k", "p2", 0, "1", "polvo", "", "", "Severe", "2020-02-25T06:00:00", "", "Tenerife"),
        ("k", "p1", 0, "2", "temperaturas máximas", "", "", "Moderate", "2020-03-09T06:00:00", "", "Tenerife"),
        ("k", "p1", 0, "3", "polvo", "", "", "Extreme", "2020-02-24T06:00:00", "", "Santa Cruz de La Palma"),
        ("k", "p1", 0, "4", "polvo", "", "", "Extreme", "", "", "Tenerife"),
    ]
    alerts = feeds.classify_alerts(spark.createDataFrame(rows, fields))
    flags = {r.identifier: (r.has_tenerife, r.has_la_palma, r.level_score, r.is_dust_event) for r in alerts.where("path = 'p1'").collect()}
    assert flags["1"] == (1, 0, 2, 1) and flags["3"] == (0, 1, 4, 0)
    weekly = {r.week_start: r for r in feeds.alerts_weekly(alerts, "tenerife", "tenerife").collect()}
    assert sorted(weekly) == [D(2020, 2, 24), D(2020, 3, 2), D(2020, 3, 9)]
    assert weekly[D(2020, 2, 24)].cap_dust_level_max_week == 3 and weekly[D(2020, 2, 24)].cap_coverage_week == pytest.approx(1 / 7)
    assert weekly[D(2020, 3, 2)].cap_coverage_week == 0.0 and weekly[D(2020, 3, 9)].cap_heat_yellow_plus_week == 1


def test_alert_feed_of_all_entities(spark):
    fields = ["chunk_key", "path", "info_pos", "identifier", "event", "headline", "description", "severity", "onset", "expires", "areaDesc"]
    rows = [("k", "p", 0, "1", "polvo", "", "", "Severe", "2020-02-24T06:00:00", "", "La Gomera | El Hierro"),
            ("k", "p", 0, "2", "temperaturas", "", "", "Moderate", "2020-02-25T06:00:00", "", "El Hierro"),
            ("k", "p", 0, "3", "polvo", "", "", "Minor", "2020-02-26T06:00:00", "", "nowhere")]
    alerts = feeds.classify_alerts(spark.createDataFrame(rows, fields))
    got = {r.entity: (r.cap_dust_level_max_week, r.cap_heat_level_max_week) for r in feeds.alerts_weekly_by_entity(alerts).collect()}
    assert got == {"gomera": (3, 0), "hierro": (3, 2)}
    for area in ("gomera", "la_gomera"):
        rows = feeds.alerts_weekly(alerts, area, "gomera").collect()
        assert [(r.entity, r.cap_dust_level_max_week) for r in rows] == [("gomera", 3)]


def test_dust_events(spark):
    rows = [("30/12/2019", "02/01/2020", "1"), ("01/01/2020", "01/01/2020", "5"), ("20/01/2020", "19/01/2020", "9"), ("27/01/2020", "27/01/2020", "3")]
    out = feeds.dust_weekly(spark.createDataFrame(rows, ["Fecha ini", "Fecha fin", "DAI"])).orderBy("week_start")
    assert [(r.week_start, r.dust_dai_week, r.dust_level_week) for r in out.collect()] == [
        (D(2019, 12, 30), 5.0, 3), (D(2020, 1, 6), 0.0, 0), (D(2020, 1, 13), 0.0, 0), (D(2020, 1, 20), 0.0, 0), (D(2020, 1, 27), 3.0, 1)]


@pytest.fixture(scope="module")
def study(spark, entities):
    """Three years of synthetic weekly feeds of every entity, with gaps."""
    rng = np.random.default_rng(4)
    mondays = [D(2019, 12, 30) + dt.timedelta(days=7 * i) for i in range(157)]
    names = [e[0] for e in domain.ENTITIES]

    def feed(make, ddl, keep=1.0):
        rows = [(e, w, *make(i)) for e in names for i, w in enumerate(mondays) if rng.random() < keep]
        return spark.createDataFrame(rows, f"entity string, week_start date, {ddl}")

    outcome = feed(lambda i: (float(rng.poisson(30)),), "deaths_week double")
    weather = feed(lambda i: (20.0 + rng.normal(), 25 + rng.normal(), 30 + rng.normal(), 15.0, 60 + 10 * rng.normal(), 1010 + rng.normal(), 5.0, 0.0),
                   "temp_c_mean double, tmax_c_mean double, tmax_c_max double, tmin_c_mean double, humidity_mean double, pressure_hpa_mean double, wind_ms_mean double, prec_sum double", 0.95)
    air = feed(lambda i: (float(rng.gamma(2, 25)), float(rng.gamma(2, 8))), "PM10 double, `PM2.5` double", 0.9)
    vis = feed(lambda i: (int(rng.random() < 0.3), int(rng.random() < 0.4)), "low_vis_confirmed_any_week int, low_vis_any_week int", 0.9)
    dust = feed(lambda i: (int(rng.integers(0, 4)),), "dust_level_week int", 0.9)
    panel = master.master_panel(outcome, [weather, air, vis, dust], entities, "2019-12-30", "2022-12-26")
    return panel.cache()


def test_master_and_score(study):
    assert study.count() == 7 * 157
    scores = master.dust_score(study)
    rows = scores.collect()
    assert len(rows) == 7 * 157 and all(0 <= r.score <= 1 and r.level in ("none", "possible", "probable", "intense") for r in rows)
    assert len({r.level for r in rows}) == 4
    percentile = master.percentile_score(study).collect()
    assert len(percentile) == 7 * 157 and max(r.score for r in percentile) <= 4.5


def test_score_rules_by_hand(spark):
    ddl = "entity string, week_start date, tmax_c_max double, PM10 double, `PM2.5` double, low_vis_confirmed_any_week int, humidity_mean double, dust_level_week int"
    day = lambda i: D(2020, 1, 6) + dt.timedelta(days=7 * i)
    rows = [("e", day(0), 20.0, 100.0, 20.0, 1, 60.0, 2), ("e", day(1), 20.0, 50.0, 0.0, 0, 61.0, 0), ("e", day(2), 22.0, None, 0.0, 0, 99.0, None)]
    got = [(r.score, r.level) for r in master.dust_score(spark.createDataFrame(rows, ddl)).orderBy("week_start").collect()]
    # month mean of quiet weeks = 21, deviation = sqrt(2): anomalies -0.71, -0.71, +0.71; a trailing gap takes the last value
    assert got == [((2 + 0.75 + 0.5 + 0.25) / 4, "intense"), (0.25, "possible"), ((1 + 0.5) / 4, "possible")]


def test_parents_and_region(spark, study, entities):
    scores = master.dust_score(study)
    outcome = study.join(entities.select("entity", "parent"), "entity").groupBy("parent", "week_start").agg(F.sum("deaths_week").alias("deaths"))
    parents = master.parent_panel(scores, entities, outcome)
    totals = {r.parent: r.population for r in parents.select("parent", "population").distinct().collect()}
    assert totals == {"sc_tenerife": 1_032_000, "las_palmas": 1_123_000}
    region = master.region_panel(parents)
    row = region.orderBy("week_start").first()
    assert region.count() == 157 and row.population == 2_155_000
    assert row.deaths_per_100k == pytest.approx(row.deaths / 2_155_000 * 1e5)


def test_reports(study):
    scores = master.dust_score(study)
    panel = study.join(scores, ["entity", "week_start"])
    tables = analysis.exposure_outcome_report(panel)
    sizes = {name: df.count() for name, df in tables.items()}
    assert sizes["outcome_by_level"] == 4 and sizes["anova"] == 7 and sizes["lags"] == 35 and sizes["pairwise"] == 21
    rows = master.regression_table(study, scores, ["tenerife", "gran_canaria"])
    reg = analysis.regression_report(rows)
    comparison = reg["comparison"].collect()
    assert {(r.entity, r.model) for r in comparison} == {(e, m) for e in ("tenerife", "gran_canaria") for m in ("M1", "M3")}
    assert all(1 < r.dw < 3 for r in comparison)
    assert reg["coefficients"].count() == 14 and reg["vif"].count() == 10
    audit = analysis.master_audit(study)
    assert audit["structure"].count() == 7 and audit["missing"].where("missing > 0").count() > 0


def test_days_and_hours_are_counted_in_one_shuffle(spark):
    D = dt.datetime
    rows = [("a", D(2024, 1, 1, 0), 1.0), ("a", D(2024, 1, 1, 23), 2.0), ("a", D(2024, 1, 7, 5), 3.0), ("a", D(2024, 1, 3, 5), None), ("b", D(2024, 1, 2, 1), None), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "e string, ts timestamp_ntz, v double")
    daily = aggregate.daily_agg(df.where("ts is not null"), "e", "ts", ["v"], 24)
    weekly = aggregate.weekly_agg(df, "e", "ts", {"d": aggregate.days_seen(F.col("v").isNotNull(), F.col("ts")), "c": aggregate.coverage(F.col("v").isNotNull(), F.col("ts"))})
    for out in (daily, weekly):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Expand" not in plan
    hours = {(r.e, r.date.day): r.hours_with_data for r in daily.collect()}
    assert hours == {("a", 1): 2, ("a", 7): 1, ("a", 3): 0, ("b", 2): 0}
    got = {(r.e, r.week_start): (r.d, r.c) for r in weekly.collect()}
    monday = dt.date(2024, 1, 1)
    assert got == {("a", monday): (2, 2 / 7), ("b", monday): (0, 0.0), ("a", None): (0, 0.0)}
