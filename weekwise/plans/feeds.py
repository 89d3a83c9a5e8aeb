"""The weekly feeds, from raw rows to one row per entity and week. All entities share one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weekwise.functions.dates import iso_period_to_week, parse_dayfirst
from weekwise.functions.numbers import low_visibility, parse_comma_decimal, parse_eu_number, relative_humidity, to_double
from weekwise.functions.text import alert_level, event_class, keyword_flags, severity_level
from weekwise.operators import aggregate as agg
from weekwise.operators._util import as_list, col
from weekwise.operators.calendar import complete_calendar
from weekwise.operators.clean import clean_sentinels, drop_incomplete, filter_by_flag_or_text, filter_series
from weekwise.operators.dedup import dedup_alerts, dedup_first, pick_by_priority
from weekwise.operators.joins import canonical_entity, nearest_in_day, patch_from_donor
from weekwise.operators.score import quantile_flag, tercile_level
from weekwise.operators.window import detect_gaps

from .domain import AREA_ENTITY, AREA_KEYWORDS, EVENT_KEYWORDS, EVENT_PATTERNS

KEYS = ["entity", "week_start"]


# -- outcome ----------------------------------------------------------------------------------------


def outcome_weekly(
    raw: DataFrame, aliases: DataFrame, place: str = "Islas", period: str = "Periodo", value: str = "Total",
    kind: str = "Tipo de dato", base: str = "Dato base", name: str = "deaths_week",
) -> DataFrame:
    """Outcome counts per entity and week from delimited text rows.

    The base measure type is preferred where an entity has it, the first row of a week is kept, and the
    calendar is completed with ``deaths_missing_week`` marking weeks without a value.
    """
    rows = canonical_entity(raw.where(F.trim(col(place)) != ""), place, aliases).where("entity is not null")
    if kind in raw.columns:
        is_base = F.coalesce(F.trim(col(kind)) == base, F.lit(False))
        has_base = rows.groupBy("entity").agg(F.bool_or(is_base).alias("__has"))
        rows = rows.join(has_base, "entity").where(is_base | ~F.col("__has"))
    weekly = rows.select(
        "entity", iso_period_to_week(col(period)).alias("week_start"), parse_eu_number(col(value)).alias(name),
        col(period).alias("__period"),
    ).where("week_start is not null")
    first = dedup_first(weekly, KEYS, "__period").drop("__period")
    full = complete_calendar(first, "entity")
    return full.withColumn(name.replace("_week", "_missing_week"), F.col(name).isNull().cast("int"))


def outcome_by_parent(
    raw: DataFrame, parents: DataFrame, parent_col: str = "Provincias", place: str = "Islas",
    period: str = "Periodo", value: str = "Total", kind: str = "Tipo de dato", base: str = "Dato base", name: str = "deaths",
) -> DataFrame:
    """Outcome counts of the parent level: rows of the base measure type whose place is blank.

    Two rows of one parent and week contradict the feed's contract and raise an error when the result is read.
    """
    rows = filter_series(raw, place, None)
    if kind in raw.columns:
        rows = rows.where(F.trim(col(kind)) == base)
    weekly = canonical_entity(rows, parent_col, parents, "parent").select(
        "parent", iso_period_to_week(col(period)).alias("week_start"), parse_eu_number(col(value)).alias(name)
    )
    one = weekly.where("parent is not null and week_start is not null").groupBy("parent", "week_start").agg(
        F.count("*").alias("__n"), F.first(name).alias(name)
    )
    twice = F.raise_error(F.concat(F.lit("repeated outcome row: "), F.col("parent"), F.lit(" "), F.col("week_start").cast("string")))
    return one.select("parent", "week_start", F.when(F.col("__n") == 1, F.col(name)).otherwise(twice.cast("double")).alias(name))


# -- weather ----------------------------------------------------------------------------------------

# Fields of a daily station record and their names here.
WEATHER_FIELDS = {
    "tmed": "temp_c", "tmax": "tmax_c", "tmin": "tmin_c", "hrMedia": "humidity", "velmedia": "wind_ms",
    "prec": "prec", "presMax": "pres_max_hpa", "presMin": "pres_min_hpa",
}


def weather_weekly(daily: DataFrame, entity="entity", date: str = "fecha", rule: str = "any_temp") -> DataFrame:
    """Daily station records (text with decimal commas) -> weekly weather with coverage."""
    typed = daily.select(
        *map(col, as_list(entity)), F.to_date(F.try_to_timestamp(col(date).cast("string"))).alias("date"),
        *[(parse_comma_decimal(col(s).cast("string")) if s in daily.columns else F.lit(None).cast("double")).alias(t)
          for s, t in WEATHER_FIELDS.items()],
    ).where("date is not null")
    typed = typed.withColumn("pressure_hpa", (F.col("pres_max_hpa") + F.col("pres_min_hpa")) / 2)
    has = F.col("temp_c").isNotNull()
    if rule == "any_temp":
        has = has | F.col("tmax_c").isNotNull() | F.col("tmin_c").isNotNull()
    return agg.weekly_agg(typed, entity, "date", {
        "n_days": agg.days_seen(has, F.col("date")),
        "temp_c_mean": F.avg("temp_c"), "tmax_c_mean": F.avg("tmax_c"), "tmax_c_max": F.max("tmax_c"),
        "tmin_c_mean": F.avg("tmin_c"), "tmin_c_min": F.min("tmin_c"), "humidity_mean": F.avg("humidity"),
        "pressure_hpa_mean": F.avg("pressure_hpa"), "wind_ms_mean": F.avg("wind_ms"),
        "prec_sum": agg.sum_or_zero("prec"), "coverage": agg.coverage(has, F.col("date"), 7),
    })


def repair_gaps(
    weekly: DataFrame, stations: DataFrame, priority: str = "priority", station: str = "station",
    start=None, end=None, threshold: float = 4 / 7, flag: str = "imputed_from_donor",
) -> DataFrame:
    """Replace the weeks of coverage gaps by those of the preferred fallback station that has data.

    ``stations`` is the weekly table of the fallback stations: entity, week, ``station``, ``priority``
    and the same measures. One plan for all entities, gaps and stations.
    """
    gaps = detect_gaps(weekly, "entity", "coverage", threshold=threshold, start=start, end=end)
    weeks = gaps.select(
        "entity", F.explode(F.sequence("gap_start", "gap_end", F.make_dt_interval(days=F.lit(7)))).alias("week_start")
    )
    wanted = stations.where("n_days > 0").join(weeks, KEYS, "left_semi")
    donor = pick_by_priority(wanted, KEYS, priority).drop(priority)
    values = [c for c in weekly.columns if c not in KEYS]
    return patch_from_donor(weekly, donor.select(*KEYS, station, *[c for c in values if c in donor.columns]),
                            KEYS, flag, F.col(station), append=True)


# -- air quality ------------------------------------------------------------------------------------

# Names of the pollutants in the weekly tables.
POLLUTANTS = ("PM10", "PM2.5", "SO2", "NO2", "O3")


def air_quality_daily(sheets: DataFrame, key: str = "PM10", priority: str = "priority") -> DataFrame:
    """Station sheets -> entity day: daily maxima of the preferred station that has the key pollutant."""
    daily = agg.daily_max(sheets, ["entity", "station", priority], "date", POLLUTANTS, key, "has_data")
    return pick_by_priority(daily.where("has_data"), ["entity", "date"], priority).drop("has_data", priority)


def air_quality_weekly(daily: DataFrame, start=None, end=None) -> DataFrame:
    """Entity day -> entity week; days absent from the daily calendar count as missing."""
    full = complete_calendar(daily, "entity", "date", start=start, end=end, days=1)
    out = agg.weekly_agg(full, "entity", "date", {
        **{c: F.avg(col(c)) for c in POLLUTANTS},
        "days_with_pm10": F.count("PM10"), "days_missing_pm10": agg.n_missing("PM10"),
    })
    return out.withColumn("year", F.year("week_start"))


def gridded_weekly(
    grid: DataFrame, box: tuple[float, float, float, float], entity: str = "entity", time: str = "time",
    names: dict[str, str] | None = None, steps_per_day: int = 4,
) -> DataFrame:
    """Gridded model fields (kg/m3) -> area mean -> daily -> weekly, with high days over the p90."""
    names = names or {"pm10": "PM10", "pm2p5": "PM2.5"}
    area = agg.grid_mean(grid, time, list(names), 1e9, box, [entity]).withColumnsRenamed(names)
    cols = list(names.values())
    daily = agg.daily_agg(area, entity, time, cols, steps_per_day, qs={"p90": 0.9})
    daily = quantile_flag(daily, f"{cols[0]}_mean", 0.9, "high_day", by=entity)
    spec: dict[str, Column] = {f"{c}_{s}": fn(col(f"{c}_{s}")) for c in cols
                               for s, fn in (("mean", F.avg), ("max", F.max), ("min", F.min), ("p90", F.avg))}
    spec |= {"n_obs": F.sum("n_obs"), "days": F.count("*"), "high_days": F.sum("high_day"), "coverage": F.avg("coverage")}
    weekly = agg.weekly_agg(daily, entity, "date", spec)
    return quantile_flag(weekly, f"{cols[0]}_mean", 0.9, "high_week", by=entity)


# -- visibility -------------------------------------------------------------------------------------


def visibility_weekly(observations: DataFrame, station_entity: DataFrame, target_hour: int = 12) -> DataFrame:
    """Station observations -> nearest to the target hour per day -> entity day flags -> weeks."""
    clean = clean_sentinels(observations.where("dt_utc is not null"), "vis_m", "vis_qc", capped_name="vis_capped")
    daily = nearest_in_day(clean, ["station"], "dt_utc", target_hour * 60, 90)
    daily = daily.withColumn("rh_pct", relative_humidity("temp_c", "dewpoint_c"))
    confirmed, possible = low_visibility("vis_m", "rh_pct")
    flagged = daily.withColumns({"confirmed": confirmed, "possible": possible}).join(station_entity, "station")
    days = agg.entity_day_flags(
        flagged, "entity", "station", "date", {"confirmed": "confirmed", "possible": "possible"}, ["vis_m", "rh_pct"]
    )
    weeks = agg.entity_week_flags(days, "entity", "date", ["confirmed", "possible"], ["vis_m", "rh_pct"])
    # fixed values: names of the weekly columns
    stems = {f"{s}_{p}_week": f"low_vis_{s}_{p}_week" for s in ("confirmed", "possible") for p in ("days", "any")}
    return weeks.withColumnsRenamed({
        **stems, "any_days_week": "low_vis_any_days_week", "any_any_week": "low_vis_any_week",
        "vis_m_min_week": "vis_min_m_week", "rh_pct_min_week": "rh_min_pct_week",
    })


# -- alerts -----------------------------------------------------------------------------------------


def classify_alerts(flat: DataFrame, areas: dict[str, Sequence[str]] = AREA_KEYWORDS) -> DataFrame:
    """Flattened alerts -> typed times, event flags, warning level and one flag per area.

    "Santa Cruz de La Palma" is taken out before the bare "santa cruz" is looked for, so that one place
    does not flag two areas.
    """
    texts = ["event", "headline", "description"]
    out = flat.withColumns({
        "onset_dt": F.try_to_timestamp("onset"), "expires_dt": F.try_to_timestamp("expires"),
        **keyword_flags(texts, EVENT_KEYWORDS), "level_score": alert_level("severity", *texts),
    })
    out = out.withColumn("year_onset", F.year("onset_dt"))
    plain = F.regexp_replace(F.lower("areaDesc"), "santa cruz de la palma", " ")
    flags = {f"has_{a}": keyword_flags([plain if a == "tenerife" else F.col("areaDesc")], {a: words})[a]
             for a, words in areas.items()}
    return out.withColumns(flags)


def _weekly_levels(kept: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start and end:
        kept = kept.where(
            (F.col("onset_dt") >= F.lit(start).cast("timestamp"))
            & (F.col("onset_dt") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
        )
    kept = kept.withColumns({
        **event_class(["event", "headline"], EVENT_PATTERNS), "level_score": severity_level("severity"),
    })
    classes = {"cap_heat": "is_heat_event", "cap_dust": "is_dust_event"}
    weekly = agg.alerts_weekly(kept, "entity", "onset_dt", classes).withColumnRenamed("coverage_week", "cap_coverage_week")
    fills = {f"{n}_{s}": 0 for n in classes for s in ("level_max_week", "yellow_plus_week")} | {"cap_coverage_week": 0.0}
    return complete_calendar(weekly.drop("days_with_alerts"), "entity", fills=fills)


def alerts_weekly(
    alerts: DataFrame, area: str, needle: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Alerts of one area -> complete weekly table of the highest dust and heat levels.

    ``area`` is the name of the area or the id of its entity; the result carries the id either way.
    """
    area = {entity: name for name, entity in AREA_ENTITY.items()}.get(area, area)
    kept = filter_by_flag_or_text(dedup_alerts(alerts), f"has_{area}", "areaDesc", needle).where("onset_dt is not null")
    return _weekly_levels(kept.withColumn("entity", F.lit(AREA_ENTITY.get(area, area))), start, end)


def alerts_weekly_by_entity(
    classified: DataFrame, areas: Sequence[str] = tuple(AREA_KEYWORDS), start: str | None = None, end: str | None = None
) -> DataFrame:
    """Classified alerts -> complete weekly table of every entity, from one pass over the alerts.

    An alert that names several areas counts for each of them.
    """
    named = F.array_compact(F.array(*[F.when(F.col(f"has_{a}") == 1, F.lit(AREA_ENTITY.get(a, a))) for a in areas]))
    kept = dedup_alerts(classified).where("onset_dt is not null").withColumn("entity", F.explode(named))
    return _weekly_levels(kept, start, end)


# -- dust events ------------------------------------------------------------------------------------


def dust_weekly(
    events: DataFrame, start_col: str = "Fecha ini", end_col: str = "Fecha fin", intensity: str = "DAI",
    entity=(), start=None, end=None,
) -> DataFrame:
    """Overlapping dust events -> largest intensity per week on a complete calendar, with tercile level."""
    keys = as_list(entity)
    typed = events.select(
        *map(col, keys), parse_dayfirst(col(start_col)).alias("s"), parse_dayfirst(col(end_col)).alias("e"),
        to_double(col(intensity)).alias("dust_dai_week"),
    )
    valid = drop_incomplete(typed, ["s", "e", "dust_dai_week"], "s", "e")
    if not keys:
        valid, keys = valid.withColumn("__all", F.lit(1)), ["__all"]
    weekly = agg.event_intensity_weekly(valid, keys, "s", "e", "dust_dai_week")
    full = complete_calendar(weekly, keys, fills={"dust_dai_week": 0.0}, start=start, end=end)
    # weeks per entity are few, so the built-in percentile is safe
    return tercile_level(full, "dust_dai_week", "dust_level_week", keys, bounded=True).drop("__all")
