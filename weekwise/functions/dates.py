"""Calendar and date-parsing expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str

# Fixed value: day 0 of spreadsheet serial dates, and the smallest serial taken as a date.
SERIAL_EPOCH = "1899-12-30"
SERIAL_MIN = 20000


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def week_start(c: ColumnOrName) -> Column:
    """Monday (DATE) of the week that contains a date or timestamp; whole-day arithmetic only."""
    day = F.to_date(_col(c))
    return F.date_sub(day, F.weekday(day))


def iso_period_to_week(c: ColumnOrName, marker: str = "SM") -> Column:
    """``2025SM52`` -> Monday of that ISO week; NULL on other text or a week the ISO year lacks."""
    text = F.trim(_col(c))
    pattern = rf"^(\d{{4}}){marker}(\d{{1,2}})$"
    year = F.regexp_extract(text, pattern, 1).try_cast("int")
    week = F.regexp_extract(text, pattern, 2).try_cast("int")
    # make_date raises on year 0 in ANSI mode, so go through try_to_date of the text
    jan4 = F.to_date(F.try_to_timestamp(F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01-04"))))
    monday = F.date_add(week_start(jan4), (week - 1) * 7)
    fits = week.between(1, 53) & (iso_year(monday) == year)
    return F.when(fits, monday)


def week_naive(c: ColumnOrName, zone: str = "UTC") -> Column:
    """Zone-aware instant -> its calendar DATE in ``zone``; naive values keep their date."""
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit(zone), _col(c).cast("timestamp_ntz")))


def epoch_to_ts(c: ColumnOrName, unit: str = "ms") -> Column:
    """Epoch milliseconds (``ms``), seconds (``s``) or ISO text (``iso``) -> TIMESTAMP."""
    if unit == "ms":
        return F.timestamp_millis(_col(c).try_cast("long"))
    if unit == "s":
        return F.timestamp_seconds(_col(c).try_cast("long"))
    if unit == "iso":
        return F.try_to_timestamp(_col(c).cast("string"))
    raise ValueError(f"unit must be ms, s or iso, got {unit!r}")


def parse_dayfirst(c: ColumnOrName) -> Column:
    """``dd/MM/yyyy`` text -> DATE, one- or two-digit day and month; NULL when it is none."""
    return F.to_date(F.try_to_timestamp(F.trim(_col(c)), F.lit("d/M/yyyy")))


def parse_mixed_date(c: ColumnOrName) -> Column:
    """Spreadsheet serial, day-first text or ISO text -> DATE, else NULL; time of day is dropped."""
    text = F.trim(_col(c).cast("string"))
    serial = text.try_cast("double")
    # a bare number of any size is never ISO text (Spark would read 2016 as a year)
    from_serial = F.date_add(F.lit(SERIAL_EPOCH).cast("date"), F.floor(serial).try_cast("int"))
    return F.when(
        serial.isNotNull(), F.when(serial.between(SERIAL_MIN + 1e-9, 3e6), from_serial)
    ).otherwise(
        F.coalesce(
            parse_dayfirst(F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/\d{4})(\s.*)?$", 1)),
            F.to_date(F.try_to_timestamp(text)),
        )
    )


def date_hour_to_ts(date: ColumnOrName, hour: ColumnOrName, all_one_based: Column | None = None) -> Column:
    """DATE + hour label -> TIMESTAMP_NTZ.

    Default: labels 1..24 name the hour that *ends* there, so 1 -> 00:00 and 24 -> 23:00.
    With ``all_one_based`` (a boolean Column: every label of the series lies in 1..24 once 24 was
    turned into 0) the historical order is reproduced: 24 -> 0 first, then minus one only where the
    boolean holds. A series that contains an hour 24 is then left unshifted.
    """
    h = _col(hour).try_cast("int")
    if all_one_based is None:
        shifted = h - 1
    else:
        zeroed = F.when(h == 24, 0).otherwise(h)
        shifted = F.when(F.coalesce(all_one_based, F.lit(False)), zeroed - 1).otherwise(zeroed)
    valid = F.when(shifted.between(0, 23), shifted)
    return _col(date).cast("timestamp_ntz") + F.make_dt_interval(hours=valid)


def one_based_hours(hour: ColumnOrName) -> Column:
    """Aggregate/window expression for ``date_hour_to_ts``: no label outside 1..23 after 24 -> 0."""
    h = _col(hour).try_cast("int")
    return F.bool_and(F.when(h == 24, 0).otherwise(h).between(1, 24))


def iso_year(c: ColumnOrName) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _col(c)).cast("int")


def calendar_parts(c: ColumnOrName) -> dict[str, Column]:
    """year, month, quarter, ISO week and year, month name and month bucket of a date."""
    d = _col(c)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "iso_week": F.weekofyear(d),
        "iso_year": iso_year(d),
        "month_name": F.date_format(d, "MMMM"),
        "month_start": F.date_trunc("month", d).cast("date"),
    }


def add_calendar_parts(df, c: str, parts: list[str] | None = None):
    """Add the requested ``calendar_parts`` (all by default) as columns."""
    exprs = calendar_parts(c)
    return df.withColumns({k: exprs[k] for k in (parts or exprs)})


def duration_days(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Inclusive length of an interval in days."""
    return F.datediff(_col(end), _col(start)) + 1


def minutes_from(ts: ColumnOrName, target_minute: int) -> Column:
    """Absolute distance in minutes between the time of day and ``target_minute``; no midnight wrap."""
    return F.abs(F.hour(_col(ts)) * 60 + F.minute(_col(ts)) - target_minute)


def analysis_window(first_year: int, last_year: int) -> tuple[Column, Column]:
    """Monday-floored bounds of the years ``first_year``..``last_year``."""
    lo = week_start(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)))
    hi = week_start(F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))
    return lo, hi
