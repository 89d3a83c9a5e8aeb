"""Fixed-width records, station sheets and header clean-up."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from weekwise.functions.dates import parse_mixed_date
from weekwise.functions.numbers import to_double
from weekwise.operators._util import col


@dataclass(frozen=True)
class Field:
    """A slice of a fixed-width line: 1-based start, length, divisor and the code for a missing value."""

    name: str
    start: int
    length: int
    scale: float = 1.0
    missing: str | None = None


# Positions of the public hourly surface-weather record format.
HOURLY_TIME = (16, 12)
HOURLY_FIELDS = (
    Field("vis_m", 79, 6, 1.0, "999999"),
    Field("vis_qc", 85, 1),
    Field("temp_c", 88, 5, 10.0, "+9999"),
    Field("temp_qc", 93, 1),
    Field("dewpoint_c", 94, 5, 10.0, "+9999"),
    Field("dew_qc", 99, 1),
)


def parse_fixed_width(
    df: DataFrame, line: str = "value", fields: Sequence[Field] = HOURLY_FIELDS, time: tuple[int, int] = HOURLY_TIME,
    time_format: str = "yyyyMMddHHmm", keep: Sequence[str] = (),
) -> DataFrame:
    """Fixed-width lines -> typed columns; lines without a readable time stamp are dropped."""

    def cut(start: int, length: int) -> Column:
        return F.substring(col(line), start, length)

    def value(f: Field) -> Column:
        raw = cut(f.start, f.length)
        number = raw.try_cast("double") / f.scale
        return (F.when(raw != f.missing, number) if f.missing else number).alias(f.name)

    out = df.select(
        *map(col, keep), F.try_to_timestamp(cut(*time), F.lit(time_format)).alias("dt_utc"), *map(value, fields)
    )
    return out.where("dt_utc is not null")


def header_key(name: str) -> str:
    """Header reduced to lower-case letters and digits without accents."""
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", name) if not unicodedata.combining(ch))
    return re.sub(r"[^a-z0-9]", "", plain.lower())


# Pollutant and key columns by the reduced form of their header.
HEADER_RULES = {
    "date": r"^(fecha|date|dia)$",
    "hour": r"^(hora|hour|horas)$",
    "PM10": r"^pm10",
    "PM2.5": r"^pm2.*5",
    "SO2": r"^so2|dioxido.*azufre",
    "NO2": r"^no2",
    "NOx": r"^nox",
    "NO3": r"^no3",
    "NO": r"^no(ugm.*)?$",
    "O3": r"^o3|ozono",
}


def normalize_headers(df: DataFrame, rules: Mapping[str, str] = HEADER_RULES) -> DataFrame:
    """Rename one column per rule to its canonical name (schema only).

    A header that reduces to the canonical name itself goes before one that only fits the pattern: ``NO2`` before ``NO2_validated``
    wherever they stand. Of several exact headers the last is taken, of several that fit the first; the others keep their names.
    """
    taken: dict[str, str] = {}
    for canonical, pattern in rules.items():
        fits = [name for name in df.columns if name not in taken and re.search(pattern, header_key(name))]
        exact = [name for name in fits if header_key(name) == header_key(canonical)]
        if fits:
            taken[exact[-1] if exact else fits[0]] = canonical
    return df.toDF(*[taken.get(name, name) for name in df.columns])


# Columns of a station sheet in their order.
SHEET_COLUMNS = ("date", "hour", "PM10", "PM2.5", "SO2", "NO2", "O3")
SHEET_NAMES = {
    "Fecha": "date", "Hora": "hour", "SO2": "SO2", "NO2": "NO2", "PM10": "PM10",
    "PM2,5": "PM2.5", "PM2.5": "PM2.5", "O3": "O3",
}


def normalize_station_sheet(
    df: DataFrame, names: Mapping[str, str] = SHEET_NAMES, wanted: Sequence[str] = SHEET_COLUMNS,
    second_block: str = "FECHA", keep: Sequence[str] = (),
) -> DataFrame:
    """Clean a station sheet: cut a second block, drop blank headers, add absent columns, type the values.

    Everything from a column named ``second_block`` on belongs to another table and is ignored. Rows
    without a readable date are dropped. ``keep`` columns (station, year) pass through untouched.
    """
    columns = df.columns
    df = df.toDF(*[f"__c{i}" for i in range(len(columns))])  # names that differ only in case would clash
    cut = next((i for i, c in enumerate(columns) if c.strip() == second_block), len(columns))
    present: dict[str, str] = {}
    passed = [col(f"__c{columns.index(k)}").alias(k) for k in keep]
    for i, c in enumerate(columns[:cut]):
        plain = c.strip()
        if plain in keep or not plain or plain.lower().startswith(("unnamed", "_c")):
            continue
        if plain in names:
            present.setdefault(names[plain], f"__c{i}")

    def source(name: str) -> Column:
        return col(present[name]) if name in present else F.lit(None).cast("string")

    typed = {"date": parse_mixed_date, "hour": lambda c: F.trim(c).try_cast("int")}
    out = df.select(*passed, *[typed.get(n, to_double)(source(n)).alias(n) for n in wanted])
    return out.where("date is not null")
