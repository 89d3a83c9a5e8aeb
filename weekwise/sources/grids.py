"""Gridded fields stored along a space-filling curve, so that a box of coordinates reads few row groups.

Within a month, rows are sorted by a Morton code: the bits of the latitude's and the longitude's place on a fixed world grid, one after
the other. Cells that are near each other are near in the file, a box is a few ranges of codes, and the statistics of row groups and pages
leave out what lies outside them. The box itself is still tested, so the codes decide what is read and never what is returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weekwise.operators._util import col

BITS = 16  # per axis: steps of 0.003 and 0.006 degrees; the tables of all users share this grid, so it is no parameter
LAT, LON = (-90.0, 90.0), (-180.0, 180.0)
CODE, MONTH = "grid_code", "grid_month"
SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))  # fixed values: gaps between the bits of a 16-bit number


def _place(c: Column, axis: tuple[float, float]) -> Column:
    """Step of a coordinate on its axis; what lies outside belongs to the first or last step, NULL and NaN to none."""
    x = c.cast("double")
    step = (x - axis[0]) * ((1 << BITS) / (axis[1] - axis[0]))
    return F.when(~F.isnan(x), F.floor(F.least(F.greatest(step, F.lit(0.0)), F.lit((1 << BITS) - 1.0))).cast("long"))


def _step(x: float, axis: tuple[float, float]) -> int:
    step = (float(x) - axis[0]) * ((1 << BITS) / (axis[1] - axis[0]))
    return int(min(max(step, 0.0), (1 << BITS) - 1.0))


def grid_code(lat: Column, lon: Column) -> Column:
    """Morton code of a position."""

    def spread(c: Column) -> Column:
        for shift, mask in SPREAD:
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return c

    return F.shiftleft(spread(_place(lat, LAT)), 1).bitwiseOR(spread(_place(lon, LON)))


def box_ranges(box: tuple[float, float, float, float], most: int = 32) -> list[tuple[int, int]]:
    """Ranges of codes, in order, that hold every position in (south, west, north, east): squares of the grid, halved while at most ``most`` are left."""
    south, west, north, east = box
    if not (south <= north and west <= east):
        return []
    lat, lon = (_step(south, LAT), _step(north, LAT)), (_step(west, LON), _step(east, LON))
    squares, size = [(0, 0, 0)], BITS  # row, column and first code of each square of 2**size steps
    while size:
        half, halved = 1 << (size - 1), []
        for row, column, code in squares:
            for k in range(4):
                r, c = row + (k >> 1) * half, column + (k & 1) * half
                if r <= lat[1] and r + half > lat[0] and c <= lon[1] and c + half > lon[0]:
                    halved.append((r, c, code + (k << 2 * (size - 1))))
        if len(halved) > most:
            break
        squares, size = halved, size - 1
    out: list[tuple[int, int]] = []
    for _, _, code in squares:
        last = code + (1 << 2 * size) - 1
        if out and out[-1][1] + 1 == code:
            out[-1] = (out[-1][0], last)
        else:
            out.append((code, last))
    return out


def write_grid(
    df: DataFrame, path: str, time: str = "time", lat: str = "latitude", lon: str = "longitude", mode: str = "overwrite", group_bytes: int = 16 << 20,
) -> None:
    """Gridded rows by month and, within it, in the order of their codes.

    The ranges of (month, code) that tasks write are cut by a sample of the rows, so a month that holds most of them is split over many
    files, each with codes of its own. Row groups of ``group_bytes`` are what a reader skips or reads. Rows without a position come
    first; rows without a time are a month of their own.
    """
    taken = {CODE, MONTH} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are made by write_grid")
    rows = df.withColumns({CODE: grid_code(col(lat), col(lon)), MONTH: (F.year(col(time)) * 100 + F.month(col(time)))})
    ordered = rows.repartitionByRange(MONTH, CODE).sortWithinPartitions(MONTH, CODE)
    ordered.write.mode(mode).option("parquet.block.size", group_bytes).partitionBy(MONTH).parquet(path)


def read_grid(
    spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, months: tuple[int, int] | None = None,
    lat: str = "latitude", lon: str = "longitude",
) -> DataFrame:
    """Rows of a table of ``write_grid`` within a box (south, west, north, east; edges belong to it) and from one month to another (202401: January 2024)."""
    df = spark.read.option("recursiveFileLookup", "false").parquet(path)
    if months:
        df = df.where(F.col(MONTH).between(*months))
    if box:
        south, west, north, east = box
        near = reduce(Column.__or__, [F.col(CODE).between(a, b) for a, b in box_ranges(box)], F.lit(False))
        df = df.where(near).where(col(lat).between(south, north) & col(lon).between(west, east))
    return df.drop(CODE, MONTH)
