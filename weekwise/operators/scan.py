"""Segmented prefix scans: row numbers, lags, running values, episodes, runs and interpolation on series of any length.

A window over an entity puts all its rows into one task. Here a long series is cut into time ranges (``cuts.py``, the small cut table is
stored), every range is scanned on its own, one row per range (its size, its edge values, its sums) is scanned across the ranges, and what
that scan carries into a range is joined back. Each operator shuffles the rows once, to their ranges: all windows on rows stand before that join,
whose keys are those that the rows are dealt by. Entities with at most ``rows`` rows have one range and no carry. ``order`` is the key of the series, ``ties`` are columns that order rows with an equal key, which stay in
one range. A NULL key comes first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._util import as_list, col
from .cuts import ranged_by_stored

ROWS = 100_000  # rows from which on an entity is cut, and about the rows of a range
RANGES = 4_096  # ranges of an entity at most


class Series:
    """A table cut into ranges, and the windows inside a range and across the ranges of an entity."""

    def __init__(self, df: DataFrame, entity, order: str, ties: Sequence[str] = (), rows: int = ROWS) -> None:
        keys = as_list(entity)
        if not keys:
            df, keys = df.withColumn("__all", F.lit(0)), ["__all"]
        self.columns = [c for c in df.columns if c != "__all"]
        # one key that is never NULL: a join on it finds the rows dealt as the windows left them
        self.rows = ranged_by_stored(df, order, keys, rows, RANGES).withColumn("__series", F.struct(*map(col, keys)))
        self.part = ["__series", "__range"]
        place = [col(c) for c in (order, *ties)]
        self.forward = Window.partitionBy(*self.part).orderBy(*[c.asc() for c in place])
        self.backward = Window.partitionBy(*self.part).orderBy(*[c.desc() for c in place])
        self.along = Window.partitionBy("__series").orderBy("__range")  # at most RANGES rows
        self.so_far = self.forward.rowsBetween(Window.unboundedPreceding, 0)
        self.to_come = self.backward.rowsBetween(Window.unboundedPreceding, 0)
        self.before = self.along.rowsBetween(Window.unboundedPreceding, -1)
        self.after = Window.partitionBy("__series").orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)

    def carried(self, rows: DataFrame, per_range: Mapping[str, Column], *levels: Mapping[str, Column]) -> DataFrame:
        """Aggregate each range, scan the aggregates along the ranges in ``levels``, and join the last level to the rows.

        Entities with one range have no row in the joined table, so what they are carried is NULL.
        """
        table = rows.groupBy(*self.part).agg(*[c.alias(n) for n, c in per_range.items()])
        table = table.withColumn("__ranges", F.count("*").over(Window.partitionBy("__series"))).where("__ranges > 1")
        for level in levels:
            table = table.withColumns(dict(level))
        return rows.join(table.select(*self.part, *levels[-1]), self.part, "left")

    def result(self, rows: DataFrame, **added: Column) -> DataFrame:
        return rows.select(*map(col, self.columns), *[c.alias(n) for n, c in added.items()])


def _number(flag: Column) -> Column:
    return F.when(flag, 1).otherwise(0).cast("bigint")


def row_numbers(df: DataFrame, entity, order: str, name: str = "row_number", ties: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """Position of each row in its series, from 1."""
    s = Series(df, entity, order, ties, rows)
    inside = s.rows.withColumn("__i", F.row_number().over(s.forward).cast("bigint"))
    out = s.carried(inside, {"__n": F.count("*")}, {"__o": F.sum("__n").over(s.before)})
    return s.result(out, **{name: F.col("__i") + F.coalesce("__o", F.lit(0))})


def _edges(s: Series, held: Column, most: int, lead: bool) -> tuple[DataFrame, dict[str, Column], dict[str, Column], dict[str, Column]]:
    """Rows numbered from the edge that values enter by, and the ``most`` values nearest to it of the ranges before, nearest last."""
    inside, outward = (s.backward, s.forward) if lead else (s.forward, s.backward)
    numbered = s.rows.withColumns({"__i": F.row_number().over(inside), "__e": F.row_number().over(outward)})
    edge = F.when(F.col("__e") <= most, F.struct((-F.col("__e")).alias("e"), held.alias("v")))
    toward = Window.partitionBy("__series").orderBy(F.desc("__range") if lead else F.asc("__range")).rowsBetween(-most, -1)
    # every range has a row, so the nearest ``most`` ranges are enough, and of their values the nearest ``most``
    tails = {"__tails": F.flatten(F.collect_list("__tail").over(toward))}
    carry = {"__carry": F.slice("__tails", F.greatest(F.size("__tails") - most, F.lit(0)) + 1, F.lit(most))}
    return numbered.withColumn("__edge", edge), {"__tail": F.sort_array(F.collect_list("__edge"))}, tails, carry


def _shifted(df: DataFrame, c: str, ks: Sequence[int], entity, order: str, ties: Sequence[str], rows: int, lead: bool) -> DataFrame:
    s = Series(df, entity, order, ties, rows)
    shift, word = (F.lead, "lead") if lead else (F.lag, "lag")
    numbered, *levels = _edges(s, col(c), max(ks), lead)
    out = s.carried(numbered.withColumns({f"__s{k}": shift(col(c), k).over(s.forward) for k in ks}), *levels)
    carried = {k: F.get("__carry", F.size("__carry") - k + F.col("__i") - 1)["v"] for k in ks}
    return s.result(out, **{f"{c}_{word}{k}": F.when(F.col("__i") > k, F.col(f"__s{k}")).otherwise(carried[k]) for k in ks})


def lags(df: DataFrame, c: str, ks: Sequence[int], entity, order: str, ties: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """``c_lag<k>``: the value ``k`` rows earlier in the series, NULL before its start."""
    return _shifted(df, c, ks, entity, order, ties, rows, lead=False)


def leads(df: DataFrame, c: str, ks: Sequence[int], entity, order: str, ties: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """``c_lead<k>``: the value ``k`` rows later in the series, NULL past its end."""
    return _shifted(df, c, ks, entity, order, ties, rows, lead=True)


def moving_avg(df: DataFrame, c: str, n: int, entity, order: str, name: str | None = None, ties: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """Mean of the last ``n`` rows, from the first row on; NULL where none of them is known."""
    s = Series(df, entity, order, ties, rows)
    value = col(c).cast("double")
    numbered, *levels = _edges(s, value, max(n - 1, 1), False)
    last = s.forward.rowsBetween(1 - n, 0)
    out = s.carried(numbered.withColumns({"__s": F.coalesce(F.sum(value).over(last), F.lit(0.0)), "__c": F.count(col(c)).over(last)}), *levels)
    need = F.when(F.col("__i") < n, n - F.col("__i")).otherwise(0)
    reach = F.slice(F.coalesce("__carry", F.array().cast("array<struct<e:int,v:double>>")), -F.least(need, F.size("__carry")), need)
    known = F.filter(F.transform(F.when((need > 0) & (F.size("__carry") > 0), reach), lambda e: e["v"]), lambda v: v.isNotNull())
    total = F.col("__s") + F.coalesce(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.lit(0.0))
    return s.result(out, **{name or f"{c}_ma{n}": F.try_divide(total, F.col("__c") + F.coalesce(F.size(known), F.lit(0)))})


def running_sums(df: DataFrame, cols: Mapping[str, str], entity, order: str, ties: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """name -> column: its sum from the start of the series up to the row; NULL adds nothing, and is the sum of nothing."""
    s = Series(df, entity, order, ties, rows)
    names = list(cols)
    inside = s.rows.withColumns({f"__s{k}": F.sum(col(cols[n])).over(s.so_far) for k, n in enumerate(names)})
    out = s.carried(
        inside, {f"__t{k}": F.sum(col(cols[n])) for k, n in enumerate(names)}, {f"__o{k}": F.sum(f"__t{k}").over(s.before) for k in range(len(names))}
    )
    return s.result(out, **{n: F.coalesce(F.col(f"__s{k}") + F.col(f"__o{k}"), f"__s{k}", f"__o{k}") for k, n in enumerate(names)})


def last_known(
    df: DataFrame, cols: Mapping[str, str], entity, order: str, ties: Sequence[str] = (), rows: int = ROWS, after: bool = False
) -> DataFrame:
    """name -> column: the newest value that is not NULL up to the row, or with ``after`` the next one from the row on."""
    s = Series(df, entity, order, ties, rows)
    window, across, pick = (s.to_come, s.after, F.min) if after else (s.so_far, s.before, F.max)
    inside = s.rows.withColumn("__i", F.row_number().over(s.forward))
    inside = inside.withColumns({f"__v{k}": F.last(col(c), True).over(window) for k, c in enumerate(cols.values())})
    edge = {f"__t{k}": pick(F.when(col(c).isNotNull(), F.struct(F.col("__i"), col(c).alias("v")))) for k, c in enumerate(cols.values())}
    out = s.carried(inside, edge, {f"__o{k}": F.last(F.col(f"__t{k}")["v"], True).over(across) for k in range(len(cols))})
    return s.result(out, **{n: F.coalesce(f"__v{k}", f"__o{k}") for k, n in enumerate(cols)})


def episodes(
    df: DataFrame, flag: str, entity, order: str, ties: Sequence[str] = (), gap: str | None = None, name: str = "episode_id", rows: int = ROWS,
) -> DataFrame:
    """Number the maximal runs of ``flag = 1`` in each series; NULL outside them.

    With ``gap`` (an interval such as ``"INTERVAL 2 HOURS"``) rows further apart than that begin a new episode.
    """
    s = Series(df, entity, order, ties, rows)
    state = F.struct(F.coalesce(col(flag) == 1, F.lit(False)).alias("on"), col(order).alias("at"))

    def begins(x: Column, previous: Column) -> Column:
        goes_on = previous["on"] if gap is None else previous["on"] & (x["at"] <= previous["at"] + F.expr(gap))
        return x["on"] & ~F.coalesce(goes_on, F.lit(False))

    inside = s.rows.withColumns({"__x": state, "__i": F.row_number().over(s.forward)})
    inside = inside.withColumn("__b", _number((F.col("__i") > 1) & begins(F.col("__x"), F.lag("__x", 1).over(s.forward))))
    inside = inside.withColumns({"__c": F.sum("__b").over(s.so_far), "__first": F.first("__x").over(s.so_far)})
    out = s.carried(
        inside, {"__t": F.sum("__b"), "__f": F.min_by("__x", "__i"), "__l": F.max_by("__x", "__i")},
        {"__u": _number(begins(F.col("__f"), F.lag("__l", 1).over(s.along)))},
        {"__o": F.col("__u") + F.coalesce(F.sum(F.col("__t") + F.col("__u")).over(s.before), F.lit(0))},
    )
    number = F.coalesce("__o", _number(F.col("__first")["on"])) + F.col("__c")
    return s.result(out, **{name: F.when(F.col("__x")["on"], number)})


def runs(df: DataFrame, c: str, entity, order: str, ties: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """Run-length encoding: entity, run_id, value, first and last key and length of each run of equal values."""
    s = Series(df, entity, order, ties, rows)
    inside = s.rows.withColumns({"__x": F.struct(col(c).alias("v")), "__i": F.row_number().over(s.forward)})
    inside = inside.withColumn("__b", _number((F.col("__i") > 1) & (F.col("__x") != F.lag("__x", 1).over(s.forward))))
    inside = inside.withColumn("__c", F.sum("__b").over(s.so_far))
    out = s.carried(
        inside, {"__t": F.sum("__b"), "__f": F.min_by("__x", "__i"), "__l": F.max_by("__x", "__i")},
        {"__u": _number(~F.col("__f").eqNullSafe(F.lag("__l", 1).over(s.along)))},
        {"__o": F.col("__u") + F.coalesce(F.sum(F.col("__t") + F.col("__u")).over(s.before), F.lit(0))},
    )
    # a run may be as long as the series: its rows combine map-side
    return out.withColumn("run_id", F.coalesce("__o", F.lit(1)) + F.col("__c")).groupBy(*map(col, as_list(entity)), "run_id").agg(
        F.first(col(c)).alias("value"), F.min(col(order)).alias("start"), F.max(col(order)).alias("end"), F.count("*").alias("length")
    )


def interpolate(df: DataFrame, cols: Sequence[str], entity, order: str, ties: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """Fill NULLs linearly by row position between the known neighbours, edges by the nearest value, else 0."""
    s = Series(df, entity, order, ties, rows)
    inside = s.rows.withColumn("__i", F.row_number().over(s.forward).cast("bigint"))
    many = range(len(cols))

    def at(i: Column, v: Column) -> Column:
        return F.when(v.isNotNull(), F.struct(i.alias("i"), v.alias("v")))

    inside = inside.withColumns({f"__p{k}": at(F.col("__i"), col(c)) for k, c in enumerate(cols)})
    inside = inside.withColumns({f"__a{k}": F.last(f"__p{k}", True).over(s.so_far) for k in many})
    inside = inside.withColumns({f"__b{k}": F.last(f"__p{k}", True).over(s.to_come) for k in many})

    def moved(name: str) -> Column:
        return at(F.col("__o") + F.col(name)["i"], F.col(name)["v"])

    out = s.carried(
        inside, {"__n": F.count("*"), **{f"__f{k}": F.min(f"__p{k}") for k in many}, **{f"__l{k}": F.max(f"__p{k}") for k in many}},
        {"__o": F.coalesce(F.sum("__n").over(s.before), F.lit(0))},
        {"__o": F.col("__o"), **{f"__pa{k}": F.last(moved(f"__l{k}"), True).over(s.before) for k in many},
         **{f"__pb{k}": F.last(moved(f"__f{k}"), True).over(s.after) for k in many}},
    )
    out = out.withColumn("__o", F.coalesce("__o", F.lit(0)))
    filled = {}
    for k, c in enumerate(cols):
        a, b = F.coalesce(moved(f"__a{k}"), f"__pa{k}"), F.coalesce(moved(f"__b{k}"), f"__pb{k}")
        part = F.try_divide(F.col("__o") + F.col("__i") - a["i"], b["i"] - a["i"])
        filled[c] = F.coalesce(col(c), a["v"] + (b["v"] - a["v"]) * part, a["v"], b["v"], F.lit(0.0))
    return out.select(*[filled[c].alias(c) if c in filled else col(c) for c in s.columns])
