"""Segmented scans, cut tables, interval sweeps and the QR least squares against plain versions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from weekwise.operators import clean, cuts, intervals, models, ordered, pvalues, scan
from weekwise.operators import window as win

ROWS = 40


@pytest.fixture(scope="module")
def events(spark):
    """One entity holds most rows; NULL values, NULL entities, equal keys, a NULL key, an entity of one row."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        e = None if i % 50 == 0 else "hot" if i % 10 < 7 else f"e{i % 5}"
        rows.append((i, e, None if i == 7 else int(rng.integers(0, 1200)), None if rng.random() < 0.4 else float(rng.integers(0, 9)), int(rng.random() < 0.6)))
    rows.append((5000, "single", 3, None, 1))
    return spark.createDataFrame(rows, "i int, e string, k int, v double, f int").cache()


def along():
    return Window.partitionBy("e").orderBy("k", "i")


def same(a, b):
    def rows(df):
        return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)

    assert rows(a) == rows(b)


def run(fn, df, *args, **kw):
    return fn(df, *args, entity="e", order="k", ties=["i"], rows=ROWS, **kw)


def test_largest_range(events):
    sizes = scan.Series(events, "e", "k", ["i"], ROWS).rows.groupBy("e", "__range").count().collect()
    hot = [r["count"] for r in sizes if r.e == "hot"]
    assert len(hot) > 10 and max(hot) < 5 * ROWS
    assert [r["count"] for r in sizes if r.e == "single"] == [1]


def test_cuts_of_a_group_of_millions(spark):
    many = 9_000_000
    rows = spark.range(many).withColumnRenamed("id", "v")
    found = cuts.group_cuts(rows, "v").first()["__cuts"]
    assert 200 < len(found) < cuts.RANGES and found == sorted(found)
    assert max(b - a for a, b in zip(found, found[1:])) < 5 * many / cuts.RANGES
    assert ordered.quantiles(rows, "v", {"q": 0.9}).first().q == pytest.approx(0.9 * (many - 1))


def test_rows_and_sums(events):
    same(run(scan.row_numbers, events, name="n"), events.withColumn("n", F.row_number().over(along())))
    same(run(scan.running_sums, events, {"s": "v", "c": "f"}), events.withColumns({"s": F.sum("v").over(along()), "c": F.sum("f").over(along())}))
    everything = Window.partitionBy(F.lit(1)).orderBy("k", "i")
    same(scan.row_numbers(events, [], "k", "n", ["i"], ROWS), events.withColumn("n", F.row_number().over(everything)))


@pytest.mark.parametrize("k", [1, 3, 90])
def test_shifts(events, k):
    same(run(scan.lags, events, "v", [1, k]), events.withColumns({f"v_lag{j}": F.lag("v", j).over(along()) for j in (1, k)}))
    same(run(scan.leads, events, "v", [k]), events.withColumn(f"v_lead{k}", F.lead("v", k).over(along())))
    same(run(scan.moving_avg, events, "v", k, name="m"), events.withColumn("m", F.avg("v").over(along().rowsBetween(1 - k, 0))))


def test_no_row_is_sorted_with_what_it_is_carried(events):
    """A window on rows above the join would shuffle and sort every row with the values of the ranges before it."""
    for df in (run(scan.lags, events, "v", [1, 24]), run(scan.leads, events, "v", [3]), run(scan.moving_avg, events, "v", 7)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join LeftOuter") < plan.index("Window")
    s = scan.Series(events, "e", "k", ["i"], ROWS)
    rows, *levels = scan._edges(s, F.col("v"), 24, False)
    assert s.carried(rows, *levels).agg(F.max(F.size("__carry"))).first()[0] == 24


def test_known_and_filled(events):
    ahead = along().rowsBetween(0, Window.unboundedFollowing)
    same(run(scan.last_known, events, {"a": "v"}), events.withColumn("a", F.last("v", True).over(along())))
    same(run(scan.last_known, events, {"a": "v"}, after=True), events.withColumn("a", F.first("v", True).over(ahead)))
    distinct = events.where("k IS NOT NULL").dropDuplicates(["e", "k"])
    same(run(scan.interpolate, distinct, ["v"]), clean.interpolate(distinct, ["v"], "e", "k"))
    gaps = events.withColumn("v", F.when((F.col("k") < 200) | (F.col("k") > 900), F.col("v")))
    whole = run(scan.interpolate, gaps, ["v"])
    assert whole.where("v IS NULL").isEmpty() and whole.count() == events.count()


def test_episodes_and_runs(events):
    plain = events.where("k IS NOT NULL").dropDuplicates(["e", "k"])
    same(run(scan.episodes, plain, "f"), win.episodes(plain, "f", "e", "k"))
    same(run(scan.runs, plain, "f"), win.runs(plain, "f", "e", "k"))
    ones = plain.withColumn("f", F.lit(1))
    assert run(scan.runs, ones, "f").where("e = 'hot'").count() == 1
    assert run(scan.episodes, ones, "f").where("episode_id <> 1").isEmpty()
    nulls = plain.withColumn("v", F.when(F.col("f") == 1, F.col("v")))
    same(run(scan.runs, nulls, "v"), win.runs(nulls, "v", "e", "k"))
    assert run(scan.episodes, plain.limit(0), "f").isEmpty()


def test_groups_are_cut_along_their_own_values(spark):
    """Disjoint value ranges: cuts over all groups would leave each group in a few tasks."""
    rows = [("low", float(i)) for i in range(4000)] + [("high", 1e9 + i / 7) for i in range(4000)] + [("few", 5.0)] + [("tie", 1.0)] * 4000
    df = spark.createDataFrame(rows, "g string, x double")
    ranged = cuts.ranged(df, "x", "g", per_range=250)
    sizes = {r.g: (r.n, r.most) for r in ranged.groupBy("g", "__range").count().groupBy("g").agg(F.count("*").alias("n"), F.max("count").alias("most")).collect()}
    assert sizes["few"] == (1, 1) and sizes["tie"] == (1, 4000)
    for g in ("low", "high"):
        assert 10 <= sizes[g][0] <= 16 and sizes[g][1] <= 1000
    first = ranged.groupBy("g", "__range").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("g = 'high'").orderBy("__range").collect()
    assert all(p.b < q.a for p, q in zip(first, first[1:]))


def test_ladder_over_cut_groups(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 50)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b", None], [900, 600, 5]), "v": np.concatenate([rng.normal(0, 1, 900), rng.normal(1e6, 3, 600), [1, 1, 2, 3, 9]])})
    got = {r.g: (r.q1, r.q5) for r in ordered.quantiles(spark.createDataFrame(pdf), "v", {"q1": 0.1, "q5": 0.5}, "g").collect()}
    for g, part in pdf.groupby("g", dropna=False):
        assert got[g if isinstance(g, str) else None] == pytest.approx(tuple(np.quantile(part.v, [0.1, 0.5])), rel=1e-12)
    whole = ordered.quantiles(spark.createDataFrame(pdf), "v", {"q": 0.3}).first().q
    assert whole == pytest.approx(np.quantile(pdf.v, 0.3), rel=1e-12)


def test_interval_sweeps(spark):
    rng = np.random.default_rng(2)
    day = dt.date(2020, 1, 1)
    rows = []
    for i in range(300):
        a = day + dt.timedelta(int(rng.integers(0, 400)))
        rows.append((["a", "b", None][i % 3], a, a + dt.timedelta(int(rng.choice([0, 1, 6, 7, 100, -2]))), None if i % 9 == 0 else float(rng.integers(0, 50))))
    rows += [("a", None, day, 1.0), ("a", day, None, 1.0)] + [("b", day, day, 3.0)] * 3
    want, weeks, high = {}, {}, {}
    for e, a, b, v in rows:
        for n in range((b - a).days + 1 if a and b else 0):
            d = a + dt.timedelta(n)
            want[e, d] = want.get((e, d), 0) + 1
            monday = d - dt.timedelta(d.weekday())
            weeks[e, monday] = weeks.get((e, monday), 0) + 1
            high[e, d] = max((x for x in (high.get((e, d)), v) if x is not None), default=None)
    df = spark.createDataFrame(rows, "e string, a date, b date, v double")
    assert {(r.e, r.date): r.open for r in intervals.open_per_day(df, "e", "a", "b").collect()} == want
    assert {(r.e, r.week_start): r.event_days for r in intervals.interval_days_per_week(df, "e", "a", "b").collect()} == weeks
    assert {(r.e, r.date): r.v for r in intervals.highest_per_day(df, "e", "a", "b", "v").collect()} == high
    assert intervals.highest_per_day(df.limit(0), [], "a", "b", "v").isEmpty()


def test_nearly_collinear_least_squares(spark):
    """Columns that differ in the seventh digit: cross-products would lose them."""
    rng = np.random.default_rng(7)
    t = np.arange(4000.0)
    x1 = t / 100 + 1000
    x2 = x1 + 1e-5 * rng.normal(size=len(t))
    y = 2 * x1 - 3 * x2 + rng.normal(size=len(t)) * 1e-6 + 5
    pdf = pd.DataFrame({"g": np.where(t % 2 == 0, "a", "b"), "x1": x1, "x2": x2, "y": y})
    fits = models.ols(spark.createDataFrame(pdf).repartition(7), ["x1", "x2"], "y", "g").collect()
    for fit in fits:
        part = pdf[pdf.g == fit.g]
        centred = part[["x1", "x2", "y"]] - part[["x1", "x2", "y"]].mean()
        want = np.linalg.lstsq(centred[["x1", "x2"]].to_numpy(), centred.y.to_numpy(), rcond=None)[0]
        got = {c.term: c.coef for c in fit.coefs}
        assert (fit.k, fit.n) == (3, 2000) and [got["x1"], got["x2"]] == pytest.approx(list(want), rel=1e-9)


def test_dependent_columns_and_odd_groups(spark):
    pdf = pd.DataFrame({"g": ["a"] * 6 + ["b"] + ["c"] * 3, "x": [1.0, 2, 3, 4, 5, 7, 1, 2, 2, 2], "y": [1.0, 3, 2, 5, 4, 8, 2, 1, 2, 6]})
    df = spark.createDataFrame(pdf.assign(twice=pdf.x * 2))
    fits = {r.g: r for r in models.ols(df, ["x", "twice"], "y", "g").collect()}
    one = {r.g: r for r in models.ols(df, ["x"], "y", "g").collect()}
    assert fits["a"].k == 2 and fits["a"].rss == pytest.approx(one["a"].rss) and fits["b"].n == 1 and fits["b"].p_f is None
    assert one["c"].k == 1 and one["c"].coefs[0].coef == pytest.approx(3.0)


def test_critical_values():
    many = pvalues.t_critical(np.array([1, 2, 10, 1e6, 0, np.nan]))
    assert many[:4] == pytest.approx([12.7062047361747, 4.30265272974946, 2.22813885198627, 1.95996635682], rel=1e-10)
    assert np.isnan(many[4:]).all() and pvalues.t_critical(30, 0.99) == pytest.approx(2.74999565356721, rel=1e-12)
