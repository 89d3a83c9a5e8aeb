"""Operators against brute force (pandas / numpy) on small fixtures, including hot values and ties."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from weekwise.operators import aggregate, calendar, clean, dedup, joins, models, ordered, pvalues, quality, report, resample, score, stats, window

D = dt.date
MON = D(2020, 1, 6)


def weeks(values, entity="a", start=MON, step=7):
    return [(entity, start + dt.timedelta(days=step * i), v) for i, v in enumerate(values)]


def frame(spark, rows, ddl="entity string, week_start date, x double"):
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(1)
    n = 4000
    g = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcd"), n))
    v = np.where(rng.random(n) < 0.33, 7.0, np.round(rng.gamma(2, 10, n), 1))
    return pd.DataFrame({"g": g, "v": v, "f": (rng.random(n) < 0.3).astype(int), "w": np.round(v + rng.normal(0, 20, n), 1)})


def test_ladder_quantiles_match_pandas(spark, skewed):
    df = spark.createDataFrame(skewed)
    qs = {"q01": 0.01, "q33": 0.33, "med": 0.5, "q95": 0.95, "q100": 1.0}
    got = {r.g: r for r in ordered.quantiles(df, "v", qs, "g").collect()}
    for g, part in skewed.groupby("g"):
        for name, q in qs.items():
            assert got[g][name] == pytest.approx(part.v.quantile(q), abs=1e-9)
    total = ordered.quantiles(df, "v", qs).first()
    assert total.med == pytest.approx(skewed.v.median())


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0])), min_size=1, max_size=60))
def test_ladder_is_exact_for_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = pd.Series([v for v in values if v is not None], dtype=float)
    row = ordered.quantiles(df, "v", {"a": 0.25, "b": 0.9}).first()
    if known.empty:
        assert row is None or row.a is None
    else:
        assert row.a == pytest.approx(known.quantile(0.25), abs=1e-6)
        assert row.b == pytest.approx(known.quantile(0.9), abs=1e-6)


def test_average_ranks(spark, skewed):
    got = ordered.average_ranks(spark.createDataFrame(skewed), "v", "r", "g").toPandas()
    want = skewed.groupby("g").v.rank()
    left = got.sort_values(["g", "v"]).groupby(["g", "v"]).r.first()
    right = skewed.assign(r=want).sort_values(["g", "v"]).groupby(["g", "v"]).r.first()
    pd.testing.assert_series_equal(left, right)
    assert len(got) == len(skewed)


def test_spearman_and_mannwhitney(spark, skewed):
    df = spark.createDataFrame(skewed)
    assert stats.spearman(df, "v", "w").first().rho == pytest.approx(skewed.v.rank().corr(skewed.w.rank()))
    a, b = skewed.v[skewed.f == 1].to_numpy(), skewed.v[skewed.f == 0].to_numpy()
    u = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
    row = stats.mannwhitney(df, "f", "v").first()
    assert row.u == pytest.approx(u) and 0 <= row.p <= 1


def test_roc_matches_brute_force(spark, skewed):
    df = spark.createDataFrame(skewed)
    pos, neg = skewed.v[skewed.f == 1].to_numpy(), skewed.v[skewed.f == 0].to_numpy()
    auc = ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())
    row = stats.roc(df, "v", "f").first()
    assert row.auc == pytest.approx(auc)
    best = max((pos >= t).mean() - (neg >= t).mean() for t in np.unique(skewed.v))
    assert row.youden == pytest.approx(best)
    assert row.sensitivity == pytest.approx((pos >= row.threshold).mean())


def test_dedup_hot_key(spark):
    rows = [("hot", i % 50, i) for i in range(500)] + [("b", None, 1), ("b", 3, 2)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(7)
    last = {r.k: (r.o, r.v) for r in dedup.dedup_last(df, "k", "o").collect()}
    first = {r.k: (r.o, r.v) for r in dedup.dedup_first(df, "k", "o").collect()}
    assert last == {"hot": (49, 499), "b": (3, 2)}
    assert first == {"hot": (0, 0), "b": (3, 2)}


def test_interpolation_matches_pandas(spark):
    values = [None, None, 1.0, None, None, 4.0, 5.0, None, 8.0, None]
    out = clean.interpolate(frame(spark, weeks(values) + weeks([None, None], "empty")), ["x"], "entity").toPandas()
    got = out[out.entity == "a"].sort_values("week_start").x.to_list()
    want = pd.Series(values, dtype=float).interpolate(method="linear", limit_direction="both").to_list()
    assert got == pytest.approx(want)
    assert out[out.entity == "empty"].x.to_list() == [0.0, 0.0]


def test_quantile_bins_match_qcut(spark):
    values = [0.0, 0.0, 0.0, 0.0, 1.0, 2.0, 2.0, 3.0, 5.0, 8.0, 8.0, 9.0]
    out = window.quantile_bins(frame(spark, weeks(values)), "x", 5, "bin").toPandas().sort_values("week_start")
    want = pd.qcut(pd.Series(values), 5, labels=False, duplicates="drop")
    assert out.bin.to_list() == want.to_list()


def test_episodes_by_row_and_calendar(spark):
    rows = [r for i, r in enumerate(weeks([1, 1, 0, 1, 1, 1, 0])) if i != 4]
    df = frame(spark, rows, "entity string, week_start date, f int")
    by_row = [r.episode_id for r in window.episodes(df, "f", "entity").orderBy("week_start").collect()]
    by_cal = [r.episode_id for r in window.episodes(df, "f", "entity", by="calendar").orderBy("week_start").collect()]
    assert by_row == [1, 1, None, 2, 2, None]
    assert by_cal == [1, 1, None, 2, 3, None]


def test_gaps(spark):
    rows = [(e, w, c) for e, w, c in weeks([1.0, 0.5, 0.4, 1.0, 1.0, 1.0, 0.2]) if w != MON + dt.timedelta(days=28)]
    df = frame(spark, rows, "entity string, week_start date, coverage double")
    got = sorted((r.gap_start, r.gap_end, r.weeks) for r in window.detect_gaps(df, "entity", "coverage").collect())
    day = lambda n: MON + dt.timedelta(days=n)
    assert got == [(day(7), day(20), 2), (day(28), day(34), 1), (day(42), day(48), 1)]


def test_gaps_outside_the_data(spark):
    df = frame(spark, weeks([1.0, 1.0]), "entity string, week_start date, coverage double")
    out = window.detect_gaps(df, "entity", "coverage", start="2019-12-25", end="2020-01-27").collect()
    assert sorted((r.gap_start, r.gap_end) for r in out) == [(D(2019, 12, 23), D(2020, 1, 5)), (D(2020, 1, 20), D(2020, 2, 2))]


def test_patch_overwrites_with_null_and_appends(spark):
    main = frame(spark, weeks([1.0, 2.0, 3.0]))
    donor = frame(spark, weeks([None, 20.0], start=MON + dt.timedelta(days=14)))
    out = joins.patch_from_donor(main, donor, ["entity", "week_start"], "imputed", "S1", append=True)
    got = [(r.x, r.imputed, r.donor_station) for r in out.orderBy("week_start").collect()]
    assert got == [(1.0, 0, None), (2.0, 0, None), (None, 1, "S1"), (20.0, 1, "S1")]
    with pytest.raises(ValueError):
        joins.require_overlap(main, frame(spark, weeks([1.0], start=D(2030, 1, 7))), ["entity", "week_start"])


def test_nearest_in_day_ties_and_tolerance(spark):
    t = lambda h, m: dt.datetime(2020, 1, 1, h, m)
    rows = [("s", t(11, 50), 1), ("s", t(12, 10), 2), ("s", t(10, 29), 3), ("q", t(10, 30), 4), ("r", t(10, 29), 5)]
    df = spark.createDataFrame(rows, "station string, ts timestamp, v int")
    got = {r.station: r.v for r in joins.nearest_in_day(df, ["station"], "ts").collect()}
    assert got == {"s": 1, "q": 4}


def test_weighted_rollup_counts_null_levels_in_the_denominator(spark):
    levels = spark.createDataFrame([("a", MON, "intense"), ("b", MON, None), ("a", D(2020, 1, 13), "probable")],
                                   "entity string, week_start date, level string")
    parents = spark.createDataFrame([("a", "p", 60), ("b", "p", 40), ("c", "p", 100)], "entity string, parent string, population long")
    out = {r.week_start: r for r in aggregate.weighted_rollup(levels, parents, "entity", "level").collect()}
    first, second = out[MON], out[D(2020, 1, 13)]
    assert first.score == pytest.approx(3 * 60 / 100 / 3) and first.share_exposed == pytest.approx(0.3) and not first.exposed
    assert second.score == pytest.approx(2 / 3) and second.weight_exposed == 0 and second.level == "probable"


def test_sum_of_nothing_is_zero(spark):
    df = frame(spark, weeks([None, None], step=1))
    row = aggregate.weekly_agg(df, "entity", "week_start", {"s": aggregate.sum_or_zero("x"), "m": F.avg("x")}, "w").first()
    assert row.s == 0.0 and row.m is None


def test_event_intensity_with_overlaps_and_bad_intervals(spark):
    rows = [("z", D(2019, 12, 30), D(2020, 1, 7), 2.0), ("z", D(2020, 1, 6), D(2020, 1, 6), 5.0), ("z", D(2020, 1, 9), D(2020, 1, 8), 9.0)]
    df = spark.createDataFrame(rows, "entity string, s date, e date, dai double")
    got = {r.week_start: r.dai for r in aggregate.event_intensity_weekly(df, "entity", "s", "e", "dai").collect()}
    assert got == {D(2019, 12, 30): 2.0, MON: 5.0}


def test_tercile_levels(spark):
    values = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None]
    out = score.tercile_level(frame(spark, weeks(values)), "x", "lvl", "entity", bounded=True).orderBy("week_start")
    assert [r.lvl for r in out.collect()] == [0, 1, 1, 2, 2, 3, 3, 0]


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(3)
    n = 300
    pdf = pd.DataFrame({"entity": np.repeat(["a", "b"], n // 2), "x1": rng.normal(5, 2, n), "x2": rng.normal(0, 1, n),
                        "q": rng.integers(1, 5, n).astype(float)})
    pdf["y"] = 3 + 2 * pdf.x1 - pdf.x2 + 0.3 * pdf.q + rng.normal(0, 1, n)
    terms = ["x1", "x2", "q"]
    fits = models.ols(spark.createDataFrame(pdf), terms, "y", "entity")
    coefs = models.coefficients(fits, "entity").toPandas()
    for e, part in pdf.groupby("entity"):
        X = np.column_stack([np.ones(len(part)), part[terms]])
        beta, rss, *_ = np.linalg.lstsq(X, part.y, rcond=None)
        se = np.sqrt(rss[0] / (len(part) - 4) * np.diag(np.linalg.inv(X.T @ X)))
        got = coefs[coefs.entity == e].set_index("term").loc[["intercept", *terms]]
        np.testing.assert_allclose(got.coef.to_numpy(float), beta, rtol=1e-8)
        np.testing.assert_allclose(got.se.to_numpy(float), se, rtol=1e-8)
        row = fits.where(F.col("entity") == e).first()
        m = len(part)
        assert row.aic == pytest.approx(m * math.log(2 * math.pi * rss[0] / m) + m + 8)
        assert row.bic == pytest.approx(m * math.log(2 * math.pi * rss[0] / m) + m + 4 * math.log(m))


def test_absorbed_effect_equals_dummies(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"entity": "a", "x": rng.normal(0, 1, 200), "m": rng.integers(1, 8, 200)})
    pdf["y"] = 1.5 * pdf.x + pdf.m ** 2 + rng.normal(0, 1, 200)
    df = spark.createDataFrame(pdf)
    absorbed = models.coefficients(models.ols(df, ["x"], "y", absorb="m")).first()
    dummies, names = models.one_hot_terms(df, F.col("m"), list(range(1, 8)), "m_")
    full = models.coefficients(models.ols(dummies, ["x", *names], "y")).where("term = 'x'").first()
    assert absorbed.coef == pytest.approx(full.coef) and absorbed.se == pytest.approx(full.se)


def test_vif(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=200), rng.normal(size=200)
    pdf = pd.DataFrame({"a": a, "b": b, "c": a + b + 0.1 * rng.normal(size=200)})
    got = {r.column: r for r in models.vif(spark.createDataFrame(pdf), ["a", "b", "c"]).collect()}
    want = np.diag(np.linalg.inv(pdf.corr()))
    for i, c in enumerate("abc"):
        assert got[c].vif == pytest.approx(want[i], rel=1e-6)
    assert got["c"].over_10


@pytest.mark.parametrize("value,want", [
    (pvalues.t_two_sided(2.228138852, 10), 0.05), (pvalues.t_two_sided(1.959963985, 1e7), 0.05),
    (pvalues.f_upper(4.964602744, 1, 10), 0.05), (pvalues.f_upper(3.708264819, 3, 10), 0.05),
    (pvalues.t_critical(10), 2.228138852), (pvalues.beta_cdf(2, 3, 0.5), 0.6875), (pvalues.t_two_sided(0, 5), 1.0),
])
def test_known_tail_probabilities(value, want):
    assert value == pytest.approx(want, rel=1e-6)


def test_p_columns_pass_null(spark):
    df = spark.createDataFrame([(2.228138852, 10.0), (None, 10.0)], "t double, d double").coalesce(1)
    got = [r[0] for r in df.select(pvalues.p_t("t", "d")).collect()]
    assert got[0] == pytest.approx(0.05, rel=1e-6) and got[1] is None
    assert spark.range(1).select(pvalues.p_norm(F.lit(1.959963985))).first()[0] == pytest.approx(0.05, rel=1e-6)


def test_anova_published_table(spark):
    """n, mean and std of four published groups give the published F and eta squared."""
    rows = [("none", 355, 138.18028169014084, 21.676646678392462), ("possible", 82, 139.59756097560975, 20.328693918863888),
            ("probable", 36, 146.30555555555554, 24.257922940697654), ("intense", 49, 155.3673469387755, 22.75567134213563)]
    groups = spark.createDataFrame([(lv, n, m, s * s * (n - 1) / n) for lv, n, m, s in rows], "level string, n long, m double, v double")
    row = stats.anova_from_moments(groups).first()
    assert row.f == pytest.approx(9.86899029766036, rel=1e-9)
    assert row.eta2 == pytest.approx(0.05406609569761514, rel=1e-9)
    assert row.p == pytest.approx(2.443876608510581e-06, rel=1e-6)
    labels = spark.range(1).select(stats.effect_label(F.lit(row.eta2)), stats.significance_label(F.lit(row.p))).first()
    assert tuple(labels) == ("small", "p<0.001")


def test_effect_per_100k_published_table(spark):
    rows = [("gran_canaria", 855000, 132.83802816901408, 150.80434782608697, 2.101), ("tenerife", 920000, 138.18028169014084, 155.3673469387755, 1.868),
            ("lanzarote", 155000, 15.765395894428153, 17.926829268292682, 1.394), ("la_palma", 83000, 15.748677248677248, 16.869565217391305, 1.35),
            ("gomera", 22000, 4.083710407239819, 4.142857142857143, 0.269), ("fuerteventura", 120000, 9.873015873015873, 10.105263157894736, 0.194)]
    df = spark.createDataFrame([r[:4] for r in rows], "entity string, population long, mean_bottom double, mean_top double")
    got = {r.entity: r.delta_per_100k for r in report.effect_from_means(df, 2_200_000).collect()}
    assert got == {r[0]: r[4] for r in rows}


def test_bootstrap_is_repeatable_and_centred(spark):
    rng = np.random.default_rng(11)
    rows = [("a", MON + dt.timedelta(days=7 * i), float(rng.normal(10 + 3 * (i % 4 == 0), 2)), int(i % 4 == 0)) for i in range(200)]
    df = frame(spark, rows, "entity string, week_start date, y double, f int")
    reps = resample.bootstrap_diff(df, "f", "y", "entity", 200, 42, median=True)
    first = reps.orderBy("b").toPandas()
    again = resample.bootstrap_diff(df.repartition(5), "f", "y", "entity", 200, 42, median=True).orderBy("b").toPandas()
    pd.testing.assert_frame_equal(first, again)
    pdf = pd.DataFrame(rows, columns=["e", "w", "y", "f"])
    a, b = pdf.y[pdf.f == 1], pdf.y[pdf.f == 0]
    se = math.sqrt(a.var() / len(a) + b.var() / len(b))
    assert first.delta_mean.mean() == pytest.approx(a.mean() - b.mean(), abs=0.2 * se * 3)
    assert first.delta_mean.std() == pytest.approx(se, rel=0.25)


def test_extreme_audit_runs_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(e, MON + dt.timedelta(days=7 * i), float(rng.gamma(2, 10)), float(rng.poisson(20))) for e in "ab" for i in range(260)]
    df = frame(spark, rows, "entity string, week_start date, x double, y double")
    out = resample.extreme_audit(df, "x", "y", "entity", 0.9, replicates=60).collect()
    assert len(out) == 2
    for r in out:
        pdf = pd.DataFrame([x[1:] for x in rows if x[0] == r.entity], columns=["w", "x", "y"])
        assert r.n_extreme_weeks == (pdf.x > pdf.x.quantile(0.9)).sum()
        assert r.ci_week_low < r.delta_mean < r.ci_week_high and r.ci_episode_n > 0


def test_quality_contract(spark):
    good = frame(spark, weeks([1.0, 2.0]))
    assert quality.assert_panel(good, "entity") is good
    for bad in (good.unionByName(good), good.withColumn("week_start", F.date_add("week_start", 1))):
        with pytest.raises(ValueError):
            quality.assert_panel(bad, "entity")
    with pytest.raises(ValueError, match="missing columns"):
        quality.require_columns(good, ["nope"], "t")
    with pytest.raises(ValueError):
        quality.assert_one_to_one(good, good.unionByName(good), ["entity", "week_start"])


def test_traffic_light(spark):
    df = spark.createDataFrame([(0.5, 0, 1.0), (0.5, 1, 1.0), (6.0, 0, 0.0), (0.0, 0, 11.0), (3.0, 0, 0.0)], "n double, d int, m double").coalesce(1)
    got = [r[0] for r in df.select(quality.traffic_light(F.col("n"), F.col("d"), F.col("m"))).collect()]
    assert got == ["green", "yellow", "red", "red", "yellow"]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 30)), min_size=1, max_size=40, unique=True))
def test_completed_panels_satisfy_the_contract(spark, cells):
    rows = [(e, MON + dt.timedelta(days=7 * i), 1.0) for e, i in cells]
    full = calendar.complete_calendar(frame(spark, rows), "entity", fills={"x": 0.0}, missing_flag="gap")
    quality.assert_panel(full, "entity")
    out = quality.check_complete(full, "entity").collect()
    assert all(r.complete for r in out)
    assert full.where("gap = 0").count() == len(rows)


def test_calendar_with_fixed_bounds(spark):
    rows = weeks([1.0, 2.0], "in", MON, 21) + weeks([5.0], "before", D(2019, 1, 7)) + weeks([6.0], "after", D(2021, 1, 4))
    rows += weeks([7.0, 8.0], "across", D(2019, 12, 30), 70)
    full = calendar.complete_calendar(frame(spark, rows), "entity", start="2019-12-30", end="2020-02-03", missing_flag="gap")
    got = full.toPandas().sort_values(["entity", "week_start"])
    assert got.groupby("entity").size().to_dict() == {"in": 6, "before": 6, "after": 6, "across": 6}
    assert got[got.gap == 0].x.to_list() == [7.0, 1.0, 2.0]
    assert got.week_start.min() == D(2019, 12, 30) and got.week_start.max() == D(2020, 2, 3)


def test_two_level_fill_keeps_empty_levels(spark):
    df = spark.createDataFrame([("none", 1.0), ("none", 3.0), ("intense", 5.0)], "level string, y double")
    got = {r.level: (r.n, r["mean"], r.median) for r in report.outcome_by_level(df, "level", "y").collect()}
    assert got == {"none": (2, 2.0, 2.0), "possible": (0, None, None), "probable": (0, None, None), "intense": (1, 5.0, 5.0)}


def test_skew_matches_pandas(spark, skewed):
    row = report.dist_stats(spark.createDataFrame(skewed), "v").first()
    assert row["skew"] == pytest.approx(skewed.v.skew()) and row.p95 == pytest.approx(skewed.v.quantile(0.95))


def test_constant_series_give_null(spark):
    rows = weeks([2.0] * 6)
    df = frame(spark, rows).withColumn("y", F.unix_date("week_start").cast("double"))
    assert stats.corr_test(df, "x", "y", "entity").first().r is None
    assert stats.linreg(df, "x", "y").first().slope is None
    assert all(r.r is None for r in stats.lag_corr(df, "x", "y", [0, 1], [1], "entity").collect())
    assert report.dist_stats(df, "x").first().iqr == 0.0
    flat = models.ols(df, ["y"], "x", "entity").first()
    assert flat.r2 is None and flat.n == 6


def test_ties_never_prefer_a_missing_value(spark):
    df = spark.createDataFrame([("k", 1, None, "b"), ("k", 1, 10.0, "a"), ("j", 2, 5.0, None), ("j", 2, 7.0, None)], "k string, o int, v double, s string")
    first = {r.k: r.v for r in dedup.dedup_first(df, "k", "o").collect()}
    last = {r.k: r.v for r in dedup.dedup_last(df, "k", "o").collect()}
    assert first == {"k": 10.0, "j": 5.0} and last == {"k": 10.0, "j": 7.0}
    assert {r.k: r.s for r in dedup.dedup_first(df, "k", "o", ties="s").collect()}["k"] == "a"


def test_tails_of_large_samples():
    import math

    assert pvalues.t_two_sided(2, 1e12) == pytest.approx(math.erfc(math.sqrt(2)), rel=1e-9)
    assert pvalues.t_two_sided(10, 1e12) == pytest.approx(math.erfc(10 / math.sqrt(2)), rel=1e-8)
    assert pvalues.f_upper(1, 1e9, 1e10) == pytest.approx(0.5, abs=1e-5) and pvalues.f_upper(1, 1e8, 1e8) == pytest.approx(0.5, abs=1e-9)
    assert pvalues.t_two_sided(1, 1) == pytest.approx(0.5, rel=1e-12) and pvalues.t_critical(1) == pytest.approx(12.7062047361747, rel=1e-12)


def test_unknown_stays_unknown(spark):
    row = spark.range(1).select(
        stats.effect_label(F.lit(None).cast("double")).alias("e"), stats.significance_label(F.lit(None).cast("double")).alias("s"),
        pvalues.p_t(F.lit(None).cast("double"), F.lit(5.0)).alias("p"), pvalues.normal_quantile(F.lit(1.0)).alias("q"),
    ).first()
    assert tuple(row) == (None, None, None, None)


def test_interpolate_edges_and_runs(spark):
    from weekwise.operators.clean import interpolate

    df = spark.createDataFrame([("a", i, v, None) for i, v in enumerate([None, 2.0, None, None, 8.0, None])], "entity string, week_start int, v double, w double")
    rows = interpolate(df, ["v", "w"], "entity").orderBy("week_start").collect()
    assert [r.v for r in rows] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0] and {r.w for r in rows} == {0.0}


def test_episodes_among_unknown_rows_stay_in_the_draw(spark):
    """The episode in the first two weeks has no known rows; a draw that picks it alone leaves too few exposed weeks."""
    flags = [1, 0, 0, 0, 0, 1] + [0] * 44
    rows = [("a", dt.date(2020, 1, 6) + dt.timedelta(weeks=i), float(i % 7), f, {0: 1, 5: 2}.get(i), flags[i - 2] if i > 1 else None) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "entity string, week_start date, y double, is_extreme int, episode_id int, ext_lag int")
    some = resample.bootstrap_episodes(df, "y", "entity", 200, min_exposed=1, min_rest=1).count()
    every = resample.bootstrap_episodes(df, "y", "entity", 200, min_exposed=0, min_rest=1).count()
    assert 110 < some < 190 and every == 200  # about three quarters of the draws hold the later episode


def test_late_rows_count(spark, tmp_path):
    from weekwise.streaming import incremental as inc

    measures = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("mean", F.col("v")), "hi": ("max", F.col("v")), "days": ("days", F.col("ts"))}
    kinds = {k: v[0] for k, v in measures.items()}
    D = dt.datetime
    runs = [[("a", D(2024, 1, 2), 1.0), ("a", D(2024, 6, 5), 2.0)], [("a", D(2024, 1, 3), 5.0), ("a", D(2024, 6, 6), 3.0)], [("a", D(2024, 1, 3), 0.5)]]
    for k, rows in enumerate(runs):
        spark.createDataFrame(rows, "e string, ts timestamp_ntz, v double").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("e string, ts timestamp_ntz, v double").parquet(str(tmp_path / "in"))
        inc.ingest(stream, "e", "ts", measures, str(tmp_path / "out"), str(tmp_path / "cp"))
        if k == 1:
            inc.compact(spark, str(tmp_path / "out"), "e", kinds)
    got = {r.week_start: (r.n, r.s, r.m, r.hi, r.days) for r in inc.current(spark, str(tmp_path / "out"), "e", kinds).collect()}
    assert got == {dt.date(2024, 1, 1): (3, 6.5, 6.5 / 3, 5.0, 2), dt.date(2024, 6, 3): (2, 5.0, 2.5, 3.0, 2)}


def test_unpublished_parts_are_invisible(spark, tmp_path, monkeypatch):
    """A compaction, or a batch, that dies between its files and the manifest leaves the table as it was; a batch run again counts once."""
    from weekwise.streaming import incremental as inc

    path, measures = str(tmp_path / "t"), {"n": ("count", F.lit(1)), "s": ("sum", F.col("v"))}
    kinds = {k: v[0] for k, v in measures.items()}

    def batch(values, batch_id):
        rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 2), v) for v in values], "e string, ts timestamp_ntz, v double")
        inc._publish(inc.weekly_partials(rows, "e", "ts", measures), path, batch_id, batch_id)

    def table():
        return [(r.n, r.s) for r in inc.current(spark, path, "e", kinds).collect()]

    with pytest.raises(Exception):
        inc.current(spark, path, "e", kinds)
    batch([1.0, 2.0], 0)
    batch([4.0], 1)
    batch([4.0], 1)  # the same batch after a restart
    assert table() == [(3, 7.0)]

    def dies(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(inc, "_add_to_manifest", dies)
        for work in (lambda: inc.compact(spark, path, "e", kinds), lambda: batch([99.0], 2)):
            with pytest.raises(RuntimeError):
                work()
    assert table() == [(3, 7.0)]
    (tmp_path / "t" / "parts" / "half-written").mkdir()
    reader = inc.current(spark, path, "e", kinds)  # planned on the parts, read after the base is there
    inc.compact(spark, path, "e", kinds)
    inc.compact(spark, path, "e", kinds)
    assert table() == [(3, 7.0)] == [(r.n, r.s) for r in reader.collect()]
    assert len(inc._cover(spark, path)[0]) == 1 and spark.read.json(f"{path}/manifest").where("first_batch < 0").count() == 1
    batch([8.0], 2)
    assert table() == [(4, 15.0)] and len(inc._cover(spark, path)[0]) == 2


@pytest.mark.parametrize("recompute", [True, False])
@pytest.mark.parametrize("lag", [0, 2])
def test_episode_weights_equal_sequences_laid_out(spark, monkeypatch, recompute, lag):
    """Replicates by weights against every replicate written out week by week, over several blocks and steps."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(resample, "BLOCK", 17)
    monkeypatch.setattr(resample, "CELLS", 700)
    rows, n, many = [], 90, 0
    flags = (rng.random(n) < 0.3).astype(int)
    for i in range(n):
        many += flags[i] and (i == 0 or not flags[i - 1])
        known = None if i < 2 else 1
        value = None if i == 40 else float(rng.normal())
        rows.append(("a", dt.date(2020, 1, 6) + dt.timedelta(weeks=i), value, int(flags[i]), int(many) if flags[i] else None, known))
    df = spark.createDataFrame(rows, "entity string, week_start date, y double, is_extreme int, episode_id int, ext_lag int")
    got = resample.bootstrap_episodes(df, "y", "entity", 60, lag, recompute=recompute, min_exposed=3, min_rest=5).toPandas().set_index("b").sort_index()

    draws = resample.hashed_draws(42, "a", 2, np.arange(1, 61), many, many)
    own = [r for r in rows if r[5]]
    want = {}
    for b, chosen in enumerate(draws, 1):
        laid = []
        for r in own:
            laid += [r] * (int((chosen == r[4] - 1).sum()) if r[3] else 1)
        x = pd.DataFrame({"y": [np.nan if r[2] is None else r[2] for r in laid], "s": [r[1].isocalendar().week for r in laid]})
        x["hit"] = pd.Series([r[3] for r in laid]).shift(lag)
        x = x.dropna(subset="hit")
        hole = x.y.isna().any()
        v = x.y - x.groupby("s").y.transform("mean") if recompute else x.y
        n1, n0 = int((x.hit == 1).sum()), int((x.hit == 0).sum())
        if n1 >= 3 and n0 >= 5:
            want[b] = (n1, n0, np.nan if hole else v[x.hit == 1].mean() - v[x.hit == 0].mean())
    assert list(got.index) == list(want) and len(want) > 30
    want = np.array(list(want.values()))
    assert (got[["n1", "n0"]].to_numpy() == want[:, :2]).all() and np.allclose(got.delta_mean.to_numpy(), want[:, 2], equal_nan=True)
