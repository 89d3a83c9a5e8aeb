"""Correlations, tests and effect sizes from sums that combine map-side.

The heavy part of every statistic is one aggregate (or a ladder, for ranks); p-values are computed on
the aggregated rows. ``with_p=False`` leaves the p-value out and with it the only Python step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from weekwise.functions.numbers import LEVELS

from ._util import add_group_values, as_list, col, join_nullsafe, stack_rows
from .ordered import ladder, quantiles
from .pvalues import p_f, p_norm, p_t
from .window import add_lags, add_leads, anomaly


def _both(a: str, b: str) -> Column:
    return col(a).isNotNull() & col(b).isNotNull()


def pearson(a: str, b: str) -> Column:
    """Pearson r over complete pairs; NULL (not an error, as ``corr`` raises) where a side is constant."""
    x, y = (F.when(_both(a, b), col(c).cast("double")) for c in (a, b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def corr_matrix(df: DataFrame, cols: Sequence[str], by=(), listwise: bool = False) -> DataFrame:
    """Long matrix ``(a, b, r, n)`` over all pairs from one aggregate.

    Pairs are complete pairwise; ``listwise=True`` drops rows with any NULL first.
    """
    rows = df.dropna(subset=list(cols)) if listwise else df
    pairs = list(combinations(range(len(cols)), 2))
    keys = as_list(by)
    one = rows.groupBy(*map(col, keys)).agg(*[
        e for i, j in pairs for e in (
            pearson(cols[i], cols[j]).alias(f"__r{i}_{j}"),
            F.count_if(_both(cols[i], cols[j])).alias(f"__n{i}_{j}"))
    ])
    long = stack_rows(one, keys, "a", {
        f"{i}_{j}": {"r": F.col(f"__r{i}_{j}"), "n": F.col(f"__n{i}_{j}")} for i, j in pairs
    })
    names = F.array(*[F.lit(c) for c in cols])
    i, j = F.split("a", "_")[0].cast("int"), F.split("a", "_")[1].cast("int")
    return long.select(*map(col, keys), F.get(names, i).alias("a"), F.get(names, j).alias("b"), "r", "n")


def spearman(df: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """Spearman r: Pearson r of average ranks over complete pairs.

    Equal pairs collapse to one row with a count before anything is ranked, and the mean rank is known
    in advance, so the centred sums are exact weighted sums over those rows.
    """
    keys = as_list(by)
    counted = df.where(_both(a, b)).groupBy(*map(col, keys), col(a), col(b)).agg(F.count("*").alias("__w"))
    pairs = counted
    for value, name in ((a, "__da"), (b, "__db")):
        steps = ladder(counted, value, keys, {"n": F.sum("__w")}).select(
            *map(col, keys), col(value),
            (F.col("n_before") + (F.col("n") + 1) / 2 - (F.col("n_total") + 1) / 2).alias(name),
        )
        pairs = join_nullsafe(pairs, steps, [*keys, value])
    da, db, w = F.col("__da"), F.col("__db"), F.col("__w")
    return pairs.groupBy(*map(col, keys)).agg(
        F.try_divide(F.sum(w * da * db), F.sqrt(F.sum(w * da * da)) * F.sqrt(F.sum(w * db * db))).alias("rho"),
        F.sum(w).alias("n"),
    )


def corr_test(df: DataFrame, a: str, b: str, by=(), with_p: bool = True) -> DataFrame:
    """Pearson r with n, t and two-sided p."""
    out = df.groupBy(*map(col, as_list(by))).agg(
        pearson(a, b).alias("r"), F.count_if(_both(a, b)).alias("n")
    )
    out = out.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0)))))
    return out.withColumn("p", p_t("t", F.col("n") - 2)) if with_p else out


def linreg(df: DataFrame, x: str, y: str, by=(), with_p: bool = True) -> DataFrame:
    """Straight-line fit: slope, intercept, r, n, standard error of the slope, t and p."""
    rows = df.where(_both(x, y))
    sxx, sxy = F.var_pop(col(x)), F.covar_pop(col(x).cast("double"), col(y).cast("double"))
    slope = F.try_divide(sxy, sxx)
    out = rows.groupBy(*map(col, as_list(by))).agg(
        F.count("*").alias("n"),
        slope.alias("slope"),
        (F.avg(col(y)) - slope * F.avg(col(x))).alias("intercept"),
        pearson(x, y).alias("r"),
        F.sqrt(F.try_divide(F.greatest(F.var_pop(col(y)) - slope * sxy, F.lit(0.0)), (F.count("*") - 2) * sxx)).alias("stderr"),
    )
    out = out.withColumn("t", F.try_divide("slope", "stderr"))
    return out.withColumn("p", p_t("t", F.col("n") - 2)) if with_p else out


def lag_corr(
    df: DataFrame, x: str, y: str, lags: Sequence[int], leads: Sequence[int], entity,
    key: str = "week_start", season: Column | None = None, pooled: bool = False,
) -> DataFrame:
    """Correlation of the outcome with the exposure shifted by rows: ``(shift, r, n)`` per entity.

    ``season`` removes the seasonal mean of both series first. ``pooled`` correlates over all entities
    together, the shifts staying inside each entity. Rows with a NULL are dropped before shifting.
    """
    keys = as_list(entity)
    rows = df.where(_both(x, y)).select(*map(col, keys), col(key), col(x), col(y))
    if season is not None:
        rows = anomaly(rows, [x, y], season, keys).select(
            *map(col, keys), col(key), col(f"{x}_anom").alias(x), col(f"{y}_anom").alias(y)
        )
    shifted = add_leads(add_lags(rows, x, lags, keys, key), x, leads, keys, key)
    names = {f"lag{k}": f"{x}_lag{k}" for k in lags} | {f"lead{k}": f"{x}_lead{k}" for k in leads}
    by = [] if pooled else keys
    one = shifted.groupBy(*map(col, by)).agg(*[
        e for s, c in names.items() for e in (pearson(c, y).alias(f"__r_{s}"), F.count(col(c)).alias(f"__n_{s}"))
    ])
    return stack_rows(one, by, "shift", {s: {"r": F.col(f"__r_{s}"), "n": F.col(f"__n_{s}")} for s in names})


def anova(df: DataFrame, level: str, y: str, by=(), levels: Sequence[str] | None = None, with_p: bool = True) -> DataFrame:
    """One-way analysis of variance: F, p and eta squared.

    The groups are the known levels; eta squared divides by the total sum of squares of *all* known
    outcomes, around their grand mean, whether or not their level is known.
    """
    keys = as_list(by)
    rows = df.where(col(y).isNotNull())
    known = col(level).isin(*levels) if levels else col(level).isNotNull()
    groups = rows.groupBy(*map(col, keys), col(level)).agg(
        F.count("*").alias("n"), F.avg(col(y)).alias("m"), F.var_pop(col(y)).alias("v")
    ).withColumn("__in", F.coalesce(known, F.lit(False)))
    return anova_from_moments(groups, keys, with_p)


def anova_from_moments(groups: DataFrame, by=(), with_p: bool = True) -> DataFrame:
    """ANOVA from per-group ``n``, ``m`` (mean), ``v`` (population variance); ``__in`` = counts as a group."""
    keys = as_list(by)
    if "__in" not in groups.columns:
        groups = groups.withColumn("__in", F.lit(True))
    inside = F.col("__in")

    def weighted(cond: Column) -> Column:
        return F.try_divide(F.sum(F.when(cond, F.col("n") * F.col("m"))), F.sum(F.when(cond, F.col("n"))))

    means = groups.groupBy(*map(col, keys)).agg(
        weighted(F.lit(True)).alias("__grand"), weighted(inside).alias("__mean_in")
    )
    one = add_group_values(groups, means, keys).groupBy(*map(col, keys)).agg(
        F.count_if(inside).alias("k"),
        F.sum(F.when(inside, F.col("n"))).alias("n"),
        F.sum(F.when(inside, F.col("n") * F.pow(F.col("m") - F.col("__mean_in"), 2))).alias("ss_between"),
        F.sum(F.when(inside, F.col("n") * F.col("v"))).alias("ss_within"),
        F.sum(F.when(inside, F.col("n") * F.pow(F.col("m") - F.col("__grand"), 2))).alias("__ssb_grand"),
        F.sum(F.col("n") * (F.col("v") + F.pow(F.col("m") - F.col("__grand"), 2))).alias("ss_total"),
    )
    out = one.withColumns({
        "f": F.try_divide(F.try_divide("ss_between", F.col("k") - 1), F.try_divide("ss_within", F.col("n") - F.col("k"))),
        "eta2": F.try_divide("__ssb_grand", "ss_total"),
    }).drop("__ssb_grand")
    return out.withColumn("p", p_f("f", F.col("k") - 1, F.col("n") - F.col("k"))) if with_p else out


# Conventional bounds of eta squared and of the p-value.
def effect_label(eta2) -> Column:
    v = F.col(eta2) if isinstance(eta2, str) else eta2
    return F.when(v >= 0.14, "large").when(v >= 0.06, "medium").when(v >= 0.01, "small").when(v.isNotNull(), "negligible")


def significance_label(p) -> Column:
    v = F.col(p) if isinstance(p, str) else p
    return F.when(v < 0.001, "p<0.001").when(v < 0.01, "p<0.01").when(v < 0.05, "p<0.05").when(v.isNotNull(), "n.s.")


def _two_sample(out: DataFrame, equal_var: bool, with_p: bool) -> DataFrame:
    """t statistic from n1, m1, v1, n0, m0, v0 (sample variances)."""
    a, b = F.try_divide("v1", "n1"), F.try_divide("v0", "n0")
    if equal_var:
        dof = F.col("n1") + F.col("n0") - 2
        pooled = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), dof)
        se = F.sqrt(pooled * (F.try_divide(F.lit(1.0), "n1") + F.try_divide(F.lit(1.0), "n0")))
    else:
        dof = F.try_divide(
            (a + b) * (a + b), F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("n0") - 1)
        )
        se = F.sqrt(a + b)
    out = out.withColumns({"delta": F.col("m1") - F.col("m0"), "dof": dof.cast("double"), "__se": se})
    out = out.withColumn("t", F.try_divide("delta", "__se")).drop("__se")
    return out.withColumn("p", p_t("t", "dof")) if with_p else out


def _split_moments(flag: Column, y: Column) -> list[Column]:
    out = []
    for tag in (1, 0):
        v = F.when(flag == tag, y)
        out += [F.count(v).alias(f"n{tag}"), F.avg(v).alias(f"m{tag}"), F.var_samp(v).alias(f"v{tag}")]
    return out


def ttest(df: DataFrame, flag: str, y: str, by=(), equal_var: bool = True, with_p: bool = True) -> DataFrame:
    """Two-sample t test of ``y`` between flag 1 and flag 0."""
    return _two_sample(
        df.groupBy(*map(col, as_list(by))).agg(*_split_moments(col(flag), col(y))), equal_var, with_p
    )


def pairwise_ttests(
    df: DataFrame, level: str, y: str, order: Sequence[str] = LEVELS, by=(), against: str | None = None,
    equal_var: bool = True, with_p: bool = True,
) -> DataFrame:
    """t tests between all pairs of levels, or between one level and every other; from one aggregate."""
    keys = as_list(by)
    one = df.groupBy(*map(col, keys)).agg(*[
        e for i, name in enumerate(order) for e in (
            F.count(F.when(col(level) == name, col(y))).alias(f"__n{i}"),
            F.avg(F.when(col(level) == name, col(y))).alias(f"__m{i}"),
            F.var_samp(F.when(col(level) == name, col(y))).alias(f"__v{i}"))
    ])
    at = {name: i for i, name in enumerate(order)}
    pairs = [(against, o) for o in order if o != against] if against else [(b, a) for a, b in combinations(order, 2)]
    long = stack_rows(one, keys, "pair", {
        f"{a} vs {b}": {
            "n1": F.col(f"__n{at[a]}"), "m1": F.col(f"__m{at[a]}"), "v1": F.col(f"__v{at[a]}"),
            "n0": F.col(f"__n{at[b]}"), "m0": F.col(f"__m{at[b]}"), "v0": F.col(f"__v{at[b]}"),
        } for a, b in pairs
    })
    return _two_sample(long, equal_var, with_p)


def welch_table(
    df: DataFrame, flags: Sequence[str], outcomes: Sequence[str], by=(), medians: bool = True, with_p: bool = True
) -> DataFrame:
    """Welch tests for every extreme flag and outcome: counts, means, medians, difference, t, p.

    One aggregate yields all moments; medians come from a ladder over the unpivoted values.
    """
    keys = as_list(by)
    cells = [(f, y) for f in flags for y in outcomes]
    one = df.groupBy(*map(col, keys)).agg(*[
        e.alias(f"__{i}_{name}") for i, (f, y) in enumerate(cells)
        for name, e in zip(("n1", "m1", "v1", "n0", "m0", "v0"), _split_moments(col(f), col(y)))
    ])
    long = stack_rows(one, keys, "__cell", {
        str(i): {"flag": F.lit(f), "outcome": F.lit(y),
                 **{m: F.col(f"__{i}_{m}") for m in ("n1", "m1", "v1", "n0", "m0", "v0")}}
        for i, (f, y) in enumerate(cells)
    }).drop("__cell")
    out = _two_sample(long, False, with_p)
    if not medians:
        return out
    values = df.select(*map(col, keys), F.explode(F.array(*[
        F.struct(F.lit(f).alias("flag"), F.lit(y).alias("outcome"), col(f).cast("int").alias("on"),
                 col(y).cast("double").alias("value")) for f, y in cells
    ])).alias("__c")).select(*map(col, keys), "__c.*").where("on is not null and value is not null")
    group = [*keys, "flag", "outcome"]
    med = quantiles(values, "value", {"median": 0.5}, [*group, "on"])
    wide = med.groupBy(*map(col, group)).agg(
        F.max(F.when(F.col("on") == 1, F.col("median"))).alias("median1"),
        F.max(F.when(F.col("on") == 0, F.col("median"))).alias("median0"),
    )
    return join_nullsafe(out, wide, group)


def mannwhitney(df: DataFrame, flag: str, x: str, by=(), with_p: bool = True) -> DataFrame:
    """Mann-Whitney U of flag 1 against flag 0: tie-corrected normal approximation with continuity.

    Rank sums come straight from the ladder's counts, so no row is ever ranked or joined.
    """
    keys = as_list(by)
    rows = df.where(_both(flag, x))
    steps = ladder(rows, x, keys, {"n": F.count("*"), "n1": F.count_if(col(flag) == 1)})
    n, before = F.col("n"), F.col("n_before")
    out = steps.groupBy(*map(col, keys)).agg(
        F.max("n1_total").alias("n1"),
        (F.max("n_total") - F.max("n1_total")).alias("n0"),
        F.sum(F.col("n1") * (before + (n + 1) / 2)).alias("__r1"),
        F.sum(n.cast("double") * (n.cast("double") * n - 1)).alias("__ties"),
    )
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    total = a + b
    u = F.col("__r1") - a * (a + 1) / 2
    sd = F.sqrt(a * b / 12 * ((total + 1) - F.try_divide("__ties", total * (total - 1))))
    out = out.withColumn("u", u)
    out = out.withColumn("z", F.try_divide(F.greatest(F.abs(F.col("u") - a * b / 2) - 0.5, F.lit(0.0)), sd)).drop(
        "__r1", "__ties"
    )
    return out.withColumn("p", p_norm("z")) if with_p else out


def roc_curve(df: DataFrame, score: str, label: str, by=()) -> DataFrame:
    """Operating point of every distinct threshold (``score >= threshold`` is positive)."""
    keys = as_list(by)
    rows = df.where(_both(score, label))
    steps = ladder(rows, score, keys, {"pos": F.count_if(col(label) == 1), "neg": F.count_if(col(label) != 1)}, True)
    return steps.select(
        *map(col, keys), col(score).alias("threshold"),
        (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"),
        "pos", "neg", "pos_before", "neg_before", "pos_total", "neg_total",
    ).withColumns({"tpr": F.try_divide("tp", "pos_total"), "fpr": F.try_divide("fp", "neg_total")})


def roc(df: DataFrame, score: str, label: str, by=()) -> DataFrame:
    """AUC (trapezoid over distinct thresholds), Youden threshold and its operating point."""
    keys = as_list(by)
    points = roc_curve(df, score, label, keys)
    area = F.sum(F.col("neg").cast("double") * (F.col("pos_before") + F.col("pos") / 2))
    best = F.max(F.struct((F.col("tpr") - F.col("fpr")).alias("youden"), "threshold", "tp", "fp"))
    out = points.groupBy(*map(col, keys)).agg(
        F.max("pos_total").alias("positives"), F.max("neg_total").alias("negatives"),
        area.alias("__area"), best.alias("__b"),
    )
    return out.select(
        *map(col, keys), "positives", "negatives",
        F.try_divide("__area", F.col("positives").cast("double") * F.col("negatives")).alias("auc"),
        F.col("__b.threshold").alias("threshold"), F.col("__b.youden").alias("youden"),
        F.try_divide(F.col("__b.tp"), "positives").alias("sensitivity"),
        (1 - F.try_divide(F.col("__b.fp"), "negatives")).alias("specificity"),
    )


def confusion(df: DataFrame, predicted: Column, label: str, by=()) -> DataFrame:
    """Confusion counts with precision, recall, F1 and accuracy of a binary prediction."""
    truth = col(label) == 1
    rows = df.where(col(label).isNotNull()).withColumn("__p", predicted).where("__p is not null")
    p = F.col("__p")
    out = rows.groupBy(*map(col, as_list(by))).agg(
        F.count_if(p & truth).alias("tp"), F.count_if(p & ~truth).alias("fp"),
        F.count_if(~p & truth).alias("fn"), F.count_if(~p & ~truth).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({
        "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
    })


def compare_scores(a: DataFrame, b: DataFrame, keys, score: str = "score") -> DataFrame:
    """Two versions of one score: moments of each, correlation and mean difference over common keys."""
    names = as_list(keys)
    both = a.select(*names, col(score).alias("a")).join(b.select(*names, col(score).alias("b")), names)
    return both.agg(
        F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
        F.stddev_samp("a").alias("std_a"), F.stddev_samp("b").alias("std_b"), pearson("a", "b").alias("r"),
        F.avg(F.col("b") - F.col("a")).alias("mean_diff"), F.max(F.abs(F.col("b") - F.col("a"))).alias("max_abs_diff"),
    )


def proxy_checks(df: DataFrame, score: str, flags: Sequence[str], signals: Sequence[str]) -> DataFrame:
    """Check of a score against independent signals.

    For 0/1 flags: count, mean and median of the score by flag value; for continuous signals: r and n.
    """
    pairs = df.where(col(score).isNotNull()).select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("proxy"), col(f).cast("int").alias("value"), col(score).cast("double").alias("score"))
        for f in flags
    ])).alias("__p")).select("__p.*").where("value is not null")
    by_flag = join_nullsafe(
        pairs.groupBy("proxy", "value").agg(F.count("*").alias("n"), F.avg("score").alias("mean")),
        quantiles(pairs, "score", {"median": 0.5}, ["proxy", "value"]), ["proxy", "value"],
    )
    one = df.agg(*[
        e for i, s in enumerate(signals) for e in (
            pearson(score, s).alias(f"__r{i}"), F.count_if(_both(score, s)).alias(f"__n{i}"))
    ])
    by_signal = stack_rows(one, [], "proxy", {
        s: {"n": F.col(f"__n{i}"), "r": F.col(f"__r{i}")} for i, s in enumerate(signals)
    })
    return by_flag.unionByName(by_signal, allowMissingColumns=True)


def effect_by_scale(scales: Mapping[str, tuple[DataFrame, str, str]], with_p: bool = True) -> DataFrame:
    """Eta squared at several levels of a hierarchy; each entry is (table, level column, outcome)."""
    from .dedup import union_panels

    return union_panels([
        anova(df, level, y, with_p=with_p).withColumn("scale", F.lit(name)) for name, (df, level, y) in scales.items()
    ])


def findings(
    df: DataFrame, x: str, level: str, y: str, entity, lags: Sequence[int] = (0, 1, 2), key: str = "week_start",
    order: Sequence[str] = LEVELS, with_p: bool = True,
) -> DataFrame:
    """Per entity: the strongest lag by absolute r, F and eta squared, and top-minus-bottom difference."""
    keys = as_list(entity)
    table = lag_corr(df, x, y, lags, (), keys, key)
    best = table.groupBy(*map(col, keys)).agg(
        F.max_by(F.struct("shift", "r"), F.struct(F.abs("r"), F.col("shift"))).alias("__b")
    ).select(*map(col, keys), F.col("__b.shift").alias("best_shift"), F.col("__b.r").alias("best_r"))
    effect = anova(df, level, y, keys, with_p=with_p)
    delta = df.groupBy(*map(col, keys)).agg(
        (F.avg(F.when(col(level) == order[-1], col(y))) - F.avg(F.when(col(level) == order[0], col(y)))).alias("delta")
    )
    out = join_nullsafe(join_nullsafe(effect, best, keys), delta, keys)
    return out.withColumn("effect", effect_label("eta2"))


def excess_by_lag(df: DataFrame, flags: Sequence[str], y: str, ks: Sequence[int], entity, key: str = "week_start",
                  pooled: bool = True) -> DataFrame:
    """Mean outcome ``k`` rows after exposed and unexposed periods, per flag, and the difference."""
    keys = as_list(entity)
    ahead = add_leads(df, y, ks, keys, key)
    by = [] if pooled else keys
    names = [(f, k) for f in flags for k in ks]
    one = ahead.groupBy(*map(col, by)).agg(*[
        e.alias(f"__{i}_{m}") for i, (f, k) in enumerate(names)
        for m, e in zip(("n1", "m1", "v1", "n0", "m0", "v0"), _split_moments(col(f), col(f"{y}_lead{k}")))
    ])
    return stack_rows(one, by, "__c", {
        str(i): {"flag": F.lit(f), "lag_weeks": F.lit(k), "n_exposed": F.col(f"__{i}_n1"),
                 "mean_unexposed": F.col(f"__{i}_m0"), "mean_exposed": F.col(f"__{i}_m1"),
                 "diff": F.col(f"__{i}_m1") - F.col(f"__{i}_m0")}
        for i, (f, k) in enumerate(names)
    }).drop("__c")
