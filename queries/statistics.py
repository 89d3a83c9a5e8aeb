"""Correlations, tests and effect sizes. SQL has no distribution functions; the counterparts of the ``*_with_p`` queries
integrate the densities numerically."""

from pyspark.sql import functions as F

from weekwise.operators import stats as st
from weekwise.operators.score import threshold_flags
from weekwise.operators.window import anomaly

from . import SQL, query
from .aggregates import ROLLUP, rolled
from .base import FULL, SCORED, full_panel, inner, on, rounded, scored, table, tidy, with_f_tail, with_normal_tail
from .reports import HOT, hot


def _pair(a: str, b: str) -> str:
    return f"""SELECT entity, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r,
      count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM full_panel GROUP BY entity"""


@query(rounded(on(FULL, " UNION ALL ".join([_pair("outcome", "exposure"), _pair("outcome", "peak"), _pair("exposure", "peak")])), "r"))
def correlation_matrix(spark, sf):
    return tidy(st.corr_matrix(full_panel(spark, sf), ["outcome", "exposure", "peak"], "entity"))


@query(rounded("""
  WITH x AS (SELECT l_returnflag, l_quantity AS a, l_discount AS b FROM lineitem),
  r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY a) + (count(*) OVER (PARTITION BY l_returnflag, a) - 1) / 2 AS ra,
          rank() OVER (PARTITION BY l_returnflag ORDER BY b) + (count(*) OVER (PARTITION BY l_returnflag, b) - 1) / 2 AS rb FROM x)
  SELECT l_returnflag, corr(ra, rb) AS rho, count(*) AS n FROM r GROUP BY 1""", "rho"))
def spearman_correlation(spark, sf):
    x = table(spark, sf, "lineitem", "l_returnflag", "l_quantity", "l_discount")
    return tidy(st.spearman(x, "l_quantity", "l_discount", "l_returnflag"))


def _shifts(x: str, y: str, src: str) -> str:
    w = "OVER (PARTITION BY entity ORDER BY week_start)"
    parts = [(f"lag{k}", f"lag({x}, {k}) {w}") for k in (0, 1, 2)] + [(f"lead{k}", f"lead({x}, {k}) {w}") for k in (1, 2)]
    cols = ", ".join(f"{e} AS {n}" for n, e in parts)
    rows = " UNION ALL ".join(f"SELECT entity, '{n}' AS shift, corr({n}, {y}) AS r, count({n}) AS n FROM sh GROUP BY entity" for n, _ in parts)
    return f", sh AS (SELECT entity, {y}, {cols} FROM {src}) {rows}"


@query(rounded(on(FULL, ", kn AS (SELECT * FROM full_panel WHERE exposure IS NOT NULL)" + _shifts("exposure", "outcome", "kn")), "r"))
def lead_lag_correlation(spark, sf):
    return tidy(st.lag_corr(full_panel(spark, sf), "exposure", "outcome", [0, 1, 2], [1, 2], "entity"))


@query(rounded(on(FULL, """, kn AS (SELECT entity, week_start, exposure - avg(exposure) OVER (PARTITION BY entity, weekofyear(week_start)) AS ea,
      outcome - avg(outcome) OVER (PARTITION BY entity, weekofyear(week_start)) AS oa FROM full_panel WHERE exposure IS NOT NULL)"""
  + _shifts("ea", "oa", "kn")), "r"))
def lead_lag_correlation_deseasonalised(spark, sf):
    return tidy(st.lag_corr(full_panel(spark, sf), "exposure", "outcome", [0, 1, 2], [1, 2], "entity", season=F.weekofyear("week_start")))


CORR_T = """SELECT entity, corr(exposure, outcome) AS r, count(exposure) AS n,
    corr(exposure, outcome) * sqrt((count(exposure) - 2) / (1 - corr(exposure, outcome) * corr(exposure, outcome))) AS t FROM full_panel GROUP BY entity"""


@query(rounded(on(FULL, CORR_T), "r t"))
def correlation_test(spark, sf):
    return tidy(st.corr_test(full_panel(spark, sf), "exposure", "outcome", "entity", with_p=False))


@query(rounded(with_f_tail(on(FULL, CORR_T), "t * t", "1", "n - 2"), "r t p"))
def correlation_test_with_p(spark, sf):
    return tidy(st.corr_test(full_panel(spark, sf), "exposure", "outcome", "entity"))


@query(rounded(on(FULL, """
  , f AS (SELECT entity, count(*) AS n, regr_slope(exposure, share) AS slope, regr_intercept(exposure, share) AS intercept, corr(share, exposure) AS r,
      sqrt(regr_syy(exposure, share) * (1 - corr(share, exposure) * corr(share, exposure)) / ((count(*) - 2) * regr_sxx(exposure, share))) AS stderr
      FROM full_panel WHERE exposure IS NOT NULL AND share IS NOT NULL GROUP BY entity)
  SELECT *, slope / stderr AS t FROM f"""), "slope intercept r stderr t"))
def linear_fit(spark, sf):
    return tidy(st.linreg(full_panel(spark, sf), "share", "exposure", "entity", with_p=False))


@query(rounded(with_f_tail(inner(SQL["linear_fit"]), "t * t", "1", "n - 2"), "slope intercept r stderr t p"))
def linear_fit_with_p(spark, sf):
    return tidy(st.linreg(full_panel(spark, sf), "share", "exposure", "entity"))


def _anova_sql(src: str, by: str, level: str, y: str) -> str:
    sel, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""
  , b AS (SELECT {sel}{level} AS lv, {y} AS y, avg({y}) OVER ({part}) AS gm, avg({y}) OVER (PARTITION BY {sel}{level}) AS m FROM {src} WHERE {y} IS NOT NULL AND {level} IS NOT NULL),
  s AS (SELECT {sel}count(DISTINCT lv) AS k, count(*) AS n, sum((m - gm) * (m - gm)) AS ss_between, sum((y - m) * (y - m)) AS ss_within,
        sum((y - gm) * (y - gm)) AS ss_total FROM b {group})
  SELECT *, (ss_between / (k - 1)) / (ss_within / (n - k)) AS f, ss_between / ss_total AS eta2 FROM s"""


@query(rounded(on(SCORED, _anova_sql("scored", "entity", "level", "peak")), "ss_between ss_within ss_total f eta2", 4))
def anova_by_entity(spark, sf):
    return tidy(st.anova(scored(spark, sf), "level", "peak", "entity", with_p=False), 4)


_LABELS = """SELECT *, CASE WHEN eta2 >= 0.14 THEN 'large' WHEN eta2 >= 0.06 THEN 'medium' WHEN eta2 >= 0.01 THEN 'small' WHEN eta2 IS NOT NULL THEN 'negligible' END AS effect,
  CASE WHEN p < 0.001 THEN 'p<0.001' WHEN p < 0.01 THEN 'p<0.01' WHEN p < 0.05 THEN 'p<0.05' WHEN p IS NOT NULL THEN 'n.s.' END AS significance FROM ({})"""


@query(rounded(_LABELS.format(with_f_tail(inner(SQL["anova_by_entity"]), "f", "k - 1", "n - k")), "ss_between ss_within ss_total f eta2 p", 4))
def anova_by_entity_with_p(spark, sf):
    out = st.anova(scored(spark, sf), "level", "peak", "entity")
    return tidy(out.withColumns({"effect": st.effect_label("eta2"), "significance": st.significance_label("p")}), 4)


@query(rounded(on(SCORED, _anova_sql("scored", "", "level", "peak")), "ss_between ss_within ss_total f eta2", 4))
def anova_pooled(spark, sf):
    return tidy(st.anova(scored(spark, sf), "level", "peak", with_p=False), 4)


@query(rounded(on(SCORED, """, lg AS (SELECT *, lag(level, 1) OVER (PARTITION BY entity ORDER BY week_start) AS level_lag1 FROM scored)"""
  + _anova_sql("lg", "entity", "level_lag1", "outcome")), "ss_between ss_within ss_total f eta2", 4))
def anova_on_lagged_level(spark, sf):
    from weekwise.operators.window import add_lags

    df = add_lags(scored(spark, sf), "level", [1], "entity").where("level_lag1 is not null")
    return tidy(st.anova(df, "level_lag1", "outcome", "entity", with_p=False), 4)


MOM = "count({y}) FILTER (WHERE {f} = {i}) AS n{i}, avg({y}) FILTER (WHERE {f} = {i}) AS m{i}, var_samp({y}) FILTER (WHERE {f} = {i}) AS v{i}"


def _two(f: str, y: str) -> str:
    return MOM.format(f=f, y=y, i=1) + ", " + MOM.format(f=f, y=y, i=0)


@query(rounded(on(HOT, f"""
  , m AS (SELECT entity, {_two("heat", "outcome")} FROM hot GROUP BY entity)
  SELECT *, m1 - m0 AS delta, CAST(n1 + n0 - 2 AS DOUBLE) AS dof,
    (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)) AS t FROM m"""), "m1 m0 v1 v0 delta dof t"))
def two_sample_t(spark, sf):
    return tidy(st.ttest(hot(spark, sf), "heat", "outcome", "entity", with_p=False))


@query(rounded(with_f_tail(inner(SQL["two_sample_t"]), "t * t", "1", "dof"), "m1 m0 v1 v0 delta dof t p"))
def two_sample_t_with_p(spark, sf):
    return tidy(st.ttest(hot(spark, sf), "heat", "outcome", "entity"))


LEVELS = ("none", "possible", "probable", "intense")
_PAIRS = " UNION ALL ".join(
    f"SELECT '{b} vs {a}' AS pair, {_two('x', 'outcome')} FROM (SELECT outcome, CASE level WHEN '{b}' THEN 1 WHEN '{a}' THEN 0 END AS x FROM scored)"
    for i, a in enumerate(LEVELS) for b in LEVELS[i + 1:])


@query(rounded(on(SCORED, f""", m AS ({_PAIRS})
  SELECT *, m1 - m0 AS delta, CAST(n1 + n0 - 2 AS DOUBLE) AS dof,
    (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)) AS t FROM m"""), "m1 m0 v1 v0 delta dof t"))
def pairwise_level_tests(spark, sf):
    return tidy(st.pairwise_ttests(scored(spark, sf), "level", "outcome", with_p=False))


@query(rounded(with_f_tail(f"SELECT * FROM ({inner(SQL['pairwise_level_tests'])}) WHERE pair LIKE 'intense vs%'", "t * t", "1", "dof"), "m1 m0 v1 v0 delta dof t p"))
def intense_against_each_level(spark, sf):
    return tidy(st.pairwise_ttests(scored(spark, sf), "level", "outcome", against="intense"))


EXT = FULL + """,
ex AS (SELECT *, CAST(coalesce(exposure >= quantile_cont(exposure, 0.9) OVER (PARTITION BY entity), false) AS INTEGER) AS p90,
   CAST(coalesce(exposure >= quantile_cont(exposure, 0.95) OVER (PARTITION BY entity), false) AS INTEGER) AS p95,
   lead(outcome, 1) OVER (PARTITION BY entity ORDER BY week_start) AS outcome_lead1 FROM full_panel)"""


def extremes(spark, sf):
    from weekwise.operators.window import add_leads

    df = threshold_flags(full_panel(spark, sf), "exposure", {"p90": 0.9, "p95": 0.95}, "entity", bounded=True)
    return add_leads(df, "outcome", [1], "entity")


_WELCH = " UNION ALL ".join(
    f"""SELECT '{f}' AS flag, '{y}' AS outcome, {_two(f, y)}, quantile_cont({y}, 0.5) FILTER (WHERE {f} = 1) AS median1,
      quantile_cont({y}, 0.5) FILTER (WHERE {f} = 0) AS median0 FROM ex"""
    for f in ("p90", "p95") for y in ("outcome", "outcome_lead1"))


@query(rounded(on(EXT, f""", m AS ({_WELCH})
  SELECT *, m1 - m0 AS delta, pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS dof,
    (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t FROM m"""), "m1 m0 v1 v0 median1 median0 delta dof t"))
def welch_extremes(spark, sf):
    return tidy(st.welch_table(extremes(spark, sf), ["p90", "p95"], ["outcome", "outcome_lead1"], with_p=False))


@query(rounded(with_f_tail(f"SELECT * EXCLUDE (median1, median0) FROM ({inner(SQL['welch_extremes'])})", "t * t", "1", "dof"), "m1 m0 v1 v0 delta dof t p"))
def welch_extremes_with_p(spark, sf):
    return tidy(st.welch_table(extremes(spark, sf), ["p90", "p95"], ["outcome", "outcome_lead1"], medians=False))


@query(rounded("""
  WITH x AS (SELECT l_linestatus, CAST(l_returnflag = 'R' AS INTEGER) AS f, l_quantity AS x FROM lineitem),
  r AS (SELECT *, rank() OVER (PARTITION BY l_linestatus ORDER BY x) + (count(*) OVER (PARTITION BY l_linestatus, x) - 1) / 2 AS rk FROM x),
  c AS (SELECT l_linestatus, sum(n::DOUBLE * (n::DOUBLE * n - 1)) AS ties FROM (SELECT l_linestatus, x, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY 1),
  u AS (SELECT r.l_linestatus, count(*) FILTER (WHERE f = 1) AS n1, count(*) FILTER (WHERE f = 0) AS n0,
    sum(rk) FILTER (WHERE f = 1) - count(*) FILTER (WHERE f = 1) * (count(*) FILTER (WHERE f = 1) + 1) / 2 AS u, max(ties) AS ties
    FROM r JOIN c ON r.l_linestatus = c.l_linestatus GROUP BY 1)
  SELECT l_linestatus, n1, n0, u, greatest(abs(u - n1 * n0 / 2) - 0.5, 0)
    / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0)::DOUBLE * (n1 + n0 - 1)))) AS z FROM u""", "u z"))
def mann_whitney(spark, sf):
    x = table(spark, sf, "lineitem", "l_linestatus", "l_returnflag", "l_quantity").withColumn("f", (F.col("l_returnflag") == "R").cast("int"))
    return tidy(st.mannwhitney(x, "f", "l_quantity", "l_linestatus", with_p=False))


def _mann_whitney_sql(ctes: str, by: str, src: str, flag: str, y: str) -> str:
    return on(ctes, f"""
  , mx AS (SELECT {by}, {flag} AS f, {y} AS x FROM {src} WHERE {flag} IS NOT NULL AND {y} IS NOT NULL),
  mr AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2 AS rk FROM mx),
  mc AS (SELECT {by}, sum(n::DOUBLE * (n::DOUBLE * n - 1)) AS ties FROM (SELECT {by}, x, count(*) AS n FROM mx GROUP BY 1, 2) GROUP BY 1),
  mu AS (SELECT mr.{by}, count(*) FILTER (WHERE f = 1) AS n1, count(*) FILTER (WHERE f = 0) AS n0,
    sum(rk) FILTER (WHERE f = 1) - count(*) FILTER (WHERE f = 1) * (count(*) FILTER (WHERE f = 1) + 1) / 2 AS u, max(ties) AS ties
    FROM mr JOIN mc ON mr.{by} = mc.{by} GROUP BY 1)
  SELECT {by}, n1, n0, u, greatest(abs(u - n1 * n0 / 2) - 0.5, 0)
    / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0)::DOUBLE * (n1 + n0 - 1)))) AS z FROM mu""")


@query(rounded(with_normal_tail(_mann_whitney_sql(HOT, "entity", "hot", "heat", "outcome"), "z"), "u z p"))
def mann_whitney_with_p(spark, sf):
    return tidy(st.mannwhitney(hot(spark, sf), "heat", "outcome", "entity"))


LABELLED = "lab AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"


def labelled(spark, sf):
    docs, labels = table(spark, sf, "documents", "doc_id", "n_chars"), table(spark, sf, "labels", "doc_id", "quality")
    return labels.join(docs, "doc_id").select(F.col("quality").alias("y"), F.col("n_chars").alias("s"))


CURVE = LABELLED + """,
g AS (SELECT s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM lab GROUP BY s),
cv AS (SELECT s AS threshold, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
   CAST(sum(pos) OVER () AS BIGINT) AS pt, CAST(sum(neg) OVER () AS BIGINT) AS nt FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""


@query(rounded(f"WITH {CURVE} SELECT threshold, tp, fp, tp / pt AS tpr, fp / nt AS fpr FROM cv", "tpr fpr"))
def roc_points(spark, sf):
    return tidy(st.roc_curve(labelled(spark, sf), "s", "y").select("threshold", "tp", "fp", "tpr", "fpr"))


@query(rounded(f"""WITH {CURVE},
  a AS (SELECT sum(neg * (tp - pos + pos / 2)) / (max(pt)::DOUBLE * max(nt)) AS auc, max(pt) AS positives, max(nt) AS negatives FROM cv),
  b AS (SELECT threshold, tp / pt - fp / nt AS youden, tp / pt AS sensitivity, 1 - fp / nt AS specificity FROM cv ORDER BY youden DESC, threshold DESC LIMIT 1)
  SELECT * FROM a, b""", "auc youden sensitivity specificity"))
def roc_summary(spark, sf):
    return tidy(st.roc(labelled(spark, sf), "s", "y"))


@query(rounded(f"""WITH {LABELLED},
  c AS (SELECT count(*) FILTER (WHERE s >= 500 AND y = 1) AS tp, count(*) FILTER (WHERE s >= 500 AND y <> 1) AS fp,
    count(*) FILTER (WHERE s < 500 AND y = 1) AS fn, count(*) FILTER (WHERE s < 500 AND y <> 1) AS tn FROM lab)
  SELECT *, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c""",
  '"precision" recall f1 accuracy'))
def confusion_matrix(spark, sf):
    return tidy(st.confusion(labelled(spark, sf), F.col("s") >= 500, "y"))


@query(rounded(on(SCORED, """
  , b AS (SELECT entity, week_start, score AS a, CASE WHEN peak >= 400 THEN 1.0 ELSE 0.25 END::DOUBLE AS b FROM scored)
  SELECT count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, stddev_samp(a) AS std_a, stddev_samp(b) AS std_b, corr(a, b) AS r,
    avg(b - a) AS mean_diff, max(abs(b - a)) AS max_abs_diff FROM b"""), "mean_a mean_b std_a std_b r mean_diff max_abs_diff"))
def score_versions(spark, sf):
    a = scored(spark, sf)
    b = full_panel(spark, sf).withColumn("score", F.when(F.col("peak") >= 400, 1.0).otherwise(0.25))
    return tidy(st.compare_scores(a, b, ["entity", "week_start"]))


@query(rounded(on(HOT, """
  SELECT 'heat' AS proxy, heat AS value, count(*) AS n, avg(score) AS mean, quantile_cont(score, 0.5) AS median, NULL::DOUBLE AS r FROM hot GROUP BY heat
  UNION ALL SELECT 'missing', missing, count(*), avg(score), quantile_cont(score, 0.5), NULL FROM hot GROUP BY missing
  UNION ALL SELECT 'exposure', NULL, count(exposure), NULL, NULL, corr(score, exposure) FROM hot
  UNION ALL SELECT 'outcome', NULL, count(outcome), NULL, NULL, corr(score, outcome) FROM hot"""), "mean median r"))
def score_checks(spark, sf):
    return tidy(st.proxy_checks(hot(spark, sf), "score", ["heat", "missing"], ["exposure", "outcome"]))


@query(rounded(on(EXT, " ".join([", w AS (SELECT *, " + ", ".join(f"lead(outcome, {k}) OVER (PARTITION BY entity ORDER BY week_start) AS o{k}" for k in range(4)) + " FROM ex)",
  " UNION ALL ".join(f"""SELECT '{f}' AS flag, {k} AS lag_weeks, count(o{k}) FILTER (WHERE {f} = 1) AS n_exposed, avg(o{k}) FILTER (WHERE {f} = 0) AS mean_unexposed,
     avg(o{k}) FILTER (WHERE {f} = 1) AS mean_exposed, avg(o{k}) FILTER (WHERE {f} = 1) - avg(o{k}) FILTER (WHERE {f} = 0) AS diff FROM w"""
     for f in ("p90", "p95") for k in range(4))])), "mean_unexposed mean_exposed diff"))
def excess_after_extremes(spark, sf):
    return tidy(st.excess_by_lag(extremes(spark, sf), ["p90", "p95"], "outcome", [0, 1, 2, 3], "entity"))


def _scale(name: str, ctes: str, anova: str) -> str:
    return f"SELECT *, '{name}' AS scale FROM (WITH {ctes} {anova})"


ANOM = SCORED + """, an AS (SELECT level, outcome - avg(outcome) OVER (PARTITION BY entity, month(week_start)) AS y FROM scored)"""


@query(rounded(" UNION ALL ".join([
    _scale("entity", SCORED, _anova_sql("scored", "", "level", "outcome")),
    _scale("anomaly", ANOM, _anova_sql("an", "", "level", "y")),
    _scale("parent", ROLLUP, _anova_sql("rolled", "", "level", "weight_exposed")),
]), "ss_between ss_within ss_total f eta2", 4))
def effect_size_by_scale(spark, sf):
    df = scored(spark, sf)
    up = rolled(spark, sf).withColumn("y", F.col("weight_exposed").cast("double"))
    return tidy(st.effect_by_scale({
        "entity": (df, "level", "outcome"), "anomaly": (anomaly(df, "outcome", F.month("week_start"), "entity"), "level", "outcome_anom"),
        "parent": (up, "level", "y")}, with_p=False), 4)


@query(rounded(on(SCORED, """
  , sh AS (SELECT entity, outcome, score AS lag0, lag(score, 1) OVER w AS lag1, lag(score, 2) OVER w AS lag2 FROM scored WINDOW w AS (PARTITION BY entity ORDER BY week_start)),
  c AS (SELECT entity, 'lag0' AS shift, corr(lag0, outcome) AS r FROM sh GROUP BY 1 UNION ALL SELECT entity, 'lag1', corr(lag1, outcome) FROM sh GROUP BY 1
        UNION ALL SELECT entity, 'lag2', corr(lag2, outcome) FROM sh GROUP BY 1),
  b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY entity ORDER BY abs(r) DESC, shift DESC) = 1),
  d AS (SELECT entity, avg(outcome) FILTER (WHERE level = 'intense') - avg(outcome) FILTER (WHERE level = 'none') AS delta FROM scored GROUP BY 1)
  SELECT b.entity, shift AS best_shift, r AS best_r, delta FROM b JOIN d ON b.entity = d.entity"""), "best_r delta"))
def findings_table(spark, sf):
    out = st.findings(scored(spark, sf), "score", "level", "outcome", "entity", with_p=False)
    return tidy(out.select("entity", "best_shift", "best_r", "delta"))
