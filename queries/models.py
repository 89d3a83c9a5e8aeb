"""Regression models and their diagnostics."""

from pyspark.sql import functions as F

from weekwise.operators import models as md
from weekwise.operators.window import add_lags

from . import query
from .base import FULL, SCORED, full_panel, inner, normal_quantile_sql, on, rounded, scored, tidy, with_f_tail, with_t_critical

TREND = FULL + """,
trended AS (SELECT *, CAST(week_start - DATE '1995-01-02' AS DOUBLE) / 70 AS trend FROM full_panel)"""


def trended(spark, sf):
    """The panel with a linear trend in units of ten weeks."""
    return full_panel(spark, sf).withColumn("trend", F.datediff("week_start", F.lit("1995-01-02").cast("date")) / 70)


# two regressors in closed form: x = share, z = trend, y = exposure
OLS2 = TREND + """,
mo AS (SELECT entity, count(*) AS n, avg(share) AS mx, avg(trend) AS mz, avg(exposure) AS my, covar_pop(share, share) * count(*) AS sxx,
   covar_pop(trend, trend) * count(*) AS szz, covar_pop(share, trend) * count(*) AS sxz, covar_pop(share, exposure) * count(*) AS sxy,
   covar_pop(trend, exposure) * count(*) AS szy, covar_pop(exposure, exposure) * count(*) AS syy
   FROM trended WHERE share IS NOT NULL AND exposure IS NOT NULL GROUP BY entity),
be AS (SELECT *, sxx * szz - sxz * sxz AS d, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS bx, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS bz FROM mo),
rs AS (SELECT *, my - bx * mx - bz * mz AS b0, syy - bx * sxy - bz * szy AS rss FROM be),
fit AS (SELECT *, rss / (n - 3) AS s2, 1 - rss / syy AS r2 FROM rs)"""

TERMS = ["share", "trend"]


def fits(spark, sf):
    return md.ols(trended(spark, sf), TERMS, "exposure", "entity")


@query(rounded(on(OLS2, """
  SELECT entity, n, 3 AS k, r2, 1 - (1 - r2) * (n - 1) / (n - 3) AS adj_r2, (r2 / 2) / ((1 - r2) / (n - 3)) AS f, rss,
    n * ln(2 * pi() * rss / n) + n + 6 AS aic, n * ln(2 * pi() * rss / n) + n + 3 * ln(n) AS bic FROM fit"""), "r2 adj_r2 f rss aic bic", 4))
def least_squares_fit(spark, sf):
    return tidy(fits(spark, sf).drop("coefs", "p_f"), 4)


COEFS = on(OLS2, """
  , co AS (SELECT entity, n, 'share' AS term, bx AS coef, sqrt(s2 * szz / d) AS se FROM fit UNION ALL SELECT entity, n, 'trend', bz, sqrt(s2 * sxx / d) FROM fit
   UNION ALL SELECT entity, n, 'intercept', b0, sqrt(s2 * (1 / n + (mx * mx * szz - 2 * mx * mz * sxz + mz * mz * sxx) / d)) FROM fit)
  SELECT entity, n, term, coef, se, coef / se AS t FROM co""")


@query(rounded(f"SELECT * EXCLUDE (n) FROM ({COEFS})", "coef se t", 5))
def least_squares_coefficients(spark, sf):
    return tidy(md.coefficients(fits(spark, sf), "entity").drop("p", "ci_low", "ci_high"), 5)


@query(rounded(f"""SELECT entity, term, coef, se, t, p, coef - crit * se AS ci_low, coef + crit * se AS ci_high
  FROM ({with_t_critical(with_f_tail(COEFS, "t * t", "1", "n - 3"), "n - 3")})""", "coef se t p ci_low ci_high", 5))
def least_squares_with_p(spark, sf):
    return tidy(md.coefficients(fits(spark, sf), "entity"), 5)


@query(rounded(on(FULL, """
  , q AS (SELECT entity, quarter(week_start) AS q, avg(outcome) AS m FROM full_panel GROUP BY 1, 2),
  b AS (SELECT * FROM q WHERE q = 1)
  SELECT q.entity, 'Q_' || q.q AS term, q.m - b.m AS coef FROM q JOIN b ON q.entity = b.entity WHERE q.q > 1
  UNION ALL SELECT entity, 'intercept', m FROM b"""), "coef"))
def categorical_effects(spark, sf):
    df, terms = md.one_hot_terms(full_panel(spark, sf), F.quarter("week_start"), [1, 2, 3, 4], "Q_")
    return tidy(md.coefficients(md.ols(df, terms, "outcome", "entity"), "entity").select("entity", "term", "coef"))


@query(rounded(on(FULL, """
  , d AS (SELECT entity, exposure - avg(exposure) OVER (PARTITION BY entity, weekofyear(week_start)) AS x,
            peak - avg(peak) OVER (PARTITION BY entity, weekofyear(week_start)) AS y FROM full_panel WHERE exposure IS NOT NULL AND peak IS NOT NULL)
  SELECT entity, 'exposure' AS term, sum(x * y) / sum(x * x) AS coef FROM d GROUP BY entity"""), "coef"))
def absorbed_week_effects(spark, sf):
    df = full_panel(spark, sf).withColumn("woy", F.weekofyear("week_start"))
    out = md.coefficients(md.ols(df, ["exposure"], "peak", "entity", absorb="woy"), "entity")
    return tidy(out.select("entity", "term", "coef"))


def fit_sql(src: str, terms: list[str], y: str) -> str:
    """Fit statistics per entity: the centred cross-products are swept term by term; what is left for ``y`` is the residual sum."""
    names = [*terms, y]
    pairs = [(i, j) for j in range(len(names)) for i in range(j + 1)]
    known = " AND ".join(f"{c} IS NOT NULL" for c in names)
    sums = ", ".join(f"covar_pop({names[i]}::DOUBLE, {names[j]}::DOUBLE) * count(*) AS s{i}_{j}" for i, j in pairs)
    last = len(terms)
    sql = f"SELECT entity, count(*) AS n, 0 AS rank, covar_pop({y}::DOUBLE, {y}::DOUBLE) * count(*) AS syy, {sums} FROM {src} WHERE {known} GROUP BY entity"
    for k in range(last):
        pivot = f"s{k}_{k} > 1e-9"
        left = ", ".join(f"CASE WHEN {pivot} THEN s{i}_{j} - s{k}_{i} * s{k}_{j} / s{k}_{k} ELSE s{i}_{j} END AS s{i}_{j}" for i, j in pairs if i > k)
        sql = f"SELECT entity, n, rank + CAST({pivot} AS INTEGER) AS rank, syy, {left} FROM ({sql})"
    return f"""SELECT entity, n, rank + 1 AS k, 1 - rss / syy AS r2, 1 - rss / syy * (n - 1) / (n - rank - 1) AS adj_r2,
      ((syy - rss) / rank) / (rss / (n - rank - 1)) AS f, n * ln(2 * pi() * rss / n) + n + 2 * (rank + 1) AS aic,
      n * ln(2 * pi() * rss / n) + n + (rank + 1) * ln(n) AS bic FROM (SELECT * RENAME (s{last}_{last} AS rss) FROM ({sql}))"""


NESTED = ["level_ord", "urgent", "q1", "q2", "q3", "outcome_lag1"]  # the terms of three models: the first, the first five, all
COMPARISON = on(SCORED, """,
md AS (SELECT *, CASE level WHEN 'none' THEN 0 WHEN 'possible' THEN 1 WHEN 'probable' THEN 2 ELSE 3 END AS level_ord,
  lag(outcome) OVER (PARTITION BY entity ORDER BY week_start) AS outcome_lag1, CAST(quarter(week_start) = 1 AS INTEGER) AS q1,
  CAST(quarter(week_start) = 2 AS INTEGER) AS q2, CAST(quarter(week_start) = 3 AS INTEGER) AS q3 FROM scored)
""" + " UNION ALL ".join(f"SELECT *, '{m}' AS model FROM ({fit_sql('md', NESTED[:k], 'outcome')})" for m, k in (("M1", 1), ("M2", 5), ("M3", 6))))


@query(rounded(with_f_tail(COMPARISON, "f", "k - 1", "n - k", name="p_f"), "r2 adj_r2 f p_f aic bic", 5))
def outcome_model_comparison(spark, sf):
    """Level only; level, weather and quarters; the same with the outcome one week before."""
    from weekwise.functions.numbers import ordinal

    df, quarters = md.one_hot_terms(scored(spark, sf), F.quarter("week_start"), [4, 1, 2, 3], "Q_")
    df = add_lags(df.withColumn("level_ord", ordinal("level")), "outcome", [1], "entity")
    return tidy(md.compare_models({
        "M1": md.ols(df, ["level_ord"], "outcome", "entity"),
        "M2": md.ols(df, ["level_ord", "urgent", *quarters], "outcome", "entity"),
        "M3": md.ols(df, ["level_ord", "urgent", *quarters, "outcome_lag1"], "outcome", "entity"),
    }, "entity"), 5)


@query(rounded(on(TREND, """
  , r AS (SELECT entity, corr(exposure, share) AS a, corr(exposure, trend) AS b, corr(share, trend) AS c FROM trended
          WHERE exposure IS NOT NULL AND share IS NOT NULL GROUP BY entity),
  v AS (SELECT entity, 'exposure' AS "column", 1 / (1 - (a * a + b * b - 2 * a * b * c) / (1 - c * c)) AS vif FROM r
    UNION ALL SELECT entity, 'share', 1 / (1 - (a * a + c * c - 2 * a * b * c) / (1 - b * b)) FROM r
    UNION ALL SELECT entity, 'trend', 1 / (1 - (b * b + c * c - 2 * a * b * c) / (1 - a * a)) FROM r)
  SELECT *, vif > 5 AS over_5, vif > 10 AS over_10 FROM v"""), "vif"))
def variance_inflation(spark, sf):
    return tidy(md.vif(trended(spark, sf), ["exposure", "share", "trend"], "entity"))


RES = TREND + """,
ln AS (SELECT entity, regr_slope(exposure, trend) AS b, regr_intercept(exposure, trend) AS a FROM trended GROUP BY entity),
e0 AS (SELECT f.entity, week_start, a + b * trend AS fitted, exposure - a - b * trend AS residual FROM trended f JOIN ln ON f.entity = ln.entity
       WHERE exposure IS NOT NULL),
e1 AS (SELECT *, residual / stddev_samp(residual) OVER (PARTITION BY entity) AS std_residual FROM e0)"""


def residual_rows(spark, sf):
    df = trended(spark, sf)
    return md.residuals(df, md.ols(df, ["trend"], "exposure", "entity"), ["trend"], "exposure", "entity")


@query(rounded(on(RES, "SELECT *, sqrt(abs(std_residual)) AS scale_location FROM e1"), "fitted residual std_residual scale_location", 5))
def residual_diagnostics(spark, sf):
    return tidy(residual_rows(spark, sf).select("entity", "week_start", "fitted", "residual", "std_residual", "scale_location"), 5)


@query(rounded(on(RES, """
  , d AS (SELECT entity, residual, residual - lag(residual) OVER (PARTITION BY entity ORDER BY week_start) AS d FROM e0),
  w AS (SELECT entity, sum(d * d) / sum(residual * residual) AS dw FROM d GROUP BY entity)
  SELECT *, CASE WHEN dw < 1.5 THEN 'positive' WHEN dw > 2.5 THEN 'negative' ELSE 'none' END AS autocorrelation FROM w"""), "dw"))
def durbin_watson(spark, sf):
    return tidy(md.durbin_watson(residual_rows(spark, sf), "entity"))


@query(rounded(on(FULL, """
  , o AS (SELECT entity, exposure AS ordered, row_number() OVER (PARTITION BY entity ORDER BY exposure, week_start) AS i, count(*) OVER (PARTITION BY entity) AS n
          FROM full_panel WHERE exposure IS NOT NULL)
  SELECT entity, ordered, i, n, CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END AS position FROM o"""),
  "ordered position"))
def normal_quantile_positions(spark, sf):
    return tidy(md.qq_points(full_panel(spark, sf), "exposure", "entity").drop("theoretical").withColumn("i", F.col("i").cast("long")))


@query(rounded(on(RES, f"""
  , o AS (SELECT entity, residual AS ordered, row_number() OVER (PARTITION BY entity ORDER BY residual, week_start) AS i, count(*) OVER (PARTITION BY entity) AS n FROM e0),
  po AS (SELECT *, CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END::DOUBLE AS position FROM o)
  SELECT entity, ordered, CAST(i AS INTEGER) AS i, n, position, {normal_quantile_sql("position")} AS theoretical FROM po"""), "ordered position theoretical"))
def normal_quantile_points(spark, sf):
    return tidy(md.qq_points(residual_rows(spark, sf), "residual", "entity"))


@query(rounded(on(FULL, """
  , m AS (SELECT entity, exposure - avg(exposure) OVER (PARTITION BY entity) AS d FROM full_panel WHERE exposure IS NOT NULL),
  s AS (SELECT entity, count(*) AS n, avg(d * d * d) / pow(avg(d * d), 1.5) AS skew, avg(d * d * d * d) / pow(avg(d * d), 2) - 3 AS excess_kurtosis FROM m GROUP BY entity),
  j AS (SELECT *, skew * sqrt(n * (n - 1)) / (n - 2) AS sample_skew, n / 6.0::DOUBLE * (skew * skew + excess_kurtosis * excess_kurtosis / 4) AS jb FROM s)
  SELECT *, exp(-jb / 2) AS p FROM j"""), "skew excess_kurtosis sample_skew jb p"))
def normality_check(spark, sf):
    return tidy(md.jarque_bera(full_panel(spark, sf), "exposure", "entity"))


@query(rounded(on(FULL, ", l AS (SELECT entity, outcome, lead(exposure, 1) OVER w AS x1, lead(exposure, 2) OVER w AS x2 FROM full_panel WINDOW w AS (PARTITION BY entity ORDER BY week_start)) "
  + " UNION ALL ".join(f"SELECT entity, {k} AS lead, regr_slope(outcome, x{k}) AS coef FROM l GROUP BY entity" for k in (1, 2))), "coef"))
def placebo_leads(spark, sf):
    return tidy(md.placebo_leads(full_panel(spark, sf), "exposure", "outcome", [1, 2], "entity").select("entity", "lead", "coef"))
