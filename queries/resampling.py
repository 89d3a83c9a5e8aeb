"""Extreme-week audit and bootstrap replicates. Draws are hashes of counters, so SQL can repeat every sample."""

from pyspark.sql import functions as F

from weekwise.operators import resample as rs

from . import query
from .base import FULL, full_panel, on, rounded, tidy

SEED, B, LAG, Q = 42, 3000, 2, 0.95

AUDIT = FULL + f""",
kn AS (SELECT entity, week_start, exposure AS x, outcome AS y FROM full_panel WHERE exposure IS NOT NULL AND outcome IS NOT NULL),
th AS (SELECT entity, quantile_cont(x, {Q}) AS q FROM kn GROUP BY entity),
fl AS (SELECT k.*, CAST(x > q AS INTEGER) AS f FROM kn k JOIN th ON k.entity = th.entity),
st AS (SELECT *, CASE WHEN f = 1 AND coalesce(lag(f) OVER w, 0) = 0 THEN 1 ELSE 0 END AS s, lag(f, {LAG}) OVER w AS ext_lag FROM fl WINDOW w AS (PARTITION BY entity ORDER BY week_start)),
ep AS (SELECT *, CASE WHEN f = 1 THEN sum(s) OVER (PARTITION BY entity ORDER BY week_start ROWS UNBOUNDED PRECEDING) END AS e FROM st),
au AS (SELECT *, CASE WHEN ext_lag IS NOT NULL THEN y - avg(y) OVER (PARTITION BY entity, ext_lag IS NOT NULL, weekofyear(week_start)) END AS y_anom FROM ep)"""



def draw_sql(src: str, base: str, b: str, i: str, n: str) -> str:
    """``src`` with a column ``d``, the draw of ``resample.hashed_draws``; ``base`` are the 28 bits of the md5."""
    sql = f"SELECT *, ({base} + ({b})::BIGINT * {rs.PER_REPLICATE} + ({i})::BIGINT * {rs.PER_POSITION}) % {rs.PRIME} AS z FROM {src}"
    for shift, factor in ((15, rs.MIX_1), (13, rs.MIX_2)):
        sql = f"SELECT * REPLACE (xor(z, z >> {shift}) * {factor} % {rs.PRIME} AS z) FROM ({sql})"
    return f"(SELECT * EXCLUDE (z), xor(z, z >> 16) % ({n}) AS d FROM ({sql}))"


def base_sql(tag: int) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{SEED}', entity::VARCHAR, '{tag}')), 1, 7) AS BIGINT)"


def audit_rows(spark, sf):
    return rs.extreme_rows(full_panel(spark, sf), "exposure", "outcome", "entity", Q, LAG)


SUMMARY = """
epc AS (SELECT entity, e, count(*) AS n FROM au WHERE e IS NOT NULL GROUP BY 1, 2), epl AS (SELECT entity, count(*) AS n_episodes, max(n) AS max_episode_weeks FROM epc GROUP BY 1),
su AS (SELECT au.entity, count(*) AS n_total, CAST(sum(f) AS BIGINT) AS n_extreme_weeks, min(CASE WHEN f = 1 THEN x END) AS smallest_extreme,
    avg(y_anom) FILTER (WHERE ext_lag = 1) - avg(y_anom) FILTER (WHERE ext_lag = 0) AS delta_mean, max(n_episodes) AS n_episodes, max(max_episode_weeks) AS max_episode_weeks
  FROM au JOIN epl ON au.entity = epl.entity GROUP BY au.entity)"""


@query(rounded(on(AUDIT + "," + SUMMARY, "SELECT * FROM su"), "smallest_extreme delta_mean"))
def extreme_week_summary(spark, sf):
    return tidy(rs.audit_summary(audit_rows(spark, sf), "entity"))


WEEKS = AUDIT + f""",
g AS (SELECT entity, list(y_anom ORDER BY week_start) FILTER (WHERE ext_lag = 1) AS g1, list(y_anom ORDER BY week_start) FILTER (WHERE ext_lag = 0) AS g0,
  {base_sql(1)} AS h1, {base_sql(0)} AS h0 FROM au WHERE ext_lag IS NOT NULL GROUP BY entity),
r AS (SELECT entity, h1, h0, len(g1) AS n1, len(g0) AS n0, unnest(range(1, {B + 1})) AS b FROM g WHERE len(g1) > 0 AND len(g0) > 0),
d1 AS (SELECT entity, b, n1 AS n, h1, unnest(range(1, n1 + 1)) AS i FROM r), d0 AS (SELECT entity, b, n0 AS n, h0, unnest(range(1, n0 + 1)) AS i FROM r),
p1 AS (SELECT entity, h1, len(g1) AS n, unnest(g1) AS v, unnest(range(0, len(g1))) AS d FROM g), p0 AS (SELECT entity, h0, len(g0) AS n, unnest(g0) AS v, unnest(range(0, len(g0))) AS d FROM g),
w1 AS {draw_sql("d1", "h1", "b", "i", "n")}, w0 AS {draw_sql("d0", "h0", "b", "i", "n")},
v1 AS (SELECT w1.entity, b, v FROM w1 JOIN p1 ON w1.entity = p1.entity AND w1.d = p1.d), v0 AS (SELECT w0.entity, b, v FROM w0 JOIN p0 ON w0.entity = p0.entity AND w0.d = p0.d),
m1 AS (SELECT entity, b, avg(v) AS m, quantile_cont(v, 0.5) AS md FROM v1 GROUP BY 1, 2), m0 AS (SELECT entity, b, avg(v) AS m, quantile_cont(v, 0.5) AS md FROM v0 GROUP BY 1, 2),
rep AS (SELECT m1.entity, CAST(m1.b AS INTEGER) AS b, m1.m - m0.m AS delta_mean, m1.md - m0.md AS delta_median FROM m1 JOIN m0 ON m1.entity = m0.entity AND m1.b = m0.b)"""


@query(rounded(on(WEEKS, "SELECT * FROM rep"), "delta_mean delta_median"))
def bootstrap_by_weeks(spark, sf):
    known = audit_rows(spark, sf).where("ext_lag is not null")
    return tidy(rs.bootstrap_diff(known, "ext_lag", "y_anom", "entity", B, SEED, median=True))


@query(rounded(on(WEEKS, """SELECT entity, count(*) AS ci_n, quantile_cont(delta_mean, 0.025) AS ci_low, quantile_cont(delta_mean, 0.975) AS ci_high FROM rep GROUP BY entity"""),
  "ci_low ci_high"))
def bootstrap_interval(spark, sf):
    known = audit_rows(spark, sf).where("ext_lag is not null")
    return tidy(rs.percentile_ci(rs.bootstrap_diff(known, "ext_lag", "y_anom", "entity", B, SEED), "entity"))


def _episodes(y: str, anomaly: bool) -> str:
    value = "y - avg(y) OVER (PARTITION BY entity, b, weekofyear(week_start))" if anomaly else "y"
    return f""",
ka AS (SELECT entity, week_start, ext_lag, {y} AS y, f, CASE WHEN f = 1 THEN dense_rank() OVER (PARTITION BY entity, f ORDER BY e) END AS e FROM au),
kw AS (SELECT * FROM ka WHERE ext_lag IS NOT NULL),
ne AS (SELECT entity, count(DISTINCT e) AS n_ep, {base_sql(2)} AS h FROM ka GROUP BY entity HAVING count(DISTINCT e) > 0),
dr AS (SELECT entity, n_ep, h, b, unnest(range(1, n_ep + 1)) AS k FROM (SELECT *, unnest(range(1, {B + 1})) AS b FROM ne)),
dw AS (SELECT entity, b, k, 1 + d AS e FROM {draw_sql("dr", "h", "b", "k", "n_ep")}),
bo AS (SELECT kw.entity, week_start, y, f, unnest(range(1, {B + 1})) AS b, 0 AS k FROM kw JOIN ne ON kw.entity = ne.entity WHERE f = 0
       UNION ALL SELECT kw.entity, week_start, y, f, b, k FROM dw JOIN kw ON dw.entity = kw.entity AND dw.e = kw.e WHERE f = 1),
lg AS (SELECT * FROM (SELECT *, lag(f, {LAG}) OVER (PARTITION BY entity, b ORDER BY week_start, k) AS g FROM bo) WHERE g IS NOT NULL),
an AS (SELECT entity, b, g, {value} AS v FROM lg),
er AS (SELECT entity, CAST(b AS INTEGER) AS b, count(*) FILTER (WHERE g = 1) AS n1, count(*) FILTER (WHERE g = 0) AS n0,
  avg(v) FILTER (WHERE g = 1) - avg(v) FILTER (WHERE g = 0) AS delta_mean FROM an GROUP BY 1, 2
HAVING count(*) FILTER (WHERE g = 1) >= 5 AND count(*) FILTER (WHERE g = 0) >= 20)"""


@query(rounded(on(AUDIT + _episodes("y", True), "SELECT * FROM er"), "delta_mean"))
def bootstrap_by_episodes(spark, sf):
    return tidy(rs.bootstrap_episodes(audit_rows(spark, sf), "y", "entity", B, LAG, seed=SEED))


@query(rounded(on(AUDIT + _episodes("y_anom", False), "SELECT * FROM er"), "delta_mean"))
def bootstrap_by_episodes_fixed_anomaly(spark, sf):
    return tidy(rs.bootstrap_episodes(audit_rows(spark, sf), "y_anom", "entity", B, LAG, seed=SEED, recompute=False))


def _ci(src: str, stem: str) -> str:
    return f"""(SELECT entity, count(delta_mean) AS {stem}_n, quantile_cont(delta_mean, 0.025) AS {stem}_low,
      quantile_cont(delta_mean, 0.975) AS {stem}_high FROM {src} GROUP BY entity)"""


@query(rounded(on(WEEKS + _episodes("y", True) + "," + SUMMARY, f"""
  SELECT su.*, w.* EXCLUDE (entity), e.* EXCLUDE (entity), {Q}::DOUBLE AS quantile, {LAG} AS lag, 'woy' AS season, {SEED} AS seed
  FROM su LEFT JOIN {_ci("rep", "ci_week")} w ON su.entity = w.entity LEFT JOIN {_ci("er", "ci_episode")} e ON su.entity = e.entity"""),
  "smallest_extreme delta_mean ci_week_low ci_week_high ci_episode_low ci_episode_high quantile"))
def extreme_week_audit(spark, sf):
    """The whole audit with both bootstrap intervals in one plan."""
    return tidy(rs.extreme_audit(full_panel(spark, sf), "exposure", "outcome", "entity", Q, LAG, replicates=B, seed=SEED))


def _delta(src: str, label: str) -> str:
    return f"""SELECT entity, count(*) FILTER (WHERE g = 1) AS n1, count(*) FILTER (WHERE g = 0) AS n0, avg(a) FILTER (WHERE g = 1) - avg(a) FILTER (WHERE g = 0) AS delta_mean,
      '{label}' AS variant FROM (SELECT *, y - avg(y) OVER (PARTITION BY entity, weekofyear(week_start)) AS a FROM (
        SELECT *, lag(f, {LAG}) OVER (PARTITION BY entity ORDER BY week_start) AS g FROM {src}) WHERE g IS NOT NULL) GROUP BY entity"""


@query(rounded(on(AUDIT, f"""
  , lo AS (SELECT entity, e FROM (SELECT entity, e, count(*) AS n, min(week_start) AS s FROM au WHERE e IS NOT NULL GROUP BY 1, 2)
           QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, s) = 1),
  dr AS (SELECT au.* FROM au LEFT JOIN lo ON au.entity = lo.entity WHERE au.e IS NULL OR lo.e IS NULL OR au.e <> lo.e)
  {_delta("au", "all")} UNION ALL {_delta("dr", "without_longest")}"""), "delta_mean"))
def leave_longest_episode_out(spark, sf):
    return tidy(rs.leave_longest_out(audit_rows(spark, sf).withColumn("f", F.col("is_extreme")), "f", "y", LAG, "woy", "entity"))
