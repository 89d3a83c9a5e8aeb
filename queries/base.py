"""How the driver tables stand in for the panels, and the same definitions as SQL fragments.

entity = nation, outcome = orders per week, exposure and peak = mean and largest order value (in
thousands), urgent = urgent orders, share = urgent share; parent = region, population = customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weekwise.operators.aggregate import weekly_agg
from weekwise.operators.calendar import complete_calendar
from weekwise.operators.score import Rule, score_and_level


# explicit schemas: a read plans nothing but the scan, without a job that opens footers first
SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
              "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}


def table(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")
    return df.select(*cols) if cols else df


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the nation of their customer."""
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    customer = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("c_nationkey").alias("entity"), F.col("o_orderdate").cast("date").alias("date"),
        "o_orderkey", "o_totalprice", "o_orderpriority",
    )


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """The gappy weekly panel."""
    urgent = F.count_if(F.col("o_orderpriority") == "1-URGENT")
    return weekly_agg(order_rows(spark, sf), "entity", "date", {
        "outcome": F.count("*"),
        "exposure": F.round(F.avg("o_totalprice") / 1000, 9),
        "peak": F.round(F.max("o_totalprice") / 1000, 5),
        "urgent": urgent,
        "share": F.round(urgent / F.count("*"), 6),
    })


def full_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel on a complete calendar per entity: counts 0 and measures NULL where a week is absent."""
    return complete_calendar(panel(spark, sf), "entity", fills={"outcome": 0, "urgent": 0}, missing_flag="missing")


# share stands in for the low-visibility flag, outcome for humidity
RULES = (
    Rule("exposure", ">=", 250, 1.0),
    Rule("exposure", ">=", 300, 1.0),
    Rule("peak", ">=", 400, 0.75),
    Rule("share", ">", 0, 0.5),
    Rule("outcome", "<=", 1, 0.25),
    Rule("peak", ">", 470, 0.5),
)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """The complete panel with composite score and level."""
    return score_and_level(full_panel(spark, sf), RULES)


def parents(spark: SparkSession, sf: str) -> DataFrame:
    """entity, parent and population of every nation."""
    people = table(spark, sf, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("population"))
    nation = table(spark, sf, "nation", "n_nationkey", "n_regionkey")
    return nation.join(people, nation.n_nationkey == people.c_nationkey).select(
        F.col("n_nationkey").alias("entity"), F.col("n_regionkey").alias("parent"), "population"
    )


def off_tie(digits: int) -> float:
    """A shift far below the last kept digit: means of prices often end in an exact decimal 5, where the
    order of additions alone would decide which way an engine rounds."""
    return 0.012345678 * 10.0**-digits


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that engines that add in another order still agree."""
    return df.select(*[
        F.round(F.col(f"`{c}`") + off_tie(digits), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes
    ])


PANEL = """panel AS (
  SELECT c_nationkey AS entity, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start,
         count(*) AS outcome, round(avg(o_totalprice) / 1000, 9) AS exposure,
         round(max(o_totalprice) / 1000, 5) AS peak,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
         round(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 6) AS share
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

FULL = PANEL + """,
bounds AS (SELECT entity, min(week_start) AS lo, max(week_start) AS hi FROM panel GROUP BY entity),
spine AS (SELECT entity, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_start FROM bounds),
full_panel AS (
  SELECT s.entity, s.week_start, coalesce(p.outcome, 0) AS outcome, p.exposure, p.peak,
         coalesce(p.urgent, 0) AS urgent, p.share, CAST(p.entity IS NULL AS INTEGER) AS missing
  FROM spine s LEFT JOIN panel p ON s.entity = p.entity AND s.week_start = p.week_start)"""

SCORED = FULL + """,
points AS (
  SELECT *, (CASE WHEN exposure >= 250 THEN 1.0 ELSE 0 END + CASE WHEN exposure >= 300 THEN 1.0 ELSE 0 END
    + CASE WHEN peak >= 400 THEN 0.75 ELSE 0 END + CASE WHEN share > 0 THEN 0.5 ELSE 0 END
    + CASE WHEN outcome <= 1 THEN 0.25 ELSE 0 END
    + CASE WHEN peak > 470 THEN 0.5 ELSE 0 END)::DOUBLE / 4.0::DOUBLE AS score FROM full_panel),
scored AS (
  SELECT *, CASE WHEN score >= 0.75 THEN 'intense' WHEN score >= 0.5 THEN 'probable'
                 WHEN score >= 0.25 THEN 'possible' ELSE 'none' END AS level FROM points)"""

PARENTS = """parents AS (
  SELECT n_nationkey AS entity, n_regionkey AS parent, count(*) AS population
  FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


def rounded(sql: str, cols: str, digits: int = 6) -> str:
    """Wrap a statement so that the named columns are rounded like ``tidy`` does."""
    parts = ", ".join(f"round({c} + {off_tie(digits)!r}::DOUBLE, {digits}) + 0.0::DOUBLE AS {c}" for c in cols.split())
    return f"SELECT * REPLACE ({parts}) FROM ({sql})"


def on(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


def inner(sql: str) -> str:
    """The statement that ``rounded`` wrapped."""
    return sql.split(") FROM (", 1)[1][:-1]


def with_f_tail(sql: str, f: str, d1: str, d2: str, steps: int = 8000, name: str = "p") -> str:
    """Add the upper tail of Fisher's F by Simpson's rule: with x = atan(sqrt(d1 F / d2)) the density is sin**(d1 - 1) * cos**(d2 - 1)."""
    value = "pow(sin({x}), d1 - 1) * pow(cos({x}), d2 - 1)"
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    low, high = value.format(x=f"th * i / {steps}"), value.format(x=f"(th + (pi() / 2 - th) * i / {steps})")
    return f"""WITH tb AS (SELECT *, row_number() OVER () AS rid FROM ({sql})),
tp AS (SELECT rid, ({d1})::DOUBLE AS d1, ({d2})::DOUBLE AS d2, atan(sqrt(({d1})::DOUBLE * ({f}) / ({d2}))) AS th FROM tb),
tg AS (SELECT *, unnest(range(0, {steps} + 1)) AS i FROM tp WHERE th IS NOT NULL),
ts AS (SELECT rid, any_value(th) * sum(({weight}) * {low}) AS below, (pi() / 2 - any_value(th)) * sum(({weight}) * {high}) AS above FROM tg GROUP BY rid)
SELECT tb.* EXCLUDE (rid), above / (below + above) AS {name} FROM tb LEFT JOIN ts ON tb.rid = ts.rid"""


def with_t_critical(sql: str, dof: str, level: float = 0.95, steps: int = 8000, newton: int = 5, name: str = "crit") -> str:
    """Add the two-sided critical value of Student's t: with x = atan(t / sqrt(dof)) the density is cos**(dof - 1); Newton steps on Simpson sums."""
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"

    def area(src: str, upper: str) -> str:
        return f"(SELECT d, any_value({upper}) / {steps} / 3 * sum(({weight}) * pow(cos({upper} * i / {steps}), d - 1)) AS s FROM (SELECT *, unnest(range(0, {steps} + 1)) AS i FROM {src}) GROUP BY d)"

    ctes = [f"tb AS (SELECT *, ({dof})::DOUBLE AS d FROM ({sql}))", "c0 AS (SELECT DISTINCT d, atan(2 / sqrt(d)) AS th FROM tb WHERE d > 0)", f"ct AS {area('c0', 'pi() / 2')}"]
    for k in range(newton):
        ctes.append(f"c{k + 1} AS (SELECT c.d, c.th + ({level!r}::DOUBLE * ct.s - a.s) / pow(cos(c.th), c.d - 1) AS th FROM c{k} c JOIN ct ON c.d = ct.d JOIN {area(f'c{k}', 'th')} a ON c.d = a.d)")
    return f"WITH {', '.join(ctes)} SELECT tb.* EXCLUDE (d), sqrt(tb.d) * tan(c.th) AS {name} FROM tb LEFT JOIN c{newton} c ON tb.d = c.d"


def with_normal_tail(sql: str, z: str, steps: int = 8000, name: str = "p") -> str:
    """Add the two-sided tail of a standard normal statistic by Simpson's rule over the next twelve units."""
    x = f"(abs({z}) + 12.0::DOUBLE * i / {steps})"
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"""WITH tb AS (SELECT *, row_number() OVER () AS rid FROM ({sql})),
tg AS (SELECT rid, {z}, unnest(range(0, {steps} + 1)) AS i FROM tb WHERE {z} IS NOT NULL),
ts AS (SELECT rid, 2 / sqrt(2 * pi()) * 12.0::DOUBLE / {steps} / 3 * sum(({weight}) * exp(-{x} * {x} / 2)) AS p FROM tg GROUP BY rid)
SELECT tb.* EXCLUDE (rid), ts.p AS {name} FROM tb LEFT JOIN ts ON tb.rid = ts.rid"""


# Coefficients of the published algorithm AS 241 for normal quantiles (central part, tails down to exp(-25)).
_CENTRE = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
           (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
_TAIL = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
         (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))


def normal_quantile_sql(p: str) -> str:
    def ratio(x: str, table) -> str:
        poly = lambda c: " + ".join(f"{v!r}::DOUBLE * pow({x}, {k})" for k, v in enumerate(c))
        return f"(({poly(table[0])}) / ({poly(table[1])}))"

    centre = f"(({p}) - 0.5) * " + ratio(f"(0.180625 - (({p}) - 0.5) * (({p}) - 0.5))", _CENTRE)
    tail = f"sign(({p}) - 0.5) * " + ratio(f"(sqrt(-ln(least({p}, 1 - ({p})))) - 1.6)", _TAIL)
    return f"CASE WHEN abs(({p}) - 0.5) <= 0.425 THEN {centre} ELSE {tail} END"
