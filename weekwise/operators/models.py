"""Least squares per entity by a distributed tall-and-skinny QR, and diagnostics of the fit."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._util import as_list, col, join_nullsafe
from .aggregate import group_stat_back
from .pvalues import f_tail, normal_quantile, p_chi2_2, t_critical
from .report import bias_corrected_skew
from .window import by_entity

_COEF = "array<struct<term:string,coef:double,se:double,t:double,p:double,ci_low:double,ci_high:double>>"
_FIT = "n long, k int, r2 double, adj_r2 double, f double, p_f double, rss double, aic double, bic double"


def one_hot_terms(df: DataFrame, factor: Column, values: Sequence, prefix: str) -> tuple[DataFrame, list[str]]:
    """0/1 columns of a categorical effect, the first value being the reference."""
    names = [f"{prefix}{v}" for v in values[1:]]
    return df.withColumns({
        n: F.coalesce(factor == F.lit(v), F.lit(False)).cast("double") for n, v in zip(names, values[1:])
    }), names


FAN = 64  # factors of a group that one task of the first merging round reads, about
HELD = 64 << 20  # bytes of factors a task holds before it hands them on


def _merged(blocks: list[np.ndarray], size: int) -> np.ndarray:
    """The R factor of stacked blocks, as a square matrix."""
    r = np.linalg.qr(np.vstack(blocks), mode="r")
    return np.vstack([r, np.zeros((size - len(r), size))]) if len(r) < size else r


def r_factors(df: DataFrame, cols: Sequence[str], by=()) -> DataFrame:
    """Per group: n and the R factor of the matrix (1, cols), over rows complete in all columns.

    Each task reduces the rows of a group to one factor, and a tree of two rounds merges the factors of the tasks, so no task holds the
    rows of a group. Unlike cross-products a factor keeps the condition of the columns, it does not square it.
    """
    keys, size = as_list(by), len(cols) + 1
    rows = df.dropna(subset=list(cols)).select(*map(col, keys), *[col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(cols)])

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, np.ndarray]] = {}
        task = TaskContext.get().partitionId() // FAN

        def emit() -> pa.RecordBatch:
            parts = [pa.array([k[i] for k in held], type=kinds[i]) for i in range(len(keys))]
            parts += [pa.array([task] * len(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64())]
            parts.append(pa.array([r.ravel() for _, r in held.values()], pa.list_(pa.float64())))
            held.clear()
            return pa.RecordBatch.from_arrays(parts, [*(f"__k{i}" for i in range(len(keys))), "__task", "n", "r"])

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.column(i).type for i in range(len(keys))]
            table = pa.table({f"k{i}": batch.column(i) for i in range(len(keys))} | {"row": np.arange(batch.num_rows)})
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(len(keys) + i).to_numpy(zero_copy_only=False) for i in range(len(cols)))])
            if keys:
                groups = table.group_by([f"k{i}" for i in range(len(keys))], use_threads=False).aggregate([("row", "list")])
                found = zip(zip(*(groups[f"k{i}"].to_pylist() for i in range(len(keys))), strict=True), groups["row_list"].to_pylist(), strict=True)
            else:
                found = [((), slice(None))] if batch.num_rows else []
            for name, at in found:
                n, r = held.get(name, (0, None))
                held[name] = n + len(x[at]), _merged([x[at]] if r is None else [r, x[at]], size)
            if len(held) * size * size * 8 > HELD:
                yield emit()
        if held:
            yield emit()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        r = _merged([np.asarray(v, float).reshape(size, size) for v in pdf["r"]], size)
        return pdf.iloc[:1].assign(n=int(pdf["n"].sum()), r=[r.ravel()])

    key_schema = "".join(f"__k{i} {df.schema[k].dataType.simpleString()}, " for i, k in enumerate(keys))
    schema, ids = f"{key_schema}__task INT, n LONG, r ARRAY<DOUBLE>", [f"__k{i}" for i in range(len(keys))]
    parts = rows.mapInArrow(reduce_rows, schema)
    near = parts.groupBy(*ids, "__task").applyInPandas(merge, schema)
    return near.groupBy(*ids).applyInPandas(merge, schema).drop("__task").withColumnsRenamed({f"__k{i}": k for i, k in enumerate(keys)})


def _centred(r: np.ndarray, n: int) -> np.ndarray:
    """The factor of the centred columns; what is rounding noise next to a column's mean is nothing."""
    s = r[1:, 1:].copy()
    noise = np.finfo(float).eps * max(n, 16) * np.abs(r[0, 1:])
    s[:, np.sqrt((s * s).sum(0)) <= noise] = 0
    return s


def _svd(s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(P, Q, rank) with P Q the pseudo-inverse of ``s``: with scaled columns if they are independent, else of least norm."""
    norms = np.sqrt((s * s).sum(0))
    least = np.finfo(float).eps * max(n, len(s), 16)
    for scale in (np.where(norms > 0, norms, 1.0), np.ones(len(norms))):
        u, d, vt = np.linalg.svd(s / scale)
        keep = d > least * d.max(initial=0)
        if keep.all() or (scale == 1).all():
            break
    return (vt.T / scale[:, None])[:, keep] / d[keep], u.T[keep], int(keep.sum())


def _solve(n: int, r: np.ndarray, terms: list[str], absorbed: int, constant: bool) -> dict:
    """Least squares from the factor of (1, terms, outcome); p-values and intervals are filled in by the caller."""
    whole = _centred(r, n)
    s, sy, rest = whole[:-1, :-1], whole[:-1, -1], float(whole[-1, -1])
    means = r[0, 1:] / r[0, 0]
    p, q, rank = _svd(s, n) if len(terms) else (np.zeros((0, 0)), np.zeros((0, 0)), 0)
    beta, inv = p @ (q @ sy), p @ p.T
    miss = sy - s @ beta
    rss, syy = rest * rest + float(miss @ miss), rest * rest + float(sy @ sy)
    k = rank + 1
    dof = n - k - absorbed
    out: dict = {"n": n, "k": k, "rss": rss, "rank": rank, "dof": dof}
    r2 = 1.0 - rss / syy if syy > 0 else math.nan
    out["r2"] = r2
    out["adj_r2"] = 1.0 - (1.0 - r2) * (n - 1) / dof if dof > 0 else math.nan
    out["f"] = (r2 / rank) / ((1.0 - r2) / dof) if rank and dof > 0 and r2 < 1 else math.nan
    out["aic"] = n * math.log(2 * math.pi * rss / n) + n + 2 * k if rss > 0 else math.nan
    out["bic"] = out["aic"] + k * (math.log(n) - 2)
    sigma2 = rss / dof if dof > 0 else math.nan
    mx = means[:-1]
    coefs, variances, names = list(beta), list(sigma2 * np.diag(inv)), list(terms)
    if constant:
        coefs.insert(0, means[-1] - mx @ beta)
        variances.insert(0, sigma2 * (1.0 / n + mx @ inv @ mx))
        names.insert(0, "intercept")
    rows = []
    for name, b, v in zip(names, coefs, variances):
        se = math.sqrt(v) if v > 0 else math.nan
        rows.append({"term": name, "coef": b, "se": se, "t": b / se if se > 0 else math.nan})
    out["coefs"] = rows
    return out


def _known(row: dict) -> dict:
    return {k: (None if isinstance(x, float) and math.isnan(x) else x) for k, x in row.items()}


def _tested(fits: list[dict]) -> list[dict]:
    """Add p-values and intervals, each kind for all fits at once."""
    if not fits:
        return fits
    dof = np.array([max(x["dof"], 0) for x in fits], float)
    p_f, crit = f_tail([x["f"] for x in fits], [x["rank"] for x in fits], dof), t_critical(dof)
    sizes = [len(x["coefs"]) for x in fits]
    t = np.array([c["t"] for x in fits for c in x["coefs"]], float)
    p_t = iter(f_tail(t * t, 1.0, np.repeat(dof, sizes)).tolist())
    out = []
    for fit, p, c in zip(fits, p_f.tolist(), crit.tolist(), strict=True):
        rows = [_known({**r, "p": next(p_t), "ci_low": r["coef"] - c * r["se"], "ci_high": r["coef"] + c * r["se"]}) for r in fit["coefs"]]
        out.append(_known({**fit, "p_f": p}) | {"coefs": rows})
    return out


def ols(df: DataFrame, terms: Sequence[str], y: str, by=(), absorb=()) -> DataFrame:
    """Least squares of ``y`` on ``terms`` with an intercept, one model per group.

    Output: fit statistics and ``coefs``, an array of coefficient rows (see ``coefficients``). The rows become
    one R factor per group (``r_factors``), from which solution and rank are taken. ``absorb`` names categorical columns whose *joint* effect is removed by centring within
    their groups first (a fixed effect with any number of values), in place of the intercept.
    """
    keys, names = as_list(by), list(terms)
    rows = df.dropna(subset=[*names, y])
    effects = as_list(absorb)
    if effects:
        cols = [*names, y]
        rows = group_stat_back(rows, [*keys, *effects], {f"__g{i}": F.avg(col(c)) for i, c in enumerate(cols)})
        levels = rows.groupBy(*map(col, keys), *map(col, effects)).agg(F.count("*").alias("__c"))
        levels = levels.groupBy(*map(col, keys)).agg((F.count("*") - 1).cast("int").alias("absorbed"))
        rows = rows.withColumns({c: col(c) - F.col(f"__g{i}") for i, c in enumerate(cols)})
    moments = r_factors(rows, [*names, y], keys)
    if effects:
        moments = join_nullsafe(moments, levels, keys) if keys else moments.withColumn(
            "absorbed", levels.select("absorbed").scalar())
    else:
        moments = moments.withColumn("absorbed", F.lit(0))
    constant = not effects

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(names) + 2
        for batch in batches:
            fits = _tested([
                _solve(int(r.n), np.asarray(r.r, float).reshape(size, size), names, int(r.absorbed), constant)
                for r in batch[["n", "r", "absorbed"]].itertuples()
            ])
            fitted = pd.DataFrame(fits, columns=[*_fit_names(), "coefs"])
            yield pd.concat([batch[keys].reset_index(drop=True), fitted], axis=1)

    key_schema = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return moments.mapInPandas(solve, f"{key_schema}{_FIT}, coefs {_COEF}")


def _fit_names() -> list[str]:
    return [part.split()[0] for part in _FIT.split(", ")]


def coefficients(fits: DataFrame, by=()) -> DataFrame:
    """One row per coefficient of a table of fits."""
    return fits.select(*map(col, as_list(by)), F.inline("coefs"))


def vif(df: DataFrame, cols: Sequence[str], by=()) -> DataFrame:
    """Variance inflation factor per column: diagonal of the inverse correlation matrix, with flags; NULL for a constant column."""
    keys, names = as_list(by), list(cols)

    def factors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for i, (n, r) in enumerate(zip(batch["n"], batch["r"], strict=True)):
                s = _centred(np.asarray(r, float).reshape(len(names) + 1, -1), int(n))
                sd = np.sqrt((s * s).sum(0))
                p, _, _ = _svd(s / np.where(sd > 0, sd, 1.0), int(n))
                part = pd.DataFrame({"column": names, "vif": np.where(sd > 0, (p * p).sum(1), np.nan)})
                parts.append(pd.concat([batch.iloc[[i] * len(names)][keys].reset_index(drop=True), part], axis=1))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    key_schema = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    out = r_factors(df, names, keys).mapInPandas(factors, f"{key_schema}column string, vif double")
    return out.withColumns({"over_5": F.col("vif") > 5, "over_10": F.col("vif") > 10})


def residuals(df: DataFrame, fits: DataFrame, terms: Sequence[str], y: str, by=()) -> DataFrame:
    """Rows complete in terms and outcome, with fitted value, residual, standardised residual and its
    scale-location value (square root of the absolute standardised residual)."""
    keys = as_list(by)
    rows = df.dropna(subset=[*terms, y])
    beta = fits.select(
        *map(col, keys), F.map_from_arrays(F.col("coefs.term"), F.col("coefs.coef")).alias("__beta")
    )
    if keys:
        out = join_nullsafe(rows, beta, keys, "inner")
    else:
        out = rows.withColumn("__beta", beta.select("__beta").scalar())
    fitted = F.coalesce(F.try_element_at("__beta", F.lit("intercept")), F.lit(0.0))
    for t in terms:
        fitted = fitted + F.col("__beta")[t] * col(t)
    out = out.withColumn("fitted", fitted).withColumn("residual", col(y) - F.col("fitted")).drop("__beta")
    out = group_stat_back(out, keys, {"__sd": F.stddev_samp("residual")})
    out = out.withColumn("std_residual", F.try_divide("residual", "__sd")).drop("__sd")
    return out.withColumn("scale_location", F.sqrt(F.abs("std_residual")))


def durbin_watson(df: DataFrame, entity, residual: str = "residual", key: str = "week_start") -> DataFrame:
    """Durbin-Watson statistic per entity with a reading of it."""
    step = F.col(residual) - F.lag(residual).over(by_entity(entity, key))
    out = df.withColumn("__d", step).groupBy(*map(col, as_list(entity))).agg(
        F.try_divide(F.sum(F.pow("__d", F.lit(2))), F.sum(F.pow(F.col(residual), 2))).alias("dw")
    )
    return out.withColumn(
        "autocorrelation",
        F.when(F.col("dw") < 1.5, "positive").when(F.col("dw") > 2.5, "negative").when(F.col("dw").isNotNull(), "none"),
    )


def compare_models(models: dict[str, DataFrame], by=()) -> DataFrame:
    """Fit statistics of several specifications side by side, one row per model and group."""
    from .dedup import union_panels

    keep = ["n", "k", "r2", "adj_r2", "f", "p_f", "aic", "bic"]
    return union_panels([
        fits.select(*map(col, as_list(by)), F.lit(name).alias("model"), *keep) for name, fits in models.items()
    ])


def qq_points(df: DataFrame, e: str, entity, tie: str = "week_start") -> DataFrame:
    """Ordered values of each entity against normal order-statistic medians."""
    keys = as_list(entity)
    rows = df.where(col(e).isNotNull())
    w = Window.partitionBy(*map(col, keys))
    i, n = F.row_number().over(w.orderBy(col(e), col(tie))), F.count("*").over(w)
    out = rows.select(*map(col, keys), col(e).alias("ordered"), i.alias("i"), n.alias("n"))
    edge = F.pow(F.lit(0.5), F.lit(1.0) / F.col("n"))
    position = (
        F.when(F.col("i") == F.col("n"), edge)
        .when(F.col("i") == 1, 1 - edge)
        .otherwise((F.col("i") - 0.3175) / (F.col("n") + 0.365))
    )
    return out.withColumn("position", position).withColumn("theoretical", normal_quantile("position"))


def jarque_bera(df: DataFrame, e: str, by=()) -> DataFrame:
    """Jarque-Bera normality check: n, skewness, excess kurtosis, statistic, p."""
    out = df.where(col(e).isNotNull()).groupBy(*map(col, as_list(by))).agg(
        F.count("*").alias("n"), F.skewness(col(e)).alias("skew"), F.kurtosis(col(e)).alias("excess_kurtosis"),
        bias_corrected_skew(e).alias("sample_skew"),
    )
    stat = F.col("n") / 6.0 * (F.pow("skew", F.lit(2)) + F.pow("excess_kurtosis", F.lit(2)) / 4)
    return out.withColumn("jb", stat).withColumn("p", p_chi2_2("jb"))


def placebo_leads(df: DataFrame, x: str, y: str, ks: Sequence[int], entity, key: str = "week_start",
                  controls: Sequence[str] = (), absorb=()) -> DataFrame:
    """One regression per lead of the exposure: a later exposure must not explain the outcome."""
    from .dedup import union_panels
    from .window import add_leads

    keys = as_list(entity)
    ahead = add_leads(df, x, ks, keys, key)
    parts = []
    for k in ks:
        fits = ols(ahead, [f"{x}_lead{k}", *controls], y, keys, absorb)
        parts.append(
            coefficients(fits, keys).where(F.col("term") == f"{x}_lead{k}").withColumn("lead", F.lit(k)).drop("term")
        )
    return union_panels(parts)
