"""Extreme-week audit and bootstrap confidence intervals on panels.

The unit of work is a block of replicates of one entity: the periods of the entity travel once per block, the replicates of a block are
rows of a matrix, and only results leave the task. Draws are hashes of (seed, entity, replicate, position), never ``rand()``: a task that
is run again after an executor loss draws the same sample, and blocks of any size give the same replicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, functions as F

from ._util import as_list, col, join_nullsafe
from .score import threshold_flags
from .window import add_lags, anomaly, episodes

CI = (0.025, 0.975)


BLOCK = 500  # replicates of an entity in one group
CELLS = 1_000_000  # replicates times periods that a task draws at once
SEASONS = 54  # weeks and months are numbered below this
PRIME, PER_REPLICATE, PER_POSITION, MIX_1, MIX_2 = 2_147_483_647, 73_856_093, 19_349_663, 1_664_525_791, 1_103_515_245


def hashed_draws(seed: int, ident: str, tag: int, b: np.ndarray, count: int, n: int) -> np.ndarray:
    """Repeatable draws from 0..n-1: one row per replicate in ``b``, ``count`` positions each.

    Replicate and position, offset by 28 bits of md5(``seed|ident|tag``), go through two rounds of shift, xor and multiplication modulo
    2**31 - 1; products stay within 62 bits, so SQL can repeat them in whole numbers.
    """
    base = int(hashlib.md5(f"{seed}|{ident}|{tag}".encode()).hexdigest()[:7], 16)
    z = (base + b.astype(np.int64)[:, None] * PER_REPLICATE + np.arange(1, count + 1)[None, :] * PER_POSITION) % PRIME
    z = (z ^ (z >> 15)) * MIX_1 % PRIME
    z = (z ^ (z >> 13)) * MIX_2 % PRIME
    return (z ^ (z >> 16)) % n


def _in_blocks(rows: DataFrame, keys: list[str], replicates: int) -> GroupedData:
    """Rows grouped by entity and block of replicates.

    The number of partitions is stated: adaptive execution goes by bytes and would put these few rows, and all the drawing, into a few tasks.
    """
    if replicates < 1:
        raise ValueError("at least one replicate")
    by = [*map(col, keys), F.col("__block")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // BLOCK))))
    return blocks.repartition(parts, *by).groupBy(*by)


def _steps(block: int, replicates: int, periods: int) -> Iterator[np.ndarray]:
    """Numbers of the replicates of a block, as many at a time as CELLS allows (a very long series: one)."""
    first, end = block * BLOCK + 1, min(replicates, (block + 1) * BLOCK) + 1
    step = max(1, CELLS // max(1, periods))
    for b in range(first, end, step):
        yield np.arange(b, min(end, b + step))


def season_part(season: str, key: str = "week_start") -> Column:
    if season == "woy":
        return F.weekofyear(col(key))
    if season == "month":
        return F.month(col(key))
    raise ValueError("season must be 'woy' or 'month'")


def extreme_rows(
    df: DataFrame, x: str, y: str, entity, q: float = 0.95, lag: int = 2, season: str = "woy",
    key: str = "week_start", start: str | None = None, by: str = "row",
) -> DataFrame:
    """Rows behind the extreme-week audit: extreme flag, episode, lagged flag and outcome anomaly.

    Steps in order: drop incomplete rows, clip, flag values strictly over the entity's quantile, number
    episodes, lag the flag, drop rows without a lagged flag, subtract the seasonal mean of what is left.
    ``is_extreme_all`` rows (before the drop) are kept with a NULL anomaly so that counts stay whole.
    """
    keys = as_list(entity)
    rows = df.where(col(x).isNotNull() & col(y).isNotNull() & col(key).isNotNull()).select(
        *map(col, keys), col(key), col(x).alias("x"), col(y).alias("y")
    )
    if start:
        rows = rows.where(col(key) >= F.lit(start).cast("date"))
    rows = threshold_flags(rows, "x", {"is_extreme": q}, keys, strict=True, bounded=True)
    rows = add_lags(episodes(rows, "is_extreme", keys, key, by), "is_extreme", [lag], keys, key)
    rows = rows.withColumnRenamed(f"is_extreme_lag{lag}", "ext_lag")
    part = F.struct(season_part(season, key).alias("s"), F.col("ext_lag").isNotNull().alias("known"))
    rows = anomaly(rows, "y", part, keys)
    return rows.withColumn("y_anom", F.when(F.col("ext_lag").isNotNull(), F.col("y_anom")))


def bootstrap_diff(
    df: DataFrame, flag: str, y: str, entity, replicates: int, seed: int = 42, key: str = "week_start",
    median: bool = False,
) -> DataFrame:
    """Replicates of the difference of means (and medians) between flag 1 and flag 0, per entity.

    Both groups are resampled with replacement at their own size. One shuffle gathers (entity, block of replicates); an entity
    without rows on both sides has no replicates.
    """
    keys = as_list(entity)
    if not keys:
        raise ValueError("resample within entities")
    rows = df.where(col(flag).isNotNull() & col(y).isNotNull()).select(
        *map(col, keys), F.concat_ws("/", *[col(k).cast("string") for k in keys]).alias("__ident"), col(key).alias("k"),
        col(flag).cast("int").alias("f"), col(y).cast("double").alias("y"),
    )

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        ident, block = pdf["__ident"].iloc[0], int(pdf["__block"].iloc[0])
        groups = {tag: pdf.loc[pdf.f == tag, "y"].to_numpy() for tag in (1, 0)}
        if not all(map(len, groups.values())):
            return pd.DataFrame(columns=names)
        parts = []
        for b in _steps(block, replicates, len(pdf)):
            one, rest = (v[hashed_draws(seed, ident, tag, b, len(v), len(v))] for tag, v in groups.items())
            out = pd.DataFrame({"b": b, "delta_mean": one.mean(1) - rest.mean(1)})
            if median:
                out["delta_median"] = np.median(one, 1) - np.median(rest, 1)
            parts.append(out)
        return pd.concat(parts).assign(**{k: pdf[k].iloc[0] for k in keys})[names]

    names = [*keys, "b", "delta_mean", *(["delta_median"] if median else [])]
    kinds = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + ["b INT"] + [f"{n} DOUBLE" for n in names[len(keys) + 1 :]])
    return _in_blocks(rows, keys, replicates).applyInPandas(draw, kinds)


def percentile_ci(reps: DataFrame, entity, c: str = "delta_mean", stem: str = "ci") -> DataFrame:
    """Percentile interval of the replicates of each entity (at most ``replicates`` rows per group)."""
    return reps.groupBy(*map(col, as_list(entity))).agg(
        F.count(col(c)).alias(f"{stem}_n"), F.percentile(col(c), CI[0]).alias(f"{stem}_low"),
        F.percentile(col(c), CI[1]).alias(f"{stem}_high"),
    )


def bootstrap_episodes(
    rows: DataFrame, y: str, entity, replicates: int, lag: int = 2, season: str = "woy", seed: int = 42,
    key: str = "week_start", flag: str = "is_extreme", episode: str = "episode_id", recompute: bool = True,
    min_exposed: int = 5, min_rest: int = 20, known: str | None = "ext_lag",
) -> DataFrame:
    """Replicates that resample whole episodes and always keep the quiet weeks.

    ``recompute=True``: lagged flag and seasonal anomaly are taken anew in every replicate.
    ``recompute=False``: ``y`` already is an anomaly and only the lag is taken anew.
    Episodes are counted over all rows; rows whose ``known`` column is NULL are not drawn, so an
    episode that lies among them alone stays in the draw and adds no row.
    Replicates with fewer than ``min_exposed`` exposed or ``min_rest`` other weeks are left out.

    A replicate is a vector of weights: 1 for a quiet week, for a week of an episode the number of times that episode is drawn. A
    week of weight w stands w times in a row. How many of them follow an extreme at the lag is a difference of running counts,
    and all means are weighted sums, so no replicate is laid out as rows of its own.
    """
    keys = as_list(entity)
    base = rows.select(
        *map(col, keys), F.concat_ws("/", *[col(k).cast("string") for k in keys]).alias("__ident"), col(key).alias("k"), col(y).cast("double").alias("y"),
        col(flag).cast("int").alias("f"), col(episode).cast("long").alias("e"), season_part(season, key).cast("int").alias("s"),
        (col(known).isNotNull() if known else F.lit(True)).alias("known"),
    )

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        ident, block = pdf["__ident"].iloc[0], int(pdf["__block"].iloc[0])
        episodes_of = np.sort(pdf.e.dropna().unique())
        many = len(episodes_of)
        own = pdf[pdf.known & ((pdf.f == 0) | ((pdf.f == 1) & pdf.e.notna()))]
        if not many or not len(own):
            return pd.DataFrame(columns=names)
        exposes, value = own.f.to_numpy() == 1, own.y.to_numpy(float)
        episode_at = np.searchsorted(episodes_of, own.e.to_numpy(float)[exposes])
        part = own.s.to_numpy() if recompute else None
        parts = []
        for b in _steps(block, replicates, max(len(own), many)):
            weights = np.ones((len(b), len(own)), np.int64)
            weights[:, exposes] = _times_drawn(hashed_draws(seed, ident, 2, b, many, many), many)[:, episode_at]
            parts.append(pd.DataFrame({"b": b} | _lagged_means(weights, exposes, value, part, lag)))
        found = pd.concat(parts)
        found = found[(found.n1 >= min_exposed) & (found.n0 >= min_rest)]
        return found.assign(**{k: pdf[k].iloc[0] for k in keys})[names]

    names = [*keys, "b", "n1", "n0", "delta_mean"]
    kinds = ", ".join([f"`{k}` {df_type}" for k, df_type in ((k, rows.schema[k].dataType.simpleString()) for k in keys)] + ["b INT, n1 LONG, n0 LONG, delta_mean DOUBLE"])
    return _in_blocks(base, keys, replicates).applyInPandas(draw, kinds)


def _times_drawn(draws: np.ndarray, many: int) -> np.ndarray:
    """How often each of 0..many-1 occurs in each row of ``draws``."""
    at = draws + np.arange(len(draws))[:, None] * many
    return np.bincount(at.ravel(), minlength=len(draws) * many).reshape(len(draws), many)


def _lagged_means(weights: np.ndarray, exposes: np.ndarray, value: np.ndarray, part: np.ndarray | None, lag: int) -> dict[str, np.ndarray]:
    """Per row of ``weights``: sizes of the exposed and the other weeks, and the difference of their means.

    A week is exposed if the week ``lag`` places before it in the weighted sequence is an extreme; the first ``lag`` places have no
    such week and are left out. With ``part`` the weighted mean of each season is taken off first. NaN where a side is empty or an
    unknown value is drawn.
    """
    unknown, value = np.isnan(value).astype(float), np.nan_to_num(value)
    ends = np.cumsum(weights, 1)
    total = ends[:, -1]
    offset = np.concatenate([[0], np.cumsum(total)])
    places = np.repeat(np.tile(exposes, len(weights)), weights.ravel())  # one byte per place of all sequences
    extremes = np.concatenate([[0], np.cumsum(places, dtype=np.int64)])
    until = offset[:-1, None] + np.maximum(ends - lag, 0)  # the weeks up to here expose those before ``ends``
    reached = extremes[until]
    before = extremes[offset[:-1]][:, None]
    one = np.diff(reached, axis=1, prepend=before)
    both = np.diff(np.maximum(ends - lag, 0), axis=1, prepend=0)
    rest = both - one
    n1, n0 = one.sum(1), rest.sum(1)
    sum1, sum0 = one @ value, rest @ value
    if part is not None:
        seasons = np.zeros((len(value), SEASONS))
        seasons[np.arange(len(value)), part] = 1.0
        in1, in0 = one @ seasons, rest @ seasons
        mean = ((one + rest) @ (seasons * value[:, None])) / np.maximum(in1 + in0, 1)
        sum1, sum0 = sum1 - (in1 * mean).sum(1), sum0 - (in0 * mean).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return {"n1": n1, "n0": n0, "delta_mean": np.where(both @ unknown > 0, np.nan, sum1 / n1 - sum0 / n0)}


def audit_summary(rows: DataFrame, entity, x: str = "x") -> DataFrame:
    """Counts, threshold side, episodes and point estimate of the audit rows."""
    keys = as_list(entity)
    lengths = rows.where("episode_id is not null").groupBy(*map(col, keys), "episode_id").agg(
        F.count("*").alias("weeks")
    ).groupBy(*map(col, keys)).agg(F.count("*").alias("n_episodes"), F.max("weeks").alias("max_episode_weeks"))
    point = rows.groupBy(*map(col, keys)).agg(
        F.count("*").alias("n_total"), F.sum("is_extreme").alias("n_extreme_weeks"),
        F.min(F.when(F.col("is_extreme") == 1, col(x))).alias("smallest_extreme"),
        (F.avg(F.when(F.col("ext_lag") == 1, F.col("y_anom")))
         - F.avg(F.when(F.col("ext_lag") == 0, F.col("y_anom")))).alias("delta_mean"),
    )
    out = join_nullsafe(point, lengths, keys)
    return out.fillna({"n_episodes": 0, "max_episode_weeks": 0})


def extreme_audit(
    df: DataFrame, x: str, y: str, entity, q: float = 0.95, lag: int = 2, season: str = "woy",
    replicates: int = 3000, seed: int = 42, key: str = "week_start", start: str | None = None, by: str = "row",
) -> DataFrame:
    """Extreme-week audit per entity: threshold and counts, episodes, de-seasonalised difference of the
    outcome ``lag`` weeks after extremes, and its bootstrap intervals by weeks and by episodes."""
    keys = as_list(entity)
    rows = extreme_rows(df, x, y, keys, q, lag, season, key, start, by)
    known = rows.where("ext_lag is not null")
    weeks = percentile_ci(bootstrap_diff(known, "ext_lag", "y_anom", keys, replicates, seed, key), keys, stem="ci_week")
    eps = percentile_ci(
        bootstrap_episodes(rows, "y", keys, replicates, lag, season, seed, key), keys, stem="ci_episode"
    )
    out = join_nullsafe(join_nullsafe(audit_summary(rows, keys), weeks, keys), eps, keys)
    return out.withColumns({"quantile": F.lit(q), "lag": F.lit(lag), "season": F.lit(season), "seed": F.lit(seed)})


def drop_longest(rows: DataFrame, entity, episode: str = "episode_id", key: str = "week_start") -> DataFrame:
    """Rows without those of the longest episode of each entity (ties: the earliest)."""
    keys = as_list(entity)
    longest = rows.where(col(episode).isNotNull()).groupBy(*map(col, keys), col(episode)).agg(
        F.count("*").alias("__n"), F.min(col(key)).alias("__s")
    ).groupBy(*map(col, keys)).agg(
        F.max_by(col(episode), F.struct(F.col("__n"), -F.unix_date("__s"))).alias("__longest")
    )
    out = join_nullsafe(rows, longest, keys)
    return out.where(col(episode).isNull() | (col(episode) != F.col("__longest"))).drop("__longest")


def lagged_delta(rows: DataFrame, flag: str, y: str, lag: int, season: str, entity, key: str = "week_start") -> DataFrame:
    """Difference of the outcome anomaly ``lag`` rows after flagged and unflagged rows, with group sizes."""
    keys = as_list(entity)
    lagged = add_lags(rows, flag, [lag], keys, key).where(col(f"{flag}_lag{lag}").isNotNull())
    d = anomaly(lagged, y, season_part(season, key), keys)
    on = col(f"{flag}_lag{lag}")
    return d.groupBy(*map(col, keys)).agg(
        F.count_if(on == 1).alias("n1"), F.count_if(on == 0).alias("n0"),
        (F.avg(F.when(on == 1, col(f"{y}_anom"))) - F.avg(F.when(on == 0, col(f"{y}_anom")))).alias("delta_mean"),
    )


def leave_longest_out(rows: DataFrame, flag: str, y: str, lag: int, season: str, entity,
                      key: str = "week_start") -> DataFrame:
    """The lagged difference with all rows and without the longest episode, side by side."""
    full = lagged_delta(rows, flag, y, lag, season, entity, key).withColumn("variant", F.lit("all"))
    dropped = lagged_delta(drop_longest(rows, entity, key=key), flag, y, lag, season, entity, key)
    return full.unionByName(dropped.withColumn("variant", F.lit("without_longest")))
