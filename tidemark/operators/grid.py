"""Irregular readings onto a regular grid, gaps filled by low-rank factorisation.

Per frequency the readings form a matrix of series by periods. Alternating least squares fits
row factors per series and column factors per period. Rows grow with the data and stay
distributed; columns are bounded by the calendar, so the column factors travel to the tasks and
the column step adds up each task's normal equations, one small row per period.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.periods import period_index, period_start, stated
from tidemark.session import durable

RANK, ITERATIONS, RIDGE = 3, 4, 0.2
#: Series that must have read a period before its gaps are filled, and readings a series needs itself.
MIN_SERIES, MIN_READINGS = 3, 6

Factors = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]  # frequency: periods, factors, support


def series_frequency(obs: DataFrame) -> DataFrame:
    """(series_id, freq): the frequency most rows of a series state; of equals the finer. Series that state none are left out."""
    n = obs.withColumn("freq", stated(F.col("frequency"))).where("freq is not null and series_id is not null").groupBy("series_id", "freq").count()
    fine = F.when(F.col("freq") == "daily", 5).when(F.col("freq") == "weekly", 4).when(F.col("freq") == "monthly", 3).when(F.col("freq") == "quarterly", 2).otherwise(1)
    return n.groupBy("series_id").agg(F.max_by("freq", F.struct("count", fine)).alias("freq"))


def _scaled(x: np.ndarray) -> tuple[float, float, np.ndarray]:
    mid = float(np.median(x))
    scale = float(np.median(np.abs(x - mid))) * 1.4826 or float(np.std(x)) or 1.0
    return mid, scale, np.clip((x - mid) / scale, -4, 4)


def _row_factor(v: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.linalg.solve(v.T @ v + RIDGE * len(z) * np.eye(v.shape[1]), v.T @ z)


def _column_sums(factors: Factors) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Row step, and the part of the column step's normal equations that one task can add up."""
    tri = np.triu_indices(RANK)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {f: np.zeros((len(p), len(tri[0]) + RANK + 1)) for f, (p, _, _) in factors.items()}
        for b in batches:
            for f, ps, xs in zip(b["freq"], b["ps"], b["xs"]):
                if len(ps) < MIN_READINGS:
                    continue
                periods, v, _ = factors[f]
                at = np.searchsorted(periods, ps)
                z = _scaled(np.asarray(xs))[2]
                u = _row_factor(v[at], z)
                add = np.concatenate([np.outer(u, u)[tri], u * 0, [1.0]])
                s = sums[f]
                s[at] += add
                s[at, len(tri[0]) : -1] += z[:, None] * u
        for f, s in sums.items():
            used = np.flatnonzero(s[:, -1])
            if len(used):
                yield pd.DataFrame({"freq": f, "p": factors[f][0][used]} | {f"c{k}": s[used, k] for k in range(s.shape[1])})

    return run


def _fill(factors: Factors) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sid, f, ps, xs in zip(b["series_id"], b["freq"], b["ps"], b["xs"]):
                ps, xs = np.asarray(ps), np.asarray(xs)
                every = np.arange(ps[0], ps[-1] + 1)
                value, status = np.full(len(every), np.nan), np.full(len(every), "missing", dtype=object)
                value[ps - ps[0]], status[ps - ps[0]] = xs, "observed"
                gap = np.flatnonzero(status == "missing")
                if len(gap) and len(ps) >= MIN_READINGS:
                    periods, v, support = factors[f]
                    mid, scale, z = _scaled(xs)
                    u = _row_factor(v[np.searchsorted(periods, ps)], z)
                    at = np.minimum(np.searchsorted(periods, every[gap]), len(periods) - 1)
                    ok = (periods[at] == every[gap]) & (support[at] >= MIN_SERIES)
                    value[gap[ok]], status[gap[ok]] = mid + scale * (v[at[ok]] @ u), "filled"
                yield pd.DataFrame({"series_id": sid, "freq": f, "p": every.astype("int32"), "value": value, "status": status})

    return run


def fit(rows: DataFrame) -> Factors:
    """Column factors of every frequency. What reaches the driver is one row per period of the calendar."""
    tri = np.triu_indices(RANK)
    seen = rows.select("freq", F.explode("ps").alias("p")).groupBy("freq", "p").count().toPandas()
    factors: Factors = {}
    for f, g in seen.groupby("freq"):
        p = np.sort(g["p"].to_numpy())
        # a fixed start: a level, a trend and waves of different length
        v = np.stack([np.ones(len(p)) if k == 0 else np.cos(p * (k * 0.7548776662466927) + k) for k in range(RANK)], axis=1)
        factors[f] = (p, v, np.zeros(len(p)))
    for _ in range(ITERATIONS):
        parts = rows.mapInPandas(_column_sums(factors), "freq string, p int, " + ", ".join(f"c{k} double" for k in range(len(tri[0]) + RANK + 1)))
        sums = parts.groupBy("freq", "p").agg(*[F.sum(c).alias(c) for c in parts.columns[2:]]).toPandas()
        for f, g in sums.groupby("freq"):
            p, v, support = factors[f]
            c = g.iloc[:, 2:].to_numpy()
            gram = np.zeros((len(c), RANK, RANK))
            gram[:, tri[0], tri[1]] = gram[:, tri[1], tri[0]] = c[:, : len(tri[0])]
            gram += RIDGE * np.eye(RANK) * np.maximum(c[:, -1], 1)[:, None, None]
            at = np.searchsorted(p, g["p"].to_numpy())
            v, support = v.copy(), support.copy()
            v[at] = np.linalg.solve(gram, c[:, len(tri[0]) : -1, None])[:, :, 0]
            support[at] = c[:, -1]
            factors[f] = (p, v, support)
    return factors


def regular_grid(obs: DataFrame) -> DataFrame:
    """(series_id, frequency, period_start, value, status): one row per series and period from its first to its last reading.

    status: observed (value exact: of the period's rows that of the latest date, realtime_start, fetched_at, obs_id),
    filled (estimated), or missing (too little support; value null). Null and NaN values are no readings. Rows without
    series or date, and series that state no known frequency, give nothing. An empty table gives an empty grid.
    Repeated rows change nothing.
    """
    ok = obs.where("value is not null and not isnan(value) and series_id is not null and date is not null")
    cells = ok.join(series_frequency(obs), "series_id").withColumn("p", period_index(F.col("freq"), F.col("date")))
    cells = cells.groupBy("series_id", "freq", "p").agg(F.max_by("value", F.struct("date", "realtime_start", "fetched_at", "obs_id")).alias("x"))
    # one array per series: a cell per period, so its length is bounded by the calendar
    rows = cells.groupBy("series_id", "freq").agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("c")).select("series_id", "freq", F.col("c.p").alias("ps"), F.col("c.x").alias("xs"))
    rows = durable(rows, "series")
    grid = rows.mapInPandas(_fill(fit(rows)), "series_id string, freq string, p int, value double, status string")
    return grid.select("series_id", F.col("freq").alias("frequency"), period_start(F.col("freq"), F.col("p")).alias("period_start"), F.when(~F.isnan("value"), F.col("value")).alias("value"), "status")


def missing_periods(grid: DataFrame) -> DataFrame:
    """(series_id, period_start) of the periods without a reading."""
    return grid.where("status <> 'observed'").select("series_id", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"))

