"""Implausible readings: spikes, stuck values and physically impossible values, per series.

Each series is judged against its own movement by a robust exponentially weighted control chart:
a suspected reading is clipped before it moves the chart's mean and scale. Run-length counters
tell a brief departure from a lasting shift, and a stuck sensor from a series that rarely moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chart: limit and clip in scales, weights of a new reading in mean and scale.
LIMIT, CLIP, MEAN_WEIGHT, SCALE_WEIGHT = 6.5, 3.0, 0.5, 0.03
#: Longest brief departure and shortest stuck run, in readings; share of standing still over which a series stays put by nature, and least share of the series outside its stuck runs.
BRIEF, STUCK, STILL, MOVING = 3, 8, 0.2, 0.4
#: A peak returns yearly if so many and this share of the other years have one of like size, within so many days (or one spacing) of its date.
SEASON_DAYS, SEASON_HITS, SEASON_SHARE, SEASON_RATIO = 7, 3, 0.6, 2.0


def impossible(units: Column, value: Column) -> Column:
    """Fixed rules: Index above 0, Percent in 0..100, Thousands of Persons and Billions of Dollars not below 0."""
    u = F.lower(F.trim(units))
    return F.when(u == "index", value <= 0).when(u == "percent", (value < 0) | (value > 100)).when(u.isin("thousands of persons", "billions of dollars"), value < 0).otherwise(False)


def _start_scale(x: np.ndarray) -> float:
    d = np.abs(np.diff(x))
    d = d[d > 0]
    return float(np.median(d)) if len(d) else 0.0


def chart(values: list[np.ndarray]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Brief departures (first reading, last), and the chart's level and scale before each reading.

    ``values``: the distinct values reported for each reading, in order of date.
    """
    n = len(values)
    mids = np.array([v[len(v) // 2] for v in values])
    scale = _start_scale(mids)
    levels, scales = np.zeros(n), np.zeros(n)
    if n < 5 or scale == 0.0:
        return [], levels, scales
    least = scale * 0.5
    level = float(np.median(mids[: min(n, 7)]))
    out, i = [], 0
    while i < n:
        levels[i], scales[i] = level, scale
        v = values[i]
        gap = np.abs(v - level)
        near = float(v[np.argmin(gap)])
        if gap.min() <= LIMIT * scale:
            if gap.max() > LIMIT * scale:
                out.append((i, i))  # one release departs, another doesn't
            e = near - level
            clipped = max(-CLIP * scale, min(CLIP * scale, e))
            level += MEAN_WEIGHT * clipped
            if e != 0.0:
                scale = max(least, scale + SCALE_WEIGHT * (1.25 * abs(clipped) - scale))
            i += 1
            continue
        # run-length counter: how many readings stay away
        back = next((j for j in range(i + 1, min(n, i + BRIEF + 1)) if np.abs(values[j] - level).min() <= LIMIT * scale), None)
        if back is not None:
            out.append((i, back - 1))
            levels[i:back], scales[i:back] = level, scale
            i = back
        else:
            # a lasting shift; readings off both the old and the new level are a departure of their own
            ahead = mids[i : i + 2 * BRIEF + 2]
            new = float(np.median(ahead)) if len(ahead) > BRIEF else near
            odd = next((k for k in range(len(ahead)) if np.abs(values[i + k] - new).min() <= LIMIT * scale), 0)
            if 1 <= odd <= BRIEF:
                out.append((i, i + odd - 1))
                levels[i : i + odd], scales[i : i + odd] = level, scale
            level = new
            i += max(1, odd) if odd <= BRIEF else 1
    return out, levels, scales


def _seasonal(events: list[tuple[int, int, float]], days: np.ndarray) -> set[int]:
    """Those of the departures (first day, last day, size) that come back at the same time of other years."""
    out = set()
    slack = max(SEASON_DAYS, 1.1 * float(np.median(np.diff(days))) if len(days) > 1 else 0.0)
    reach = int((days[-1] - days[0]) // 365) + 1 if len(days) else 0
    for k, (first, last, dev) in enumerate(events):
        covered = hits = 0
        for years in [*range(-reach, 0), *range(1, reach + 1)]:
            lo, hi = first + years * 365.2425 - slack, last + years * 365.2425 + slack
            a, b = np.searchsorted(days, [lo, hi])
            if a == b:
                continue
            covered += 1
            hits += any(f <= hi and lo <= t and dev * v > 0 and 1 / SEASON_RATIO <= v / dev <= SEASON_RATIO for f, t, v in events)
        if hits >= SEASON_HITS and hits / covered >= SEASON_SHARE:
            out.add(k)
    return out


def stuck_runs(values: list[np.ndarray]) -> list[tuple[int, int, float]]:
    """Runs (first, last, value) of at least STUCK readings that report one value, in a series that otherwise moves."""
    n, runs, i = len(values), [], 0
    while i < n:
        best = (i, float(values[i][0]))
        for v in values[i]:
            j = i
            while j + 1 < n and v in values[j + 1]:
                j += 1
            if j > best[0]:
                best = (j, float(v))
        runs.append((i, *best))
        i = max(best[0], i + 1) if best[0] > i else i + 1
    long = [r for r in runs if r[1] - r[0] + 1 >= STUCK]
    inside = sum(r[1] - r[0] for r in long)
    still = sum(r[1] - r[0] for r in runs) - inside
    moves = n - 1 - inside
    # the rest of the series must be there to tell how it otherwise moves
    return long if moves >= MOVING * (n - 1) and moves > 0 and still / moves <= STILL else []


def judge(days: np.ndarray, values: list[np.ndarray]) -> list[tuple[int, float, str]]:
    """(day, value, reason) of a series' implausible values; the chart runs both ways and both must agree."""
    got: dict[tuple[int, float], str] = {}
    n = len(values)
    forward, lf, sf = chart(values)
    backward, lb, sb = chart(values[::-1])
    lb, sb = lb[::-1], sb[::-1]
    runs = sorted({*forward, *((n - 1 - b, n - 1 - a) for a, b in backward)})
    events, cells = [], []
    for i in sorted({i for a, b in runs for i in range(a, b + 1)}):
        # both charts must find the value far off, whichever of them saw it leave and return
        far = [float(v) for v in values[i] if abs(v - lf[i]) > LIMIT * sf[i] > 0 and abs(v - lb[i]) > LIMIT * sb[i] > 0]
        if far:
            events.append((int(days[i]), int(days[i]), max((v - (lf[i] + lb[i]) / 2 for v in far), key=abs)))
            cells.append([(i, v) for v in far])
    season = _seasonal(events, days)
    for k, at in enumerate(cells):
        if k not in season:
            got.update({(int(days[i]), v): "spike" for i, v in at})
    for a, b, v in stuck_runs(values):
        for i in range(a, b + 1):
            if v in values[i]:
                got.setdefault((int(days[i]), v), "stuck")
    return [(d, v, r) for (d, v), r in got.items()]


def _judge_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for sid, line in zip(b["series_id"], b["line"]):
            days = np.array([r["d"] for r in line])
            out += [(sid, *x) for x in judge(days, [np.sort(np.asarray(r["v"], dtype=float)) for r in line])]
        yield pd.DataFrame(out, columns=["series_id", "d", "value", "reason"]).astype({"series_id": "object", "d": "int32", "value": "float64", "reason": "object"})


def implausible(obs: DataFrame) -> DataFrame:
    """(obs_id, reason): impossible, spike or stuck, for every row (each release and repeated fetch for itself).

    Null and NaN values, and rows without series or date, are never flagged by the chart; a null or NaN value never at
    all. Units are those most of the series' rows state; without any, no limit holds. Series of fewer than five
    readings, and constant ones, have no spikes. Repeated rows share one verdict. An empty table gives no rows.
    """
    ok = obs.where("value is not null and not isnan(value) and series_id is not null").select("obs_id", "series_id", "date", "value", "units")
    units = ok.where("units is not null").groupBy("series_id", "units").count().groupBy("series_id").agg(F.max_by("units", F.struct("count", "units")).alias("_units"))
    # (series, date, value) first, in the map tasks: what then meets in one row is bounded by the calendar
    cells = ok.where("date is not null").groupBy("series_id", "date", "value").agg(F.lit(1).alias("one"))
    days = cells.groupBy("series_id", "date").agg(F.collect_list("value").alias("v"))
    lines = days.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_date("date").alias("d"), "v"))).alias("line"))
    flagged = lines.mapInPandas(_judge_all, "series_id string, d int, value double, reason string").withColumn("date", F.date_from_unix_date("d")).drop("d")
    rows = ok.join(units, "series_id", "left").join(flagged, ["series_id", "date", "value"], "left")
    reason = F.when(impossible(F.col("_units"), F.col("value")), "impossible").otherwise(F.col("reason"))
    return rows.select("obs_id", reason.alias("reason")).where("reason is not null")
