import datetime

import numpy as np

from tidemark.operators.grid import missing_periods, regular_grid

SCHEMA = "obs_id long, series_id string, date date, value double, realtime_start date, fetched_at timestamp, frequency string, source string"
T = datetime.datetime(2024, 1, 1)


def obs(sid, days, values, freq):
    return [(hash((sid, d)) % 10**9, sid, d, v, d, T, freq, "x") for d, v in zip(days, values)]


def test_low_rank_gaps_are_filled_and_unsupported_marked(spark):
    months = [datetime.date(2015 + k // 12, k % 12 + 1, 15) for k in range(72)]
    level = np.sin(np.arange(72) / 5)
    data, truth = [], {}
    for s in range(8):
        values = 10 * s + (s + 1) * level
        for k in range(72):
            if (k * 7 + s * 5) % 11 == 0 and 0 < k < 71:
                truth[(f"s{s}", months[k].replace(day=1))] = values[k]
            else:
                data += obs(f"s{s}", [months[k]], [float(values[k])], ["monthly", "M", "mth"][k % 3])
    data += obs("lone", [datetime.date(2030, 1, 1), datetime.date(2030, 3, 2)], [1.0, 2.0], "Monthly")
    g = {(r.series_id, r.period_start): r for r in regular_grid(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(g[k].status == "filled" and abs(g[k].value - v) < 0.35 * (int(k[0][1]) + 1) for k, v in truth.items())
    assert g[("lone", datetime.date(2030, 2, 1))].status == "missing" and g[("lone", datetime.date(2030, 2, 1))].value is None
    assert all(r.status == "observed" for k, r in g.items() if k not in truth and k != ("lone", datetime.date(2030, 2, 1)))
    assert next(r for k, r in g.items() if k == ("s1", datetime.date(2015, 2, 1))).value == 10 + 2 * level[1]


def test_weekend_dates_weeks_quarters_nulls(spark):
    d = datetime.date
    data = obs("d", [d(2024, 1, 5), d(2024, 1, 13), d(2024, 1, 16)], [1.0, 2.0, 3.0], "daily, close")  # Fri, Sat (counts as Fri 12), Tue
    data += obs("w", [d(2024, 1, 3), d(2024, 1, 21)], [1.0, 2.0], "wk") + obs("q", [d(2023, 2, 1), d(2023, 9, 30)], [1.0, 2.0], "QUARTERLY")
    data += obs("n", [d(2024, 1, 1), d(2024, 3, 1)], [None, float("nan")], "monthly") + obs("u", [d(2024, 1, 1)], [1.0], None) + obs(None, [d(2024, 1, 1)], [1.0], "daily")
    got = {(r.series_id, r.period_start) for r in missing_periods(regular_grid(spark.createDataFrame(data, SCHEMA))).collect()}
    assert got == {("d", f"2024-01-{x:02d}") for x in (8, 9, 10, 11, 15)} | {("w", "2024-01-08"), ("q", "2023-04-01")}


def test_empty(spark):
    assert regular_grid(spark.createDataFrame([], SCHEMA)).collect() == []
