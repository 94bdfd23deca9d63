import datetime

import numpy as np
import pytest

from tidemark.operators.spikes import implausible, judge

DAY = datetime.date(2020, 1, 1)
SCHEMA = "obs_id long, series_id string, date date, value double, units string, extra string"


def rows(values, sid="s", units=None, start=0):
    return [(start + k, sid, DAY + datetime.timedelta(k), v, units, "x") for k, v in enumerate(values)]


def walk(n, seed=1):
    return (100 + np.cumsum(np.random.default_rng(seed).normal(0, 0.3, n))).tolist()


def found(spark, data):
    return {r.obs_id: r.reason for r in implausible(spark.createDataFrame(data, SCHEMA)).collect()}


def test_spike_stuck_shift(spark):
    v = walk(200)
    v[50], v[80], v[81], v[82] = 160.0, 20.0, 21.0, 20.5
    v[120:130] = [v[119]] * 10
    v[150:] = [x + 40 for x in v[150:]]  # a lasting shift is no case
    got = found(spark, rows(v))
    assert {k for k, r in got.items() if r == "spike"} == {50, 80, 81, 82}
    assert {k for k, r in got.items() if r == "stuck"} == set(range(119, 130))


def test_yearly_peak_and_resting_rate_are_no_cases():
    rng = np.random.default_rng(3)
    months = np.array([(datetime.date(2000 + k // 12, k % 12 + 1, 1) - datetime.date(1970, 1, 1)).days for k in range(144)])
    x = 50 + np.cumsum(rng.normal(0, 0.2, 144)) + np.where(np.arange(144) % 12 == 6, 8.0, 0.0)
    assert judge(months, [np.array([v]) for v in x]) == []
    rate = np.repeat([1.0, 1.25, 1.5, 1.25, 1.0], 20)
    assert judge(np.arange(100), [np.array([v]) for v in rate]) == []


def test_physical_limits_nulls_and_releases(spark):
    v = walk(60)
    data = rows(v, "i", "Index") + [(900, "i", DAY + datetime.timedelta(10), -3.0, None, "x"), (901, "i", DAY, None, "Index", "x"), (902, "i", DAY, float("nan"), "Index", "x"), (903, None, DAY, 5.0, "Index", "x"), (904, "p", DAY, 101.0, "Percent", "x"), (905, "p", None, 50.0, "Percent", "x")]
    got = found(spark, data)
    assert got == {900: "impossible", 904: "impossible"}


def test_repeats_share_a_verdict_and_empty(spark):
    v = walk(100)
    v[40] = 500.0
    data = rows(v) + [(1000 + k, "s", DAY + datetime.timedelta(40), 500.0, None, "x") for k in range(5)]
    assert found(spark, data) == {40: "spike"} | {1000 + k: "spike" for k in range(5)}
    assert found(spark, []) == {}


@pytest.mark.parametrize("n", [1, 2, 4])
def test_short_series(spark, n):
    assert found(spark, rows([1.0, 900.0, 1.0, 2.0][:n])) == {}
