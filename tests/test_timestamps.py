import random

import pytest

from tidemark.operators.timestamps import best_path, normalise, readings

NY = "America/New_York"


@pytest.mark.parametrize(
    ("text", "zone", "order", "want"),
    [
        ("2026-04-15T13:03:58Z", NY, "mdy", 1776258238000000), ("2026-04-15 09:03:58", NY, "mdy", 1776258238000000), ("1776258238", None, None, 1776258238000000), ("1776258238123", None, None, 1776258238123000),
        ("1776258238.250", None, None, 1776258238250000), ("15/04/2026 13:03:58", "UTC", "dmy", 1776258238000000), ("04/15/2026 1:03:58 PM", "UTC", "mdy", 1776258238000000), ("15.04.2026 13:03", "UTC", "mdy", 1776258180000000),
        ("Wed, 15 Apr 2026 09:03:58 EDT", "Asia/Tokyo", "ymd", 1776258238000000), ("April 15, 2026 9:03 AM ET", "Asia/Tokyo", "ymd", 1776258180000000), ("20260415T130358Z", None, None, 1776258238000000),
        ("2026-04-15T09:03:58−04:00", None, None, 1776258238000000), ("2026-04-15t13:03:58,000z", None, None, 1776258238000000), (" 2026-04-15T13:03:58Z ", None, None, 1776258238000000),
        ("2026-04-15 09:03:58 America/New_York", "UTC", None, 1776258238000000), ("2026-04-15T09:03:58-04:00[America/New_York]", None, None, 1776258238000000), ("2026-04-15", NY, "mdy", 1776225600000000),
        # an hour twice: the first; a skipped one: the offset before the change; an abbreviation decides
        ("2025-11-02 01:30:00", NY, "mdy", 1762061400000000), ("2025-03-09 02:30:00", NY, "mdy", 1741505400000000), ("Sun, 02 Nov 2025 01:30:00 EST", NY, "mdy", 1762065000000000),
    ],
)
def test_one_instant(text, zone, order, want):
    got = readings(text, zone, order)
    assert got[0][1:] == (want, 0.0) and all(r[2] > 0 for r in got[1:])


@pytest.mark.parametrize("text", [None, "", "  ", "unknown", "--", "N/A", "25:61", "2024-06-31", "2025-02-30 10:15:00", "0000-00-00 00:00:00", "2025-13-04T08:00:00Z", "2025-04-12T27:30:00Z", "yesterday", "13/13/2025", "x" * 5000])
def test_no_time(text):
    assert readings(text, "UTC", "dmy") == []


def test_path_follows_order_and_format(spark):
    # without a register entry the days in order tell that the month comes first
    rows = [(k, f"0{m}/0{d}/2026 10:00", "s") for k, (m, d) in enumerate([(3, 1), (3, 2), (3, 4), (3, 5), (3, 7)])]
    df = spark.createDataFrame(rows, "id long, text string, src string").selectExpr("*", "cast(null as string) as zone", "cast(null as string) as ord", "'clash' as format")
    got = {r.id: r.format for r in normalise(df, "id", "text", "src", "zone", "ord").collect()}
    assert set(got.values()) == {"mdy"} and len(got) == 5
    assert best_path([[("a", 0, 0.0)], [("b", 10, 0.0), ("a", 10, 0.0)]]) == [0, 1]


def test_stretches_equal_one_path(spark):
    """Cut at its anchors a source gives what one path through all its records gives."""
    rnd = random.Random(3)
    rows = []
    for k in range(600):
        m, d, h = 1 + k // 60, 1 + (k // 3) % 20, rnd.randint(0, 23)
        text = rnd.choice([f"{m:02}/{d:02}/2026 {h:02}:00", f"{d:02}/{m:02}/2026 {h:02}:00", f"2026-{m:02}-{d:02}T{h:02}:00:00Z", "no time", f"{m:02}/{d:02}/2026"])
        rows.append((k, text, rnd.choice(["a", "a", "b"]), rnd.choice(["mdy", None, None])))
    df = spark.createDataFrame(rows, "id long, text string, src string, ord string").selectExpr("*", "'UTC' as zone")
    got = {r.id: r.utc_us for r in normalise(df, "id", "text", "src", "zone", "ord").collect()}
    want = {}
    for src in "ab":
        own = [(k, o) for k, t, s, order in rows if s == src and (o := readings(t, "UTC", order))]
        want |= {k: o[x][1] for (k, o), x in zip(own, best_path([o for _, o in own]))}
    assert got == want and len({len(o) for _, o in own}) > 1


def test_empty(spark):
    df = spark.createDataFrame([], "id long, text string, src string, zone string, ord string")
    assert normalise(df, "id", "text", "src", "zone", "ord").collect() == []
