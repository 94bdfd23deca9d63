"""Stated frequencies and the periods of a regular grid, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First letters by which a stated frequency is known, and periods per year.
FREQUENCIES = {"daily": "d", "weekly": "w", "monthly": "m", "quarterly": "q", "annual": "a"}
PER_YEAR = {"daily": 252, "weekly": 52, "monthly": 12, "quarterly": 4, "annual": 1}


def stated(c: Column) -> Column:
    """daily, weekly, monthly, quarterly, annual, or null, from any spelling ("D", "wk", "mth", "quarterly, end of period")."""
    t = F.lower(F.trim(c))
    return (
        F.when(t.rlike(r"^(d$|dly|dai|business day|bus\. day)"), "daily")
        .when(t.rlike(r"^(w$|wk|wee)"), "weekly")
        .when(t.rlike(r"^(m$|mth|mon|mo$)"), "monthly")
        .when(t.rlike(r"^(q$|qtr|qua)"), "quarterly")
        .when(t.rlike(r"^(a$|y$|yr|yea|ann)"), "annual")
    )


def period_index(freq: Column, day: Column) -> Column:
    """Running number of the period of ``freq`` that holds ``day``; weekend days count as the Friday before."""
    u = F.unix_date(day) + 3  # day 0 of this count is a Monday
    week = F.floor(u / 7).cast("int")
    return (
        F.when(freq == "daily", week * 5 + F.least(F.pmod(u, F.lit(7)), F.lit(4)))
        .when(freq == "weekly", week)
        .when(freq == "monthly", F.year(day) * 12 + F.month(day) - 1)
        .when(freq == "quarterly", F.year(day) * 4 + F.quarter(day) - 1)
        .when(freq == "annual", F.year(day))
    ).cast("int")


def period_start(freq: Column, index: Column) -> Column:
    week = F.floor(index / 5)
    return (
        F.when(freq == "daily", F.date_from_unix_date((week * 7 + F.pmod(index, F.lit(5)) - 3).cast("int")))
        .when(freq == "weekly", F.date_from_unix_date((index * 7 - 3).cast("int")))
        .when(freq == "monthly", F.make_date(F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1)))
        .when(freq == "quarterly", F.make_date(F.floor(index / 4).cast("int"), (F.pmod(index, F.lit(4)) * 3 + 1).cast("int"), F.lit(1)))
        .when(freq == "annual", F.make_date(index.cast("int"), F.lit(1), F.lit(1)))
    )
