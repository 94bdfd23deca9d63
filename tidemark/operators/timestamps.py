"""Text timestamps of many kinds to one UTC instant.

Every value yields all its valid interpretations as an array of (format, microseconds, cost): both
orders of day and month, seconds and milliseconds, both instants of a local time that occurs twice.
The path of least cost through a source's records in order (Viterbi) chooses: a change of format
costs, a step back in time does, and so does a reading that the source's register entry speaks
against. Values with one interpretation are anchors: the path falls apart there, so the stretches
between anchors are decoded each on its own, exactly, wherever they lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import running
from tidemark.session import durable, shuffle_width

# Offsets in minutes of zone abbreviations, and zones that names without season stand for.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540,
    "HKT": 480, "SGT": 480, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
REGIONS = {"ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles"}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
MONTH_NAMES = {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())} | MONTHS | {"sept": 9}
DAYS = {"mon", "tue", "wed", "thu", "fri", "sat", "sun", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "tues", "thur", "thurs"}

SWITCH, BACK = 1.0, 1.5
#: What a reading costs that the register entry, or the rule for hours that occur twice, speaks against: more than its neighbours on either side can make up for.
AGAINST = 6.0
#: A step back of up to this long is ordinary delay of a feed.
SLACK_US = 86_400_000_000

TIME = r"(?:(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?)"
ZONE = r"(?:\s*(?P<off>[+-]\d{2}:?\d{2}|[+-]\d{2})|\s*(?P<z>[Zz])(?![A-Za-z])|\s+(?P<name>[A-Za-z]+(?:/[A-Za-z_+-]+){1,2}|[A-Za-z]{2,5}))?(?:\s*\[(?P<br>[A-Za-z_/+-]+)\])?"
TAIL = rf"(?:(?:\s*,\s*|[Tt]|\s+){TIME}{ZONE})?$"
FORMS = [
    ("iso", re.compile(r"^(?P<y>\d{4})-(?P<mo>\d{1,2})-(?P<d>\d{1,2})" + TAIL)),
    ("slash", re.compile(r"^(?P<a>\d{1,4})/(?P<b>\d{1,2})/(?P<c>\d{1,4})" + TAIL)),
    ("dot", re.compile(r"^(?P<d>\d{1,2})\.(?P<mo>\d{1,2})\.(?P<y>\d{4})" + TAIL)),
    ("basic", re.compile(r"^(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})[Tt](?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d{1,9}))?(?P<ap>(?!))?" + ZONE + "$")),
    ("rfc", re.compile(r"^(?:(?P<wd>[A-Za-z]+)\.?,?\s+)?(?P<d>\d{1,2})[\s-](?P<mon>[A-Za-z]{3,9})\.?,?[\s-](?P<y>\d{4})" + TAIL)),
    ("us", re.compile(r"^(?:(?P<wd>[A-Za-z]+)\.?,\s+)?(?P<mon>[A-Za-z]{3,9})\.?\s+(?P<d>\d{1,2}),?\s+(?P<y>\d{4})" + TAIL)),
]
NUMBER = re.compile(r"^-?\d{1,16}(?:\.\d{1,9})?$")
EPOCH = datetime(1970, 1, 1)
ONE_US = timedelta(microseconds=1)


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _instants(local: datetime, zone: str | None) -> list[int]:
    """Local time in a zone: the first instant, and the second of an hour that occurs twice. A skipped one has the offset before the change only."""
    z = _zone(zone or "UTC")
    if z is None:
        return []
    at = (local - EPOCH) // ONE_US
    first, second = z.utcoffset(local) // ONE_US, z.utcoffset(local.replace(fold=1)) // ONE_US
    return [at - first] if second >= first else [at - first, at - second]


def _offset(m: dict[str, str | None]) -> tuple[bool, int | None, str | None]:
    """(zone stated, its offset in minutes, or the region)."""
    if m.get("off"):
        o = m["off"].replace(":", "")
        minutes = int(o[1:3]) * 60 + int(o[3:5] or 0)
        if int(o[1:3]) > 18 or int(o[3:5] or 0) > 59:
            raise ValueError
        return True, -minutes if o[0] == "-" else minutes, None
    if m.get("z"):
        return True, 0, None
    for n in (m.get("name"), m.get("br")):
        if n:
            if n.upper() in ABBREVIATIONS:
                return True, ABBREVIATIONS[n.upper()], None
            if n.upper() in REGIONS:
                return True, None, REGIONS[n.upper()]
            if "/" in n and _zone(n) is not None:
                return True, None, n
            raise ValueError
    return False, None, None


Reading = tuple[str, int, float]


def _build(kind: str, m: dict[str, str | None], y: int, mo: int, d: int, zone: str | None, cost: float = 0.0) -> list[Reading]:
    h = int(m.get("h") or 0)
    if m.get("ap"):
        if not 1 <= h <= 12:
            return []
        h = h % 12 + (12 if m["ap"] in "Pp" else 0)
    frac = int((m.get("f") or "0").ljust(6, "0")[:6])
    try:
        local = datetime(y, mo, d, h, int(m.get("mi") or 0), int(m.get("s") or 0), frac)
        stated, minutes, region = _offset(m)
        if minutes is not None:
            return [(kind, (local - EPOCH) // ONE_US - minutes * 60_000_000, cost)]
        return [(kind, us, cost + AGAINST * k) for k, us in enumerate(_instants(local, region if stated else zone))]
    except (ValueError, OverflowError):
        return []


def readings(text: str | None, zone: str | None, order: str | None) -> list[Reading]:
    """All valid interpretations as (format, UTC microseconds, cost), the likeliest first; none for what is not a time.

    ``zone`` and ``order`` (mdy, dmy, ymd) come from the source's register entry. Without a zone, UTC is meant. An order
    of day and month that the register speaks against is an interpretation too, at the cost AGAINST; without an order
    both are free. Numbers are seconds or milliseconds, whichever lie before the year 10000; seconds of eleven figures
    or more, and milliseconds of fewer, cost AGAINST.
    """
    if text is None:
        return []
    t = re.sub(r"\s+", " ", text).strip().replace("−", "-")
    if not t:
        return []
    if NUMBER.match(t):
        whole, _, part = t.partition(".")
        n, sign = int(whole), -1 if t[0] == "-" else 1
        long = abs(n) >= 10**11
        both = [("seconds", n * 1_000_000 + sign * int(part.ljust(6, "0")[:6] or 0), AGAINST if long else 0.0), ("millis", n * 1000 + sign * int(part.ljust(3, "0")[:3] or 0), 0.0 if long else AGAINST)]
        return sorted((r for r in both if abs(r[1]) < 253_402_300_800_000_000), key=lambda r: r[2])
    for kind, form in FORMS:
        m = form.match(t)
        if not m:
            continue
        g = m.groupdict()
        if g.get("wd") and g["wd"].lower() not in DAYS:
            return []
        if kind != "slash":
            mo = MONTH_NAMES.get(g["mon"].lower()) if "mon" in g else int(g["mo"])
            return _build(kind, g, int(g["y"]), mo, int(g["d"]), zone) if mo else []
        a, b, c = int(g["a"]), int(g["b"]), int(g["c"])
        if len(g["a"]) == 4:
            return _build("ymd", g, a, b, c, zone)
        if len(g["c"]) != 4:
            return []
        # a register entry that orders otherwise (ymd) says nothing on dates that end in the year
        told = order if order in ("mdy", "dmy") else None
        out = [r for o, (mo, d) in (("mdy", (a, b)), ("dmy", (b, a))) for r in _build(o, g, c, mo, d, zone, AGAINST if told and o != told else 0.0)]
        # what the register's order makes no date at all is none, whatever the other order says
        return sorted(out, key=lambda r: r[2]) if not told or any(r[0] == told for r in out) else []
    return []


def best_path(options: list[list[tuple[str, int, float]]]) -> list[int]:
    """Index of the chosen interpretation of each record (records without any are left out beforehand)."""
    cost, back = [o[2] for o in options[0]], []
    for prev, cur in zip(options, options[1:]):
        step, arg = [], []
        for fmt, us, own in cur:
            ways = [c + (SWITCH if p[0] != fmt else 0.0) + (BACK if us < p[1] - SLACK_US else 0.0) for c, p in zip(cost, prev)]
            k = min(range(len(ways)), key=ways.__getitem__)
            step.append(ways[k] + own)
            arg.append(k)
        cost = step
        back.append(arg)
    k = min(range(len(cost)), key=cost.__getitem__)
    path = [k]
    for arg in reversed(back):
        k = arg[k]
        path.append(k)
    return path[::-1]


OPTIONS = "array<struct<fmt: string, us: bigint, cost: double>>"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        o = [readings(t, z, k) for t, z, k in zip(b["_text"], b["_zone"], b["_order"])]
        some = np.array([bool(x) for x in o], dtype=bool)
        yield pd.DataFrame({"_src": b["_src"][some], "_id": b["_id"][some], "_o": [[{"fmt": f, "us": u, "cost": c} for f, u, c in x] for x in o if x]})


CHOSEN = "id bigint, format string, utc_us bigint, n_readings bigint"


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Readings of the ambiguous records of stretches that come in order: their anchors, first and last, are there only to be followed and met."""
    at, ids, options = None, [], []

    def chosen() -> list[tuple[int, str, int, int]]:
        path = best_path(options) if options else []
        return [(i, o[k][0], o[k][1], len(o)) for i, o, k in zip(ids, options, path) if len(o) > 1]

    def frame(got: list[tuple[int, str, int, int]]) -> pd.DataFrame:
        return pd.DataFrame(got, columns=["id", "format", "utc_us", "n_readings"]).astype({"id": "int64", "format": "object", "utc_us": "int64", "n_readings": "int64"})

    for b in batches:
        got = []
        for src, seg, i, o in zip(b["_src"], b["_seg"], b["_id"], b["_o"]):
            if (src, seg) != at:
                got += chosen()
                at, ids, options = (src, seg), [], []
            ids.append(i)
            options.append([(x["fmt"], x["us"], x["cost"]) for x in o])
        yield frame(got)
    yield frame(chosen())


def normalise(df: DataFrame, id_col: str, text_col: str, source_col: str, zone_col: str, order_col: str) -> DataFrame:
    """(id, format, utc_us, n_readings) of every row whose text is a time.

    Null, empty and blank texts, words, and impossible dates or times give no row. Rows without source form one
    sequence. Repeated ids each give a row. Records are decoded in order of id; a source of any size is cut at its
    records of one interpretation, which loses nothing, so results do not depend on partitioning.
    """
    q = df.select(
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_src"), F.col(id_col).cast("long").alias("_id"),
        F.col(text_col).alias("_text"), F.col(zone_col).alias("_zone"), F.col(order_col).alias("_order"),
    ).where("_text is not null")
    read = q.mapInPandas(_read, f"_src string, _id bigint, _o {OPTIONS}")
    lone = (F.size("_o") == 1).cast("int")
    # a record's stretch is told by the number of anchors before and with it
    at = durable(running(read, ["_src"], [F.col("_id"), lone], lone).select("_src", "_id", "_o", F.col("_cum").cast("long").alias("_seg")), "readings")
    open_ = durable(at.where("size(_o) > 1").select("_src", "_seg").distinct(), "open")
    ends = at.where("size(_o) = 1").withColumn("_seg", F.col("_seg") - 1).join(open_, ["_src", "_seg"], "left_semi").withColumn("_edge", F.lit(2))
    starts = at.join(open_, ["_src", "_seg"], "left_semi").withColumn("_edge", F.when(F.size("_o") == 1, 0).otherwise(1))
    met = starts.unionByName(ends).repartition(max(2, shuffle_width(df.sparkSession)), "_src", "_seg").sortWithinPartitions("_src", "_seg", "_id", "_edge")
    chosen = met.mapInPandas(_decode, CHOSEN)
    one = F.col("_o")[0]
    alone = at.where("size(_o) = 1").select(F.col("_id").alias("id"), one["fmt"].alias("format"), one["us"].alias("utc_us"), F.lit(1).cast("long").alias("n_readings"))
    return alone.unionByName(chosen)
