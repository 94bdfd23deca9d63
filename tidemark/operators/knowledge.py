"""Attributes as known at event time.

Events and attribute changes are stacked, sorted by entity, time and a stated tie priority
(changes before events of the same day), and the best attribute row known so far is carried
forward. Validity can end, so what is carried is the set of rows still valid, best first.

A busy entity is cut at calendar segments. What holds at a segment's start is brought in as
changes dated to that start: the best row that stays valid throughout (one per segment, found
by a running maximum over per-segment maxima) and the rows that end inside the segment.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import shuffle_width

#: Days in a segment. Rows valid over several segments count once in each, as an aggregate.
SEGMENT_DAYS = 92
CHANGE, EVENT = 0, 1


def _day(c: str | Column) -> Column:
    return F.unix_date(F.col(c) if isinstance(c, str) else c)


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One ordered pass. The heap holds the current segment's valid rows, best first; ended rows leave when they reach the top."""
    held, at = [], None
    for b in batches:
        got_e, got_o = [], []
        cols = [b[c].to_numpy() for c in ("_entity", "_seg", "_t", "_kind", "_until", "_id")] + [b["_key"].to_numpy()]
        for entity, seg, t, kind, until, ident, key in zip(*cols):
            if (entity, seg) != at:
                held, at = [], (entity, seg)
            if kind == CHANGE:
                heapq.heappush(held, (_Desc(key), until, ident))
                continue
            while held and held[0][1] < t:
                heapq.heappop(held)
            if held:
                got_e.append(ident)
                got_o.append(held[0][2])
        yield pd.DataFrame({"event_id": pd.Series(got_e, dtype="int64"), "attr_id": pd.Series(got_o, dtype="int64")})


class _Desc:
    """Text key in descending order."""

    __slots__ = ("k",)

    def __init__(self, k: str):
        self.k = k

    def __lt__(self, other: _Desc) -> bool:
        return self.k > other.k

    def __eq__(self, other: object) -> bool:
        return self.k == other.k


def as_known(events: DataFrame, attrs: DataFrame, segment_days: int = SEGMENT_DAYS) -> DataFrame:
    """(event_id, attr_id): for each event the best attribute row known and valid on its day.

    ``events``: event_id bigint, entity string, day date. ``attrs``: attr_id bigint, entity string,
    known date (first day the row may be used), until date (last day, null: open), and key struct, by
    whose fields, in order, the greatest row wins; nulls in the key lose. Rows without entity, day or
    known date match nothing; so do rows whose until is before known. Events without a valid row give
    no row. Repeated events each get theirs; ties in key go to the greater attr_id.
    """
    far = 10**7
    rank = _sortable(attrs)
    a = attrs.where("entity is not null and known is not null").select(
        F.col("entity").alias("_entity"), _day("known").alias("_t"), F.coalesce(_day("until"), F.lit(far)).alias("_until"), F.col("attr_id").alias("_id"), rank.alias("_key")
    ).where("_until >= _t")
    e = events.where("entity is not null and day is not null").select(F.col("entity").alias("_entity"), _day("day").alias("_t"), F.col("event_id").alias("_id"))
    last = e.agg(F.max("_t")).first()[0]
    if last is None:
        return events.sparkSession.createDataFrame([], "event_id bigint, attr_id bigint")
    seg = lambda c: F.floor(F.col(c) / segment_days).cast("int")
    top = int(last // segment_days)
    a = a.where(F.col("_t") <= last).withColumn("_until", F.when(F.col("_until") > last, far).otherwise(F.col("_until")))
    a = a.withColumn("_seg", seg("_t")).withColumn("_end", F.when(F.col("_until") == far, top + 1).otherwise(seg("_until")))
    best = F.max(F.struct("_key", "_id")).alias("_b")
    # valid through whole segments: the best of each segment is enough
    closed = a.where(F.col("_end").between(F.col("_seg") + 2, top)).select("_entity", F.explode(F.sequence(F.col("_seg") + 1, F.col("_end") - 1)).alias("_seg"), "_key", "_id").groupBy("_entity", "_seg").agg(best)
    opened = a.where(F.col("_end") > top).groupBy("_entity", "_seg").agg(best)
    need = e.select("_entity", seg("_t").alias("_seg")).distinct()
    w = W.partitionBy("_entity").orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    stacked = opened.unionByName(need.withColumn("_b", F.lit(None).cast(opened.schema["_b"].dataType))).groupBy("_entity", "_seg").agg(F.max("_b").alias("_b"))
    open_before = stacked.withColumn("_b", F.max("_b").over(w)).where("_b is not null").join(need, ["_entity", "_seg"], "left_semi")
    whole = open_before.unionByName(closed)
    change = lambda df, t, until: df.select("_entity", "_seg", t.alias("_t"), F.lit(CHANGE).alias("_kind"), until.alias("_until"), "_key", "_id")
    start = (F.col("_seg") * segment_days).cast("int")
    parts = [
        change(a, F.col("_t"), F.col("_until")),
        change(a.where((F.col("_end") > F.col("_seg")) & (F.col("_end") <= top)).withColumn("_seg", F.col("_end")), start, F.col("_until")),
        change(whole.select("_entity", "_seg", "_b.*"), start, F.lit(far)),
        e.select("_entity", seg("_t").alias("_seg"), "_t", F.lit(EVENT).alias("_kind"), F.lit(0).alias("_until"), F.lit("").alias("_key"), "_id"),
    ]
    line = parts[0]
    for p in parts[1:]:
        line = line.unionByName(p)
    line = line.select("_entity", "_seg", "_t", "_kind", F.col("_until").cast("long").alias("_until"), "_key", "_id")
    n = max(2, shuffle_width(events.sparkSession))
    tidy = line.repartition(n, "_entity", "_seg").sortWithinPartitions("_entity", "_seg", "_t", "_kind")
    return tidy.mapInPandas(_sweep, "event_id bigint, attr_id bigint")


def _sortable(attrs: DataFrame) -> Column:
    """The key struct and attr_id as one text that sorts as they do: dates, timestamps and whole numbers as fixed-width digits."""
    fields = [(f"key.{f.name}", f.dataType.typeName()) for f in attrs.schema["key"].dataType.fields] + [("attr_id", "long")]
    out = []
    for name, kind in fields:
        c = F.col(name)
        if kind == "date":
            c = F.unix_date(c)
        elif kind.startswith("timestamp"):
            c = F.unix_micros(c.cast("timestamp"))
        # shifted to be positive; null comes before all
        shifted = F.lpad((c.cast("decimal(20,0)") + F.lit("1" + "0" * 19).cast("decimal(20,0)")).cast("string"), 21, "0")
        out.append(F.coalesce(shifted, F.lit("0" * 21)))
    return F.concat(*out)
