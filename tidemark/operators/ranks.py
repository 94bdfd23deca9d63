"""Ranks and running sums inside groups of any size.

A window function puts a whole group into one task. Here a group is range-partitioned over
as many tasks as its rows need; each task ranks its own stretch and the stretches' totals,
one row per (task, group), give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import durable, shuffle_width


def running(df: DataFrame, group: list[str], order: list[Column], measure: Column | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``_rank`` (1..n in the group, by ``order``) and, with ``measure``, ``_cum`` (running sum, own row included).

    ``order`` must be total (end with a unique column), or ties get an arbitrary order. Null group
    values form a group of their own; a null measure counts as 0. An empty table gives an empty table.
    """
    n = parts or max(2, shuffle_width(df.sparkSession))
    keyed = df.withColumn("_m", F.coalesce(measure.cast("double"), F.lit(0.0)) if measure is not None else F.lit(0.0))
    # a stretch is a range of (group, order); the partition's number tells the stretches' sequence
    cut = durable(keyed.repartitionByRange(n, *[F.col(g) for g in group], *order).withColumn("_pid", F.spark_partition_id()), "stretches")
    w = W.partitionBy("_pid", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn("_r", F.count(F.lit(1)).over(w)).withColumn("_c", F.sum("_m").over(w))
    totals = cut.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_n"), F.sum("_m").alias("_t"))
    # one row per stretch: at most (tasks + groups) rows, so a window over them is small even for a hot group
    wo = W.partitionBy(*group).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1) if group else W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_pid", *group, F.coalesce(F.sum("_n").over(wo), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_t").over(wo), F.lit(0.0)).alias("_t0"))
    on = F.col("l._pid") == F.col("o._pid")
    for g in group:
        on &= F.col(f"l.{g}").eqNullSafe(F.col(f"o.{g}"))
    out = local.alias("l").join(offsets.alias("o"), on)
    cols = [F.col(f"l.{c}") for c in df.columns] + [(F.col("l._r") + F.col("o._n0")).alias("_rank")]
    if measure is not None:
        cols.append((F.col("l._c") + F.col("o._t0")).alias("_cum"))
    return out.select(*cols)
