"""Positional transforms and normalisations of long series, and the health of sources and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.periods import PER_YEAR
from tidemark.params import Feature, Source, relation

#: Rows per month in positional lags; weekly 4.33.
PER_MONTH = {"daily": 21.0, "weekly": 4.33, "monthly": 1.0, "quarterly": 1 / 3, "annual": 1 / 12}


def lag_rows(frequency: str, months: int) -> int:
    return max(1, round(PER_MONTH[frequency] * months))


def clean(c: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(c), c)


def latest_vintage(obs: DataFrame) -> DataFrame:
    """One row per series and date: that of the last fetch (ties: greatest value)."""
    w = W.partitionBy("series_id", "date").orderBy(F.col("fetched_at").desc_nulls_last(), F.col("value").desc_nulls_last())
    return obs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def transformed(transform: Column, freq: Column, value: Column, w: W, combos: set[tuple[str, str]]) -> Column:
    """The transform of each row's feature; lags are literals, one per combination in use, over one window order."""
    out = F.when(transform.isin("level", "spread"), value)
    for t, f in sorted(combos):
        here = (transform == t) & (freq == f)
        if t.startswith("diff_"):
            out = out.when(here, value - F.lag(value, lag_rows(f, int(t[5:-1]))).over(w))
        elif t == "yoy_pct_change":
            out = out.when(here, (F.try_divide(value, F.lag(value, lag_rows(f, 12)).over(w)) - 1) * 100)
    return out


def zscore(x: Column, least: Column, frame: W) -> Column:
    """(x - mean) / population deviation over the frame's non-null values; null under ``least`` of them or without spread."""
    return F.when(F.count(x).over(frame) >= least, F.try_divide(x - F.avg(x).over(frame), F.nullif(F.stddev_pop(x).over(frame), F.lit(0.0))))


def features(obs: DataFrame, sources: list[Source], defs: list[Feature]) -> DataFrame:
    """Rows of all features: one shuffle by feature, all lags and frames over the same order.

    Columns: feature_id, series_id, date, raw_value, transformed_value, normalized_value, transform, normalization,
    window_start, window_end, valid, reason. Reasons in order: missing_raw_value, insufficient_transform_history,
    insufficient_normalization_history, ok. A disabled feature or source, or a series without rows, gives one row
    without date. Frames never reach past the row itself. Null and NaN values count as missing; a repeated
    (series, date) counts once, by its last fetch.
    """
    spark = obs.sparkSession
    d = relation(spark, defs).withColumnRenamed("enabled", "f_on").withColumnRenamed("reason_disabled", "f_why")
    s = relation(spark, sources).select("series_id", "frequency", F.col("enabled").alias("s_on"), F.col("reason_disabled").alias("s_why"))
    d = F.broadcast(d.join(F.broadcast(s), "series_id"))
    freq = {x.series_id: x.frequency for x in sources}
    on = d.where("f_on and s_on")
    raw = latest_vintage(obs).select("series_id", "date", clean(F.col("value")).alias("raw_value"))
    w = W.partitionBy("feature_id").orderBy("date")
    x = raw.join(F.broadcast(on), "series_id").withColumn("transformed_value", transformed(F.col("transform"), F.col("frequency"), F.col("raw_value"), w, {(f.transform, freq[f.series_id]) for f in defs}))
    t = F.col("transformed_value")
    norm, start = F.when(F.col("normalization") == "none", t), F.when((F.col("normalization") == "none") & t.isNotNull(), F.col("date"))
    for n in sorted({(f.normalization, freq[f.series_id], f.min_observations) for f in defs if f.normalization != "none"}):
        kind, fr, k = n
        here = (F.col("normalization") == kind) & (F.col("frequency") == fr) & (F.col("min_observations") == k)
        if kind == "expanding_z":
            frame, least = w.rowsBetween(W.unboundedPreceding, 0), k
            first = F.when(F.count(t).over(frame) >= k, F.min(F.when(t.isNotNull(), F.col("date"))).over(frame))
        else:
            size = int(kind.rsplit("_", 1)[1][:-1]) * PER_YEAR[fr]
            frame, least = w.rowsBetween(-(size - 1), 0), min(k, size)
            first = F.coalesce(F.lag("date", size - 1).over(w), F.lag("date", least - 1).over(w))
        norm, start = norm.when(here, zscore(t, F.lit(least), frame)), start.when(here, first)
    reason = (
        F.when(F.col("raw_value").isNull(), "missing_raw_value").when(t.isNull(), "insufficient_transform_history")
        .when(F.col("normalized_value").isNull(), "insufficient_normalization_history").otherwise("ok")
    )
    cols = ["feature_id", "series_id", "date", "raw_value", "transformed_value", "normalized_value", "transform", "normalization", "window_start", "window_end", "valid", "reason"]
    rows = x.withColumn("normalized_value", norm).withColumn("window_start", start).withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok").withColumn("window_end", F.col("date")).select(cols)
    seen = raw.select("series_id").distinct().withColumn("_seen", F.lit(True))
    off = d.join(seen, "series_id", "left").where("not f_on or not s_on or _seen is null")
    why = F.when(~F.col("f_on"), F.coalesce("f_why", F.lit("disabled_feature"))).when(~F.col("s_on"), F.coalesce("s_why", F.lit("disabled_source"))).otherwise("missing_source_data")
    none = {"date": "date", "raw_value": "double", "transformed_value": "double", "normalized_value": "double", "window_start": "date", "window_end": "date"}
    off = off.select("feature_id", "series_id", "transform", "normalization", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit(False).alias("valid"), why.alias("reason"))
    return rows.unionByName(off.select(cols))


def feature_health(rows: DataFrame) -> DataFrame:
    """(feature_id, valid_count, invalid_count, latest_valid_date, usable, reasons): reasons as sorted "reason=count" text."""
    per = rows.groupBy("feature_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("v"), F.max(F.when(F.col("valid"), F.col("date"))).alias("d"))
    named = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "reason", "n"))), ",")
    return per.groupBy("feature_id").agg(F.sum("v").alias("valid_count"), (F.sum("n") - F.sum("v")).alias("invalid_count"), F.max("d").alias("latest_valid_date"), (F.sum("v") > 0).alias("usable"), named.alias("reasons"))


def source_health(obs: DataFrame, sources: list[Source], as_of: str) -> DataFrame:
    """(series_id, last_observation_date, days_since, missing_count, stale, usable, reason) of every configured source."""
    agg = obs.groupBy("series_id").agg(F.max(F.when(clean(F.col("value")).isNotNull(), F.col("date"))).alias("last_observation_date"), F.count_if(clean(F.col("value")).isNull()).alias("missing_count"))
    s = F.broadcast(relation(obs.sparkSession, sources))
    days = F.datediff(F.to_date(F.lit(as_of)), F.col("last_observation_date"))
    why = (
        F.when(~F.col("enabled"), F.coalesce("reason_disabled", F.lit("disabled"))).when(F.col("last_observation_date").isNull(), "no_observations")
        .when(F.col("days_since") > F.col("unusable_after_days"), "unusable_stale").when(F.col("days_since") > F.col("stale_after_days"), "stale").otherwise("fresh")
    )
    out = s.join(agg, "series_id", "left").withColumn("days_since", days).withColumn("reason", why)
    return out.select("series_id", "last_observation_date", "days_since", F.coalesce("missing_count", F.lit(0)).alias("missing_count"), F.col("reason").isin("stale", "unusable_stale").alias("stale"), F.col("reason").isin("fresh", "stale").alias("usable"), "reason")
