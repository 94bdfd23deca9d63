"""Calendars and as-of joins by union and carried-forward windows: one shuffle on the key, no non-equi join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.params import Feature, Source, relation


def month_spine(spark: SparkSession, start: str, end: str, at: str = "MS") -> DataFrame:
    """(evaluation_date): month starts on or after ``start`` (MS) or month ends (ME), up to ``end``."""
    d = spark.range(1).select(F.explode(F.sequence(F.trunc(F.to_date(F.lit(start)), "month"), F.trunc(F.to_date(F.lit(end)), "month"), F.expr("interval 1 month"))).alias("d"))
    d = d.select(F.col("d") if at == "MS" else F.last_day("d"))
    return d.toDF("evaluation_date").where(F.col("evaluation_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def carry_back(probes: DataFrame, facts: DataFrame, keys: list[str], probe_at: str, fact_at: str, payload: list[str], inclusive: bool = True) -> DataFrame:
    """Each probe with ``payload`` of the latest fact of its keys at or before its time (null if none). Ties among facts: greatest payload."""
    kind = facts.select(F.struct(*payload).alias("s")).schema["s"].dataType
    p = probes.select("*", F.col(probe_at).alias("_t"), F.lit(1 if inclusive else 0).alias("_kind"), F.lit(None).cast(kind).alias("_s"))
    f = facts.select(*keys, F.col(fact_at).alias("_t"), F.lit(0 if inclusive else 1).alias("_kind"), F.struct(*payload).alias("_s"))
    w = W.partitionBy(*keys).orderBy("_t", "_kind", "_s").rowsBetween(W.unboundedPreceding, 0)
    both = p.withColumn("_probe", F.lit(True)).unionByName(f.withColumn("_probe", F.lit(False)), allowMissingColumns=True)
    out = both.withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_probe")
    return out.select(*probes.columns, *[F.col(f"_s.{c}").alias(c) for c in payload])


def carry_ahead(probes: DataFrame, facts: DataFrame, keys: list[str], probe_at: str, fact_at: str, payload: list[str]) -> DataFrame:
    """Each probe with ``payload`` of the first fact of its keys at or after its time (null if none)."""
    kind = facts.select(F.struct(*payload).alias("s")).schema["s"].dataType
    p = probes.select("*", F.col(probe_at).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(kind).alias("_s"), F.lit(True).alias("_probe"))
    f = facts.select(*keys, F.col(fact_at).alias("_t"), F.lit(1).alias("_kind"), F.struct(*payload).alias("_s"), F.lit(False).alias("_probe"))
    w = W.partitionBy(*keys).orderBy("_t", "_kind", "_s").rowsBetween(0, W.unboundedFollowing)
    out = p.unionByName(f, allowMissingColumns=True).withColumn("_s", F.first("_s", ignorenulls=True).over(w)).where("_probe")
    return out.select(*probes.columns, *[F.col(f"_s.{c}").alias(c) for c in payload])


def asof_features(calendar: DataFrame, rows: DataFrame, defs: list[Feature], sources: list[Source], max_lag: dict[str, int]) -> DataFrame:
    """(evaluation_date, feature_id, source_observation_date, transformed_value, normalized_value, lag_days, valid, reason).

    A valid observation is seen from its date plus its source's publication lag on; its age counts from the evaluation
    date. Reasons: disabled_feature, missing_feature (no rows), no_prior_valid_feature, not_yet_published,
    stale_asof_value, ok. Invalid rows are passed over even if newer.
    """
    spark = rows.sparkSession
    d = relation(spark, defs).select("feature_id", "series_id", "enabled").join(relation(spark, sources).select("series_id", "frequency", "publication_lag_days"), "series_id")
    limit = F.lit(None).cast("int")
    for f, n in max_lag.items():
        limit = F.when(F.col("frequency") == f, n).otherwise(limit)
    d = F.broadcast(d.withColumn("max_lag", limit).drop("series_id"))
    probes = calendar.select("evaluation_date").crossJoin(d)
    have = rows.where("date is not null").select("feature_id").distinct().withColumn("_has", F.lit(True))
    good = rows.where("valid and date is not null").join(d.select("feature_id", "publication_lag_days"), "feature_id").withColumn("_seen", F.expr("date_add(date, publication_lag_days)"))
    facts = good.select("feature_id", "date", "_seen", F.col("date").alias("source_observation_date"), "transformed_value", "normalized_value")
    out = carry_back(probes, facts, ["feature_id"], "evaluation_date", "_seen", ["source_observation_date", "transformed_value", "normalized_value"])
    out = carry_back(out, good.select("feature_id", "date", F.col("date").alias("_observed")), ["feature_id"], "evaluation_date", "date", ["_observed"])
    out = out.join(F.broadcast(have), "feature_id", "left").withColumn("lag_days", F.datediff("evaluation_date", "source_observation_date"))
    reason = (
        F.when(~F.col("enabled"), "disabled_feature").when(F.col("_has").isNull(), "missing_feature")
        .when(F.col("source_observation_date").isNull() & F.col("_observed").isNotNull(), "not_yet_published").when(F.col("source_observation_date").isNull(), "no_prior_valid_feature")
        .when(F.col("lag_days") > F.col("max_lag"), "stale_asof_value").otherwise("ok")
    )
    return out.withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok").select("evaluation_date", "feature_id", "source_observation_date", "transformed_value", "normalized_value", "lag_days", "valid", "reason")


def forward_returns(scores: DataFrame, prices: DataFrame, benchmark: str, horizons: tuple[int, ...] = (1, 3), reach_days: int = 7) -> DataFrame:
    """``scores`` (entity_id, ticker, score_date, ...) with forward_{h}m_return and relative_forward_{h}m_return.

    A price is the first close on or after its day, at most ``reach_days`` later. All look-ups (now and after each
    horizon, own ticker and benchmark) go through one ordered pass. valid is false, with missing_proxy_ticker or
    missing_forward_prices, if there is no ticker or no horizon has a relative return.
    """
    steps = [0, *horizons]
    roles = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), r.alias("tk"), F.lit(k).alias("role")) for h in steps for k, r in (("own", F.col("ticker")), ("bench", F.lit(benchmark)))]))
    keys = ["entity_id", "score_date"]
    probes = scores.select(*keys, roles.alias("p")).select(*keys, F.col("p.h").alias("h"), F.col("p.role").alias("role"), F.col("p.tk").alias("_tk")).withColumn("at", F.add_months("score_date", F.col("h")))
    facts = prices.where("close is not null").select(F.col("ticker").alias("_tk"), "date", F.col("date").alias("price_date"), "close")
    # each ticker and day is looked up once, however many entities ask; the benchmark's look-ups are then as few as its days
    asked = probes.where("_tk is not null").select("_tk", "at").distinct()
    found = carry_ahead(asked, facts, ["_tk"], "at", "date", ["price_date", "close"]).where(F.datediff("price_date", "at") <= reach_days)
    met = probes.join(found, ["_tk", "at"])
    wide = met.groupBy(*keys).agg(*[F.max(F.when((F.col("h") == h) & (F.col("role") == r), F.col("close"))).alias(f"{r}_{h}") for h in steps for r in ("own", "bench")])
    out = scores.join(wide, keys, "left")
    ret = lambda r, h: F.try_divide(F.col(f"{r}_{h}"), F.col(f"{r}_0")) - 1
    for h in horizons:
        out = out.withColumn(f"forward_{h}m_return", ret("own", h)).withColumn(f"relative_forward_{h}m_return", ret("own", h) - ret("bench", h))
    any_rel = F.coalesce(*[F.col(f"relative_forward_{h}m_return") for h in horizons])
    reason = F.when(F.col("ticker").isNull(), "missing_proxy_ticker").when(any_rel.isNull(), "missing_forward_prices").otherwise("ok")
    return out.drop(*[f"{r}_{h}" for h in steps for r in ("own", "bench")]).withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok")


def months_between(a: Column, b: Column) -> Column:
    """12 * years + months from b to a."""
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
