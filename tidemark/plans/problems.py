"""Queries of the general data-processing problems over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.grid import missing_periods, regular_grid
from tidemark.operators.knowledge import as_known
from tidemark.operators.outlets import squeeze, url_host, with_outlet
from tidemark.operators.spikes import implausible
from tidemark.operators.timestamps import normalise
from tidemark.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id): rows whose value is a spike, stuck or impossible."""
    return implausible(table(spark, sf_dir, "raw_observations")).select("obs_id")


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, reason) of the flagged rows."""
    return implausible(table(spark, sf_dir, "raw_observations"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, period_start): periods of the grid without a reading."""
    return missing_periods(regular_grid(table(spark, sf_dir, "raw_observations")))


def p4_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid: readings, filled and marked periods."""
    return regular_grid(table(spark, sf_dir, "raw_observations"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, obs_id): the reading current on each request's evaluation_date."""
    obs = table(spark, sf_dir, "raw_observations").where("value is not null and not isnan(value) and date is not null and realtime_start is not null and series_id is not null")
    attrs = obs.select(
        F.col("obs_id").alias("attr_id"), F.col("series_id").alias("entity"), F.greatest("date", "realtime_start").alias("known"), F.col("realtime_end").alias("until"),
        F.struct("date", "realtime_start", "fetched_at").alias("key"),
    )
    req = table(spark, sf_dir, "evaluation_requests").select(F.col("request_id").alias("event_id"), F.col("series_id").alias("entity"), F.col("evaluation_date").alias("day"))
    return as_known(req, attrs).select(F.col("event_id").alias("request_id"), F.col("attr_id").alias("obs_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, published_us): the UTC instant of every record whose published_at is a time."""
    items = table(spark, sf_dir, "sample_news_items").select("item_id", "source", "source_url", "published_at")
    known = with_outlet(items, table(spark, sf_dir, "news_sources"))
    # a record without outlet goes with those of the same spelling or host
    stream = F.coalesce(F.col("_outlet").cast("string"), F.nullif(squeeze(F.col("source")), F.lit("")), url_host(F.col("source_url")))
    return normalise(known.withColumn("_stream", stream), "item_id", "published_at", "_stream", "_zone", "_order").select(F.col("id").alias("item_id"), F.col("utc_us").alias("published_us"))


P6_SQL = """
SELECT r.request_id, max_by(o.obs_id, struct_pack(a := o.date, b := o.realtime_start, c := coalesce(o.fetched_at, TIMESTAMP '0001-01-01'), d := o.obs_id)) AS obs_id
FROM evaluation_requests r JOIN raw_observations o ON o.series_id = r.series_id AND o.date <= r.evaluation_date
 AND o.realtime_start <= r.evaluation_date AND (o.realtime_end IS NULL OR o.realtime_end >= r.evaluation_date)
WHERE o.value IS NOT NULL AND NOT isnan(o.value)
GROUP BY r.request_id
"""

P4_SQL = """
WITH stated AS (
  SELECT series_id, CASE lower(left(trim(frequency), 1)) WHEN 'd' THEN 'daily' WHEN 'w' THEN 'weekly' WHEN 'm' THEN 'monthly' WHEN 'q' THEN 'quarterly' END AS freq
  FROM raw_observations WHERE series_id IS NOT NULL),
f AS (SELECT series_id, freq FROM stated WHERE freq IS NOT NULL GROUP BY 1, 2
      QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY count(*) DESC, CASE freq WHEN 'daily' THEN 1 WHEN 'weekly' THEN 2 WHEN 'monthly' THEN 3 ELSE 4 END) = 1),
seen AS (
  SELECT DISTINCT series_id, freq, CASE freq WHEN 'weekly' THEN date_trunc('week', date) WHEN 'monthly' THEN date_trunc('month', date) WHEN 'quarterly' THEN date_trunc('quarter', date)
    ELSE date - greatest(isodow(date)::INT - 5, 0) END::DATE AS p
  FROM raw_observations JOIN f USING (series_id) WHERE value IS NOT NULL AND NOT isnan(value)),
span AS (SELECT series_id, freq, min(p) AS lo, max(p) AS hi FROM seen GROUP BY 1, 2),
days AS (SELECT series_id, freq, unnest(generate_series(lo, hi, CASE freq WHEN 'weekly' THEN INTERVAL 7 DAY WHEN 'monthly' THEN INTERVAL 1 MONTH WHEN 'quarterly' THEN INTERVAL 3 MONTH ELSE INTERVAL 1 DAY END))::DATE AS p FROM span)
SELECT series_id, strftime(p, '%Y-%m-%d') AS period_start FROM days d
WHERE NOT (freq = 'daily' AND isodow(p) > 5) AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.series_id = d.series_id AND s.p = d.p)
"""

QUERIES = {"p2_found": p2_found, "p2_reasons": p2_reasons, "p4_found": p4_found, "p4_grid": p4_grid, "p6_found": p6_found, "p7_found": p7_found}
SQL = {"p4_found": P4_SQL, "p6_found": P6_SQL}
