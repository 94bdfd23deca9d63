"""Tables on plain files: upserts by anti-join, scoped replacement, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import durable


def upsert(old: DataFrame, new: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """``old`` without the rows whose keys ``new`` has, and ``new``. Null keys match only with ``null_safe``."""
    k = new.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    on = None
    for c in keys:
        e = F.col(c).eqNullSafe(F.col(f"_{c}")) if null_safe else F.col(c) == F.col(f"_{c}")
        on = e if on is None else on & e
    return old.join(k, on, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_any(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As ``upsert``, but a match on any one key replaces: one anti-join per key, never a join on OR."""
    kept = old
    for c in keys:
        kept = kept.join(new.where(F.col(c).isNotNull()).select(c).distinct(), c, "left_anti")
    return kept.select(old.columns).unionByName(new, allowMissingColumns=True)


def replace_scope(old: DataFrame, new: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``scope``, and ``new``."""
    return old.join(scope.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new)


def retained(df: DataFrame, column: str, when: str, cutoff: str) -> DataFrame:
    """``column`` nulled in rows older than ``cutoff``; rows without time keep it."""
    old = F.coalesce(F.col(when) < F.lit(cutoff).cast("timestamp"), F.lit(False))
    return df.withColumn(column, F.when(old, None).otherwise(F.col(column)))


#: Canonical columns and sort keys of the tables that readers ask for.
SCHEMAS = {
    "raw_observations": ("series_id string, date date, value double, realtime_start date, realtime_end date, source string, fetched_at timestamp, frequency string, units string", ["series_id", "date"]),
    "features": ("feature_id string, series_id string, date date, raw_value double, transformed_value double, normalized_value double, transform string, normalization string, window_start date, window_end date, valid boolean, reason string", ["feature_id", "date"]),
    "asof_feature_values": ("evaluation_date date, feature_id string, source_observation_date date, transformed_value double, normalized_value double, lag_days int, valid boolean, reason string", ["evaluation_date", "feature_id"]),
    "dimension_scores": ("dimension_id string, date date, score double, valid_feature_count int, configured_feature_count int, total_configured_weight double, used_weight double, coverage_ratio double, valid boolean, reason string", ["dimension_id", "date"]),
    "regime_scores": ("regime_id string, date date, raw_score double, probability double, rank int, valid_dimension_count int, configured_dimension_count int, coverage_ratio double, valid boolean, reason string", ["date", "rank"]),
    "sector_scores": ("sector_id string, date date, raw_sector_score double, confidence_adjusted_score double, rank int, macro_reported_regime string, macro_raw_dominant_regime string, macro_confidence double, valid boolean, reason string", ["date", "rank"]),
    "sector_score_components": ("sector_id string, date date, component_type string, component_id string, input_value double, weight_or_exposure double, contribution double, valid boolean, reason string", ["date", "sector_id"]),
    "sector_proxy_prices": ("ticker string, date date, close double, source string, fetched_at timestamp", ["ticker", "date"]),
    "news_items": ("news_id string, source string, source_url string, title string, body string, published_at timestamp, ingested_at timestamp, provider string, raw_metadata_json string, content_hash string", ["published_at", "news_id"]),
}


def read(spark: SparkSession, root: str, name: str, ordered: bool = False, **equals: object) -> DataFrame:
    """A table by its fixed schema, filtered in the scan; columns that older files lack are null. Sorted only if asked for."""
    schema, keys = SCHEMAS[name]
    df = spark.read.schema(schema).parquet(f"{root}/{name}")
    for k, v in equals.items():
        df = df.where(F.col(k) == F.lit(v))
    return df.orderBy(*keys) if ordered else df


def shaped(df: DataFrame, name: str) -> DataFrame:
    """``df`` in a table's columns, order and types; what it lacks is null."""
    fields = StructType.fromDDL(SCHEMAS[name][0]).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def export(spark: SparkSession, root: str, to: str, names: list[str]) -> None:
    for n in names:
        spark.read.parquet(f"{root}/{n}").write.mode("overwrite").parquet(f"{to}/{n}")


def archive(df: DataFrame, root: str, run_date: str, run_id: str) -> None:
    """Rows of a run under root/run_date=.../run_id=...; a run written again replaces itself only."""
    df.write.mode("overwrite").parquet(f"{root}/run_date={run_date}/run_id={run_id}")


def merge_ledger(old: DataFrame, new: DataFrame, keys: list[str], when: str) -> DataFrame:
    """Union of both, of each key the row of the latest ``when``; of equals that of ``new``."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.col(when).desc_nulls_last(), F.col("_o").desc())
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_o", "_r")


def replace_with_children(tables: dict[str, tuple[DataFrame, DataFrame]], scope: DataFrame, key: str) -> dict[str, DataFrame]:
    """The (old, new) tables with the keys of ``scope`` taken from ``new`` in each."""
    return {name: replace_scope(old, new, scope, key) for name, (old, new) in tables.items()}


def aged(df: DataFrame, column: str, when: str, cutoff: str) -> DataFrame:
    """(n): rows whose ``column`` ``retained`` would null."""
    return df.agg(F.count_if((F.col(when) < F.lit(cutoff).cast("timestamp")) & F.col(column).isNotNull()).alias("n"))


def rewrite(df: DataFrame, path: str) -> None:
    """Overwrite a table that ``df`` may itself read: written aside first."""
    durable(df, "rewrite").write.mode("overwrite").parquet(path)
