"""Outlet of a record: a register row found by name, alias or domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import bounded


def squeeze(c: Column) -> Column:
    """Letters and digits in lower case: case, spacing and punctuation do not count."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def bare_host(c: Column) -> Column:
    """Host without port, ``www.``, ``m.``, ``amp.`` and the like."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r":\d+$", ""), r"^(www\d?|m|mobile|amp)\.", "")


def url_host(c: Column) -> Column:
    h = F.regexp_extract(F.trim(c), r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]+)", 1)
    return bare_host(F.when(h != "", h))


def register_keys(sources: DataFrame) -> DataFrame:
    """(key, source_id, zone_name, date_order): one row per spelling. A key of two outlets goes to the smaller id."""
    named = F.transform(F.array_union(F.array("source"), F.coalesce("aliases", F.array().cast("array<string>"))), squeeze)
    keys = F.array_union(named, F.array(squeeze(bare_host(F.col("domain")))))
    long = sources.select(F.explode(F.array_distinct(keys)).alias("key"), "source_id", "zone_name", "date_order")
    first = F.min_by(F.struct("source_id", "zone_name", "date_order"), "source_id").alias("o")
    return long.where("key is not null and key <> ''").groupBy("key").agg(first).select("key", "o.*")


def with_outlet(items: DataFrame, sources: DataFrame) -> DataFrame:
    """``items`` with ``_outlet`` (source_id or null), ``_zone``, ``_order``.

    ``source`` decides when it is not blank: as a name or alias, or as a host (a leading ``www.`` is dropped).
    A blank or null source leaves it to the host of ``source_url``. No match gives null.
    """
    keys = bounded(register_keys(sources))
    named = F.col("source").isNotNull() & (squeeze(F.col("source")) != "")
    host = F.regexp_extract(F.trim("source"), r"(?i)^(?:[a-z]+://)?([a-z0-9-]+(?:\.[a-z0-9-]+)+)(?::\d+)?/?$", 1)
    by_name = F.when(host != "", squeeze(bare_host(host))).otherwise(squeeze(F.col("source")))
    key = F.when(named, by_name).otherwise(squeeze(url_host(F.col("source_url"))))
    k = keys.select(F.col("key").alias("_key"), F.col("source_id").alias("_outlet"), F.col("zone_name").alias("_zone"), F.col("date_order").alias("_order"))
    return items.withColumn("_key", key).join(k, "_key", "left").drop("_key")
