"""Readers of landed files: observations, prices and news from CSV, JSON and XML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.items import iso

NEWS = "title string, body string, source string, source_url string, published_at string"
NEWS_COLUMNS = ["news_id", "content_hash", "source", "source_url", "title", "body", "published_at", "provider"]


def observations_csv(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, date, value) from CSV with a header; "." and other text that is no number is null, a bad date drops the row."""
    raw = spark.read.schema("series_id string, date string, value string").csv(path, header=True)
    return raw.select("series_id", F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date").alias("date"), F.col("value").try_cast("double").alias("value")).where("date is not null and series_id is not null")


def prices_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, date, close) from CSV; rows without ticker, date or numeric close are dropped."""
    raw = spark.read.schema("ticker string, date string, close string").csv(path, header=True)
    return raw.select("ticker", F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date").alias("date"), F.col("close").try_cast("double").alias("close")).dropna()


def content_hash(source: str = "source", published: str = "published_at", title: str = "title", body: str = "body"):
    """sha256 over source, time (ISO 8601, UTC, six decimals where the second isn't whole; an empty line without time), title and body, a line each."""
    part = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return F.sha2(F.concat_ws("\n", F.lower(part(source)), F.coalesce(iso(F.col(published)), F.lit("")), part(title), part(body)), 256)


def parsed_time(text: str = "published_at"):
    """ISO 8601, the compact form of archives, mail dates with or without the day of the week; null if it is none of them."""
    bare = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")))


def as_items(raw: DataFrame, provider: str, default_source: str | None = None) -> DataFrame:
    """News items with hash and id. Items without title or without body are rejected; text that is no time gives a null time, a missing source the default."""
    x = raw.withColumn("published_at", parsed_time() if dict(raw.dtypes)["published_at"] == "string" else F.col("published_at"))
    x = x.withColumn("title", F.trim("title")).withColumn("body", F.trim("body")).where((F.length("title") > 0) & (F.length("body") > 0))
    x = x.withColumn("source", F.trim(F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit(default_source or provider))))
    x = x.withColumn("content_hash", content_hash()).withColumn("news_id", F.concat(F.lit("news_"), F.substring("content_hash", 1, 16))).withColumn("provider", F.lit(provider))
    return x.select(NEWS_COLUMNS)


def rejected(raw: DataFrame) -> DataFrame:
    """Rows that ``as_items`` rejects, with the reason."""
    empty = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0
    return raw.withColumn("reason", F.when(empty("title"), "no_title").when(empty("body"), "no_body")).where("reason is not null")


def news_csv(spark: SparkSession, path: str) -> DataFrame:
    return as_items(spark.read.schema(NEWS).csv(path, header=True, multiLine=True, escape='"'), "local_csv")


def news_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON files that hold a list of items, or an object with ``items``."""
    raw = spark.read.schema(f"items array<struct<{NEWS.replace(' string', ': string')}>>, {NEWS}").json(path, multiLine=True)
    item = F.when(F.col("items").isNull(), F.array(F.struct(*[c.split()[0] for c in NEWS.split(", ")]))).otherwise(F.col("items"))
    return as_items(raw.select(F.inline(item)), "local_json")


def manual_items(spark: SparkSession, records: list[dict[str, str | None]]) -> DataFrame:
    """Items given in place."""
    names = [c.split()[0] for c in NEWS.split(", ")]
    return as_items(spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], NEWS), "manual_text")


def news_rss(spark: SparkSession, path: str, since: str | None = None, most: int | None = None) -> DataFrame:
    """RSS items and Atom entries of landed feeds: full content before description, summary before content; of several times the first given.

    ``since`` drops older items, not those without time; ``most`` keeps the newest.
    """
    rss = "title string, link string, description string, pubDate string, `content:encoded` string, `dc:date` string"
    r = spark.read.format("xml").option("rowTag", "item").schema(rss).load(path)
    full = F.coalesce(F.nullif(F.trim(F.col("`content:encoded`")), F.lit("")), F.col("description"))
    r = r.select("title", plain_text(full).alias("body"), F.lit("rss").alias("source"), F.col("link").alias("source_url"), F.coalesce("pubDate", "`dc:date`").alias("published_at"))
    atom = "title string, summary string, content string, published string, updated string, link array<struct<_href: string, _rel: string>>"
    a = spark.read.format("xml").option("rowTag", "entry").schema(atom).load(path)
    link = F.coalesce(F.get(F.filter("link", lambda x: F.coalesce(x._rel, F.lit("alternate")) == "alternate"), F.lit(0))._href, F.get("link", F.lit(0))._href)
    a = a.select("title", plain_text(F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.col("content"))).alias("body"), F.lit("rss").alias("source"), link.alias("source_url"), F.coalesce("published", "updated").alias("published_at"))
    out = as_items(r.unionByName(a), "rss")
    if since is not None:
        out = out.where(F.col("published_at").isNull() | (F.col("published_at") >= F.lit(since).cast("timestamp")))
    return out if most is None else out.orderBy(F.col("published_at").desc_nulls_last(), "news_id").limit(most)


def news_archive(spark: SparkSession, path: str) -> DataFrame:
    """Answers of an article archive (articles with title, url, domain, seendate): the headline stands for the body too."""
    raw = spark.read.schema("articles array<struct<title: string, url: string, domain: string, seendate: string>>").json(path, multiLine=True).select(F.inline("articles"))
    return as_items(raw.select("title", F.col("title").alias("body"), F.col("domain").alias("source"), F.col("url").alias("source_url"), F.col("seendate").alias("published_at")), "gdelt")


def news_wire(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Answers of a wire service (headline, summary, source, url, datetime in epoch seconds); without a summary the headline stands for it."""
    raw = spark.read.schema("headline string, summary string, source string, url string, datetime bigint").json(path, multiLine=True)
    x = raw.select(F.col("headline").alias("title"), F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.col("headline")).alias("body"), "source", F.col("url").alias("source_url"), F.timestamp_seconds("datetime").alias("published_at"))
    return as_items(x if since is None else x.where(F.col("published_at") >= F.lit(since).cast("timestamp")), "finnhub")


READERS = {"local_csv": lambda s, p: news_csv(s, p), "local_json": lambda s, p: news_json(s, p), "rss": lambda s, p: news_rss(s, p), "gdelt": lambda s, p: news_archive(s, p), "finnhub": lambda s, p: news_wire(s, p)}


def news_sources(spark: SparkSession, sources: list[dict], profile: str | None = None) -> tuple[DataFrame, list[str]]:
    """(items, warnings) of all sources of a profile (or all enabled ones); a source that can't be read is left out with a warning. Of equal contents the first stays.

    sources: source_id, provider, path, enabled, profiles, source_group.
    """
    took, warnings = [], []
    for k, s in enumerate(sources):
        if not (s.get("enabled", True) if profile is None else s["source_id"] == profile or profile in s.get("profiles", [])):
            continue
        try:
            got = READERS[s["provider"]](spark, s["path"])
            took.append(got.withColumn("source_group", F.lit(s.get("source_group"))).withColumn("_at", F.lit(k)))
        except Exception as e:
            warnings.append(f"{s['source_id']}: {type(e).__name__}")
    if not took:
        empty = spark.createDataFrame([], ", ".join(f"{c} {'timestamp' if c == 'published_at' else 'string'}" for c in NEWS_COLUMNS) + ", source_group string")
        return empty, warnings
    every = reduce(DataFrame.unionByName, took)
    return keep_first(every, "content_hash", "_at").drop("_at"), warnings


def date_windows(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """(window_start, window_end): half-open stretches of ``days`` from start to end, the last one cut."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    step = F.expr(f"make_interval(0, 0, 0, {days})")
    w = spark.range(1).select(F.explode(F.sequence(a, F.greatest(a, b - F.expr("interval 1 second")), step)).alias("window_start"))
    return w.select("window_start", F.least(F.col("window_start") + step, b).alias("window_end")).where("window_start < window_end")


def backfill_requests(windows: DataFrame, queries: DataFrame) -> DataFrame:
    """(window_start, window_end, query): every query in every window; both are parameters."""
    return windows.crossJoin(F.broadcast(queries))


def replay_csv(spark: SparkSession, path: str) -> DataFrame:
    """Items of a replay file in order of time and title; a time that can't be read is an error, not a null."""
    raw = spark.read.schema(f"{NEWS}, source_group string").csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    bad = F.raise_error(F.concat(F.lit("bad published_at: "), F.coalesce("published_at", F.lit("null"))))
    return raw.withColumn("published_at", F.coalesce(parsed_time(), bad.cast("timestamp"))).orderBy("published_at", "title")


def series_metadata_json(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, title, frequency, units, seasonal_adjustment, last_updated, notes, notes_hash) of a service's answers."""
    raw = spark.read.schema("seriess array<struct<id: string, title: string, frequency: string, units: string, seasonal_adjustment: string, last_updated: string, notes: string>>").json(path, multiLine=True).select(F.inline("seriess"))
    zone = F.regexp_replace("last_updated", r"([+-]\d{2})$", "$1:00")
    return raw.select(F.col("id").alias("series_id"), "title", "frequency", "units", "seasonal_adjustment", F.try_to_timestamp(zone).alias("last_updated"), "notes", F.sha2(F.coalesce("notes", F.lit("")), 256).alias("notes_hash")).where("series_id is not null")


def observations_json(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, date, value, realtime_start, realtime_end): "." is a null value."""
    schema = "series_id string, observations array<struct<date: string, value: string, realtime_start: string, realtime_end: string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).select("series_id", F.inline("observations"))
    day = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date").alias(c)
    return raw.select("series_id", day("date"), F.col("value").try_cast("double").alias("value"), day("realtime_start"), day("realtime_end")).where("date is not null and series_id is not null")


def with_fulltext(items: DataFrame, pages: DataFrame, short: int, most: int, longest: int) -> DataFrame:
    """Bodies under ``short`` characters, the newest ``most`` of them, replaced by their page's main text where that is longer, cut at ``longest``.

    ``pages``: source_url, html. News id and hash stay.
    """
    few = items.where(F.length("body") < short).orderBy(F.col("published_at").desc_nulls_last(), "news_id").limit(most).select("news_id", "source_url")
    text = few.join(pages, "source_url").groupBy("news_id").agg(F.max_by("html", F.length("html")).alias("html")).select("news_id", F.substring(plain_text(F.col("html")), 1, longest).alias("_full"))
    j = items.join(text, "news_id", "left")
    return j.withColumn("body", F.when(F.length("_full") > F.length("body"), F.col("_full")).otherwise(F.col("body"))).drop("_full")


def run_summaries(spark: SparkSession, root: str) -> DataFrame:
    """Archived run summaries (root/<date>/<run>/daily_diagnostic_summary.json)."""
    schema = (
        "run_id string, run_date string, status string, macro struct<reported_regime: string, confidence: double>, step_statuses struct<guardrail_status: string>, "
        "monitoring struct<success_rate: double, max_rank_change: int>, accumulation struct<readiness_label: string>, combined_top array<struct<sector_id: string, rank: int>>, warnings array<string>, errors array<string>"
    )
    return spark.read.schema(schema).json(f"{root}/*/*/daily_diagnostic_summary.json", multiLine=True)


def plain_text(html):
    """Text without tags, scripts and styles; entities of the five basic kinds resolved."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def keep_first(items: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first in order; a plain dropDuplicates would take any."""
    return items.groupBy(key).agg(F.min_by(F.struct(*items.columns), order).alias("_x")).select("_x.*")
