"""Decayed and capped event scores: daily, weekly, secular, and their combination with a cross-section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.asof import carry_back
from tidemark.operators.scoring import cross_zscore


def decay(age: Column, half_life: float, max_age: float) -> Column:
    """0.5^(age / half_life) for ages 0..max_age, else 0."""
    return F.when((age >= 0) & (age <= max_age), F.pow(F.lit(0.5), age / half_life)).otherwise(F.lit(0.0))


def clip(x: Column, cap: float) -> Column:
    """Within -cap..cap; null and NaN count 0."""
    y = F.when(F.isnan(x), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))
    return F.greatest(F.lit(-cap), F.least(F.lit(cap), y))


def sign(direction: Column) -> Column:
    d = F.lower(direction)
    return F.when(d.isin("positive", "tailwind"), 1.0).when(d.isin("negative", "headwind"), -1.0).otherwise(0.0)


def components(items: DataFrame, half_life: float, max_age: int, item_cap: float, min_confidence: float = 0.0, min_severity: float = 0.0, source_weight: Column | None = None, end: Column | None = None) -> DataFrame:
    """``items`` (news_id, key, source, day, raw, severity, confidence) on every day they live: score_date, freshness, adjusted.

    Each item makes its own days, at most max_age + 1 of them, up to ``end`` (default: the last day of any item), so
    there is no join of days with items. Null severity and confidence count 0; items without day are left out.
    """
    if end is None:
        last = items.agg(F.max("day")).first()[0]
        end = F.lit(last).cast("date")
    c, s = F.coalesce("confidence", F.lit(0.0)), F.coalesce("severity", F.lit(0.0))
    live = items.where("day is not null").withColumn("confidence", c).withColumn("severity", s).where((F.col("confidence") >= min_confidence) & (F.col("severity") >= min_severity))
    until = F.least(F.date_add("day", max_age), end)
    live = live.where(F.col("day") <= end).withColumn("score_date", F.explode(F.sequence("day", until, F.expr("interval 1 day"))))
    fresh = decay(F.datediff("score_date", "day"), half_life, max_age)
    weight = source_weight if source_weight is not None else F.lit(1.0)
    return live.withColumn("freshness", fresh).withColumn("adjusted", clip(F.col("raw") * F.col("confidence") * weight * F.col("freshness"), item_cap))


def top_ids(abs_score: Column, ident: Column, k: int = 5) -> Column:
    """Aggregate: distinct ids by greatest score, then id, first ``k``, as text. Groups are one day's live items of one key."""
    s = F.array_sort(F.collect_list(F.struct((-abs_score).alias("a"), ident.alias("i"))))
    return F.slice(F.array_distinct(F.transform(s, lambda x: x.i)), 1, k)


def daily(comps: DataFrame, source_cap: float, event_cap: float | None = None, neutral: float = 0.03) -> DataFrame:
    """(score_date, key, raw_score, adjusted_score, item_count, positive_count, negative_count, neutral_count, avg_confidence, avg_severity).

    Contributions of one source are summed and clipped; with ``event_cap`` (column event_id) first inside each event,
    whose total is clipped again.
    """
    by = ["score_date", "key"] + (["event_id"] if event_cap is not None else [])
    a = F.col("adjusted")
    n = comps.groupBy("score_date", "key").agg(
        F.sum("raw").alias("raw_score"), F.countDistinct("news_id").alias("item_count"), F.count_if(a > neutral).alias("positive_count"), F.count_if(a < -neutral).alias("negative_count"),
        F.count_if(F.abs(a) <= neutral).alias("neutral_count"), F.avg("confidence").alias("avg_confidence"), F.avg("severity").alias("avg_severity"),
    )
    capped = comps.groupBy(*by, "source").agg(F.sum("adjusted").alias("_s")).withColumn("_s", clip(F.col("_s"), source_cap))
    if event_cap is not None:
        capped = capped.groupBy(*by).agg(F.sum("_s").alias("_s")).withColumn("_s", clip(F.col("_s"), event_cap))
    total = capped.groupBy("score_date", "key").agg(F.sum("_s").alias("adjusted_score"))
    return n.join(total, ["score_date", "key"])


def daily_top(comps: DataFrame, k: int = 5) -> DataFrame:
    """(score_date, key, top_ids array): cut to k per group before any list is made."""
    w = W.partitionBy("score_date", "key").orderBy(F.abs("adjusted").desc(), "news_id")
    best = comps.groupBy("score_date", "key", "news_id").agg(F.max_by("adjusted", F.abs("adjusted")).alias("adjusted")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return best.groupBy("score_date", "key").agg(top_ids(F.abs("adjusted"), F.col("news_id"), k).alias("top_ids"))


def weekly(day: DataFrame) -> DataFrame:
    """(week_start, key, ...): mean of the daily scores, sum of the daily counts. Weeks start on Monday."""
    return day.groupBy(F.to_date(F.date_trunc("week", "score_date")).alias("week_start"), "key").agg(
        *[F.avg(c).alias(c) for c in ("raw_score", "adjusted_score", "avg_confidence", "avg_severity")], *[F.sum(c).alias(c) for c in ("item_count", "positive_count", "negative_count", "neutral_count")]
    )


def weekly_top(top: DataFrame, k: int = 5) -> DataFrame:
    """(week_start, key, top_ids): the days' lists joined in order of day, each id once, first ``k``."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct("score_date", "top_ids"))), lambda s: s.top_ids)
    return top.groupBy(F.to_date(F.date_trunc("week", "score_date")).alias("week_start"), "key").agg(F.slice(F.array_distinct(F.flatten(lists)), 1, k).alias("top_ids"))


def secular(items: DataFrame, as_of: str, half_life: float, max_age: int, item_cap: float, period_cap: float, trend_days: int = 30) -> DataFrame:
    """(key, score, raw_score, trend, item_count, avg_confidence) as of a day: contributions clipped per (month, source)."""
    now = F.to_date(F.lit(as_of))
    age = F.datediff(now, F.col("day"))
    live = items.where("day is not null").withColumn("adjusted", clip(F.col("raw") * F.coalesce("confidence", F.lit(0.0)) * decay(age, half_life, max_age), item_cap)).where((age >= 0) & (decay(age, half_life, max_age) > 0))
    capped = live.groupBy("key", F.trunc("day", "month").alias("m"), "source").agg(F.sum("adjusted").alias("s")).groupBy("key").agg(F.sum(clip(F.col("s"), period_cap)).alias("score"))
    recent, prior = age < trend_days, (age >= trend_days) & (age < 2 * trend_days)
    zero = lambda c: F.coalesce(F.sum(F.when(c, F.col("adjusted"))), F.lit(0.0))
    n = live.groupBy("key").agg(F.sum("raw").alias("raw_score"), (zero(recent) - zero(prior)).alias("trend"), F.countDistinct("news_id").alias("item_count"), F.avg("confidence").alias("avg_confidence"))
    return capped.join(n, "key")


def period_scores(items: DataFrame, unit: str, as_of: str, half_life: float, max_age: int, item_cap: float, period_cap: float) -> DataFrame:
    """(key, period_start, score, item_count): per month or quarter, clipped per (month, source) inside."""
    age = F.datediff(F.to_date(F.lit(as_of)), F.col("day"))
    live = items.where("day is not null").withColumn("adjusted", clip(F.col("raw") * F.coalesce("confidence", F.lit(0.0)) * decay(age, half_life, max_age), item_cap)).where((age >= 0) & (decay(age, half_life, max_age) > 0))
    live = live.withColumn("period_start", F.trunc("day", unit))
    capped = live.groupBy("key", "period_start", F.trunc("day", "month").alias("m"), "source").agg(F.sum("adjusted").alias("s")).groupBy("key", "period_start").agg(F.sum(clip(F.col("s"), period_cap)).alias("score"))
    return capped.join(live.groupBy("key", "period_start").agg(F.countDistinct("news_id").alias("item_count")), ["key", "period_start"])


def combined(macro: DataFrame, news: DataFrame, macro_weight: float = 0.75, news_weight: float = 0.25, news_cap: float = 1.0, penalty: float = 0.05, max_age: int = 21, min_items: int = 1) -> DataFrame:
    """(diagnostic_date, key, macro_score, news_score, macro_weight, news_weight, news_item_count, news_confidence, combined_score, rank).

    ``macro``: key, date, score (valid rows only). ``news``: score_date, key, adjusted_score, item_count,
    avg_confidence. Dates are those of the news; a date takes the whole cross-section of the latest macro date at or
    before it, and per key the latest news no older than ``max_age`` days. Thin or no news leaves the macro score
    alone. Scores are z-scores in the cross-section; ties in rank go by key.
    """
    dates = news.select(F.col("score_date").alias("diagnostic_date")).distinct().withColumn("_all", F.lit(1))
    seen = macro.select("date").distinct().select(F.lit(1).alias("_all"), F.col("date").alias("_m"), F.col("date").alias("macro_date"))
    at = carry_back(dates, seen, ["_all"], "diagnostic_date", "_m", ["macro_date"]).where("macro_date is not null").select("diagnostic_date", "macro_date")
    z = macro.withColumn("macro_score", cross_zscore(F.col("score"), W.partitionBy("date"))).select(F.col("date").alias("macro_date"), "key", "macro_score")
    base = at.join(z, "macro_date")
    facts = news.select("key", "score_date", F.col("score_date").alias("news_date"), "adjusted_score", "item_count", "avg_confidence")
    got = carry_back(base, facts, ["key"], "diagnostic_date", "score_date", ["news_date", "adjusted_score", "item_count", "avg_confidence"])
    has = F.coalesce(F.datediff("diagnostic_date", "news_date") <= max_age, F.lit(False))
    full = macro_weight + news_weight
    got = got.withColumn("news_item_count", F.when(has, F.col("item_count")).otherwise(0)).withColumn("news_confidence", F.when(has, F.coalesce("avg_confidence", F.lit(0.0))).otherwise(0.0))
    used = has & (F.col("news_item_count") >= min_items)
    got = got.withColumn("news_score", F.when(has, clip(F.col("adjusted_score"), news_cap)).otherwise(0.0)).withColumn("macro_weight", F.when(used, F.lit(macro_weight / full)).otherwise(1.0)).withColumn("news_weight", F.when(used, F.lit(news_weight / full)).otherwise(0.0))
    lost = F.when(used, penalty * F.greatest(F.lit(0.0), 1 - F.col("news_confidence"))).otherwise(0.0)
    got = got.withColumn("combined_score", F.col("macro_weight") * F.col("macro_score") + F.col("news_weight") * F.col("news_score") - lost)
    rank = F.row_number().over(W.partitionBy("diagnostic_date").orderBy(F.round("combined_score", 12).desc(), "key")).cast("int")
    return got.select("diagnostic_date", "key", "macro_score", "news_score", "macro_weight", "news_weight", "news_item_count", "news_confidence", "combined_score", rank.alias("rank"))
