"""Items with their classifications: joins, predicates, selections and guards on text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words that reports must not hold, the word put for them, and the sign a stated direction lets expect.
FORBIDDEN = ["buy", "sell", "overweight", "underweight", "avoid", "recommendation", "trade", "position sizing", "portfolio allocation"]
FORBIDDEN_MORE = ["recommend", "should own", "should short", "invest in"]
REPLACEMENT = "market-action term"
EXPECTED_SIGN = {"tailwind": 1.0, "headwind": -1.0}


def latest_per(df: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """One row per key: the latest by ``when``, of equals the greatest ``tie``; null times come first."""
    w = W.partitionBy(key).orderBy(F.col(when).desc_nulls_last(), F.col(tie).desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def successful(classes: DataFrame) -> DataFrame:
    return classes.where("classification_status = 'success'")


def theme_base(themes: DataFrame, items: DataFrame, classes: DataFrame) -> DataFrame:
    """Themes with their items' source and time, of items that have a successful classification. Null weights count 0."""
    t = themes.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("severity", "confidence")})
    return t.join(items.select("news_id", "source", "published_at"), "news_id", "left").join(successful(classes).select("news_id"), "news_id", "left_semi")


def sector_base(impacts: DataFrame, items: DataFrame, classes: DataFrame) -> DataFrame:
    """Impacts with their items and the severity of the classification; two severities of one item give two rows."""
    c = successful(classes).select("news_id", F.coalesce("severity", F.lit(0.0)).alias("severity")).distinct()
    i = impacts.withColumns({x: F.coalesce(x, F.lit(0.0)) for x in ("impact_score", "confidence")})
    return i.join(items.select("news_id", "source", "published_at"), "news_id", "left").join(c, "news_id")


def high_severity(x: Column, least: float = 0.6) -> Column:
    return F.coalesce(x, F.lit(0.0)) >= least


def low_confidence(x: Column, most: float = 0.4) -> Column:
    """A null confidence is a low one."""
    return F.coalesce(x, F.lit(0.0)) <= most


def dated_events(classes: DataFrame, items: DataFrame, themes: list[str]) -> DataFrame:
    """Successful classifications of the listed long themes with event_at: the item's time, else that of the classification."""
    c = successful(classes).where(F.col("secular_theme").isin(themes))
    return c.join(items.select("news_id", "source", "title", "published_at"), "news_id", "left").withColumn("event_at", F.coalesce("published_at", "classified_at"))


def ledger(impacts: DataFrame, classes: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(classification_id, news_id, prediction_date, sector_id, impact_direction, impact_score, confidence, expected_sign) with each item's latest classification.

    The prediction is dated by the classification, or with ``items`` by the publication.
    """
    last = latest_per(classes.select("classification_id", "news_id", "classified_at"), "news_id", "classified_at", "classification_id")
    j = impacts.join(last, "news_id", "left")
    when = F.col("classified_at")
    if items is not None:
        j, when = j.join(items.select("news_id", "published_at"), "news_id", "left"), F.col("published_at")
    expected = reduce(lambda a, kv: F.when(F.col("impact_direction") == kv[0], kv[1]).otherwise(a), EXPECTED_SIGN.items(), F.lit(None).cast("double"))
    return j.select("classification_id", "news_id", F.to_date(when).alias("prediction_date"), "sector_id", "impact_direction", "impact_score", "confidence", expected.alias("expected_sign"))


def without_provider(rows: DataFrame, items: DataFrame, provider: str) -> DataFrame:
    """``rows`` without those of items that a provider filled in afterwards."""
    return rows.join(items.where(F.col("provider") == provider).select("news_id"), "news_id", "left_anti")


def unclassified(items: DataFrame, classes: DataFrame) -> DataFrame:
    return items.join(classes.select("news_id"), "news_id", "left_anti")


def newest(items: DataFrame, when: str, n: int, unknown_new: bool = False, tie: str = "news_id") -> DataFrame:
    """The ``n`` newest items. With ``unknown_new`` items without a time count as newest, as where an ascending sort puts nulls last and the tail is taken."""
    t = F.col(when)
    return items.orderBy(t.desc_nulls_first() if unknown_new else t.desc_nulls_last(), F.col(tie).desc()).limit(n)


def discovery_pool(items: DataFrame, classes: DataFrame, most_confidence: float) -> DataFrame:
    """Items without a long theme, or whose latest classification is not sure of it (a null confidence is not)."""
    last = latest_per(classes, "news_id", "classified_at", "classification_id").select("news_id", "secular_theme", F.col("confidence").alias("classification_confidence"))
    j = items.join(last, "news_id", "left")
    return j.where(F.col("secular_theme").isNull() | (F.coalesce("classification_confidence", F.lit(0.0)) <= most_confidence))


def support(pool: DataFrame, by: str) -> DataFrame:
    """Distinct articles, days and sources that speak for each candidate."""
    return pool.groupBy(by).agg(F.countDistinct("news_id").alias("distinct_articles"), F.countDistinct(F.to_date("published_at")).alias("days_observed"), F.countDistinct("source").alias("source_diversity"))


def promoted(candidates: DataFrame, articles: int = 8, days: int = 5, sources: int = 3) -> DataFrame:
    """Support with ``promote``, and the first requirement that fails."""
    short = F.when(F.col("distinct_articles") < articles, "articles").when(F.col("days_observed") < days, "days").when(F.col("source_diversity") < sources, "sources")
    return candidates.withColumn("failing", short).withColumn("promote", F.col("failing").isNull())


def replay(items: DataFrame, days: list[str], back: int, most: int) -> DataFrame:
    """(replay_day, ...): for each replayed day its items and those of up to ``back`` days before, at most the ``most`` newest. Nothing from later is seen."""
    d = F.to_date("published_at")
    near = F.filter(F.array(*[F.to_date(F.lit(x)) for x in days]), lambda x: (d <= x) & (F.date_sub(x, back) <= d))
    w = W.partitionBy("replay_day").orderBy(F.col("published_at").desc(), F.col("news_id").desc())
    seen = items.where("published_at is not null").withColumn("replay_day", F.explode(near))
    return seen.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def leaks(replayed: DataFrame) -> DataFrame:
    """(leaked): rows that are later than the day that saw them; 0 if the replay is right."""
    return replayed.agg(F.count_if(F.to_date("published_at") > F.col("replay_day")).alias("leaked"))


def ranked_groups(df: DataFrame, by: str, order: str, n: int = 10, **aggs: Column) -> DataFrame:
    """The ``n`` groups of greatest ``order``, then count, then name."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in aggs.items()])
    return g.orderBy(F.round(order, 9).desc(), F.col("n").desc(), by).limit(n)


def value_counts(df: DataFrame, by: str, n: int = 10) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), by).limit(n)


def failure_mode(message: Column) -> Column:
    """First line of a message, at most 120 characters."""
    return F.substring(F.split_part(message, F.lit("\n"), F.lit(1)), 1, 120)


def iso(t: Column) -> Column:
    """ISO 8601 in UTC, with six decimals only where the second isn't whole."""
    part = F.date_format(t, ".SSSSSS")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == ".000000", "").otherwise(part), F.lit("+00:00"))


def classification_id(news_id: Column, provider: Column, at: Column) -> Column:
    return F.concat(F.lit("classification_"), F.substring(F.sha2(F.concat_ws("|", news_id.cast("string"), provider, iso(at)), 256), 1, 16))


def truncated(text: Column, most: int) -> Column:
    """Texts over ``most`` characters are cut, without white space at the end, and say so."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), r"(?U)\s+$", ""), F.lit(f"\n\n[truncated_to_{most}_chars]"))).otherwise(text)


def forbidden_terms(text: Column, terms: list[str] | None = None) -> Column:
    """Array of the terms a text holds as substrings, whatever their case, the longest first."""
    terms = sorted(set(terms or FORBIDDEN + FORBIDDEN_MORE), key=lambda t: (-len(t), t))
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.when(low.contains(t), t) for t in terms]), lambda t: t.isNotNull())


def safe_text(text: Column, terms: list[str] = FORBIDDEN) -> Column:
    """Text with the forbidden terms replaced, the longest first; null gives an empty text."""
    return reduce(lambda c, t: F.regexp_replace(c, f"(?i){t}", REPLACEMENT), sorted(terms, key=len, reverse=True), F.coalesce(text, F.lit("")))


def snake_id(name: Column) -> Column:
    return name.rlike("^[a-z][a-z0-9_]{2,39}$")


def stooq_symbol(ticker: Column) -> Column:
    """Lower-case symbol with the country; an index, one that has a dot already, or none stays as it is."""
    t = F.lower(F.trim(ticker))
    return F.when((t == "") | t.startswith("^") | t.contains("."), t).otherwise(F.concat(t, F.lit(".us")))


def price_answer(body: Column) -> Column:
    """What a price service sent: csv, apikey_instruction, html, empty or non_csv."""
    t, head = F.lower(F.trim(F.coalesce(body, F.lit("")))), F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 500))
    return (
        F.when(F.split_part(t, F.lit("\n"), F.lit(1)).rlike("^date,.*close"), "csv").when(head.contains("get your apikey"), "apikey_instruction")
        .when(head.contains("<html") | head.contains("<!doctype"), "html").when(t == "", "empty").otherwise("non_csv")
    )


def mapped_group(group: Column, query_group: Column, source: Column, title: Column, body: Column, rules: list[dict], known: list[str]) -> Column:
    """struct(source_group, method): a stated group, else a known query group, else the first rule that matches.

    A rule matches if any of its keyword lists has a word in its field; one without keywords always does.
    """
    none = F.lit(None).cast("string")
    out = F.struct(none.alias("source_group"), none.alias("method"))
    fields = {"source": source, "title": title, "body": body}
    for r in reversed(rules):
        hits = [F.lower(F.coalesce(fields[f], F.lit(""))).contains(k.lower()) for f in fields for k in r.get(f, [])]
        hit = reduce(lambda a, b: a | b, hits) if hits else F.lit(True)
        out = F.when(hit, F.struct(F.lit(r["group"]).alias("source_group"), F.lit("configured_rule").alias("method"))).otherwise(out)
    stated = F.nullif(F.trim(group), F.lit(""))
    out = F.when(query_group.isin(known), F.struct(query_group.alias("source_group"), F.lit("query_group").alias("method"))).otherwise(out)
    return F.when(stated.isNotNull(), F.struct(stated.alias("source_group"), F.lit("explicit_source_group").alias("method"))).otherwise(out)


def readiness(run_dates: Column, items: Column, sources: Column) -> Column:
    return F.when((run_dates < 5) | (items < 100), "insufficient_history").when(run_dates < 20, "early_history").when((run_dates < 60) | (sources < 3), "monitor_ready").otherwise("validation_candidate")


def valve(confidence: Column, enabled: Column, version: Column, calls: Column, horizons: Column, horizon: Column, supported: str = "1.0", least: int = 200) -> Column:
    """struct(calibrated, applied, reason): the confidence within 0..1 with why it is, or is not, taken through a calibration. No learned transform exists, so it never changes."""
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    reason = (
        F.when(~enabled, "disabled").when(version.isNull(), "artifact_missing").when(version != supported, "schema_version_unsupported").when(F.coalesce(calls, F.lit(0)) < least, "insufficient_sample")
        .when(horizon.isNull() | ~F.coalesce(F.array_contains(horizons, horizon), F.lit(False)), "horizon_unsupported").otherwise("applied")
    )
    return F.struct(raw.alias("calibrated"), (reason == "applied").alias("applied"), reason.alias("reason"))


def bucket_of(confidence: Column, edges: list[float]) -> Column:
    """Label of a right-closed bucket, the lowest value in the first; null outside."""
    c = F.greatest(F.lit(edges[0]), F.least(F.lit(edges[-1]), confidence))
    return reduce(lambda a, e: F.when((c <= e[1]), f"{e[0]:.1f}-{e[1]:.1f}").otherwise(a), reversed(list(zip(edges, edges[1:]))), F.lit(None).cast("string"))


def confidence_buckets(rows: DataFrame, ret: str, edges: list[float]) -> DataFrame:
    """(bucket, n, hit_rate, avg_signed, avg_raw) of directional calls with a return; empty buckets are kept."""
    signed = F.col("expected_sign") * F.col(ret)
    live = rows.where(F.col("expected_sign").isNotNull() & F.col(ret).isNotNull() & F.col("confidence").isNotNull())
    g = live.groupBy(bucket_of(F.col("confidence"), edges).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg((signed > 0).cast("double")).alias("hit_rate"), F.avg(signed).alias("avg_signed"), F.avg(ret).alias("avg_raw"))
    spine = rows.sparkSession.createDataFrame([(f"{a:.1f}-{b:.1f}",) for a, b in zip(edges, edges[1:])], "bucket string")
    return spine.join(g, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "hit_rate", "avg_signed", "avg_raw")


def calibration_artifact(rows: DataFrame, horizons: list[int], least: int = 200) -> DataFrame:
    """(directional_calls, horizons, ready): horizons that have at least ``least`` directional calls with a return."""
    counts = [F.count_if(F.col("expected_sign").isNotNull() & F.col(f"relative_forward_{h}m_return").isNotNull()).alias(f"c{h}") for h in horizons]
    got = F.array_compact(F.array(*[F.when(F.col(f"c{h}") >= least, f"{h}m") for h in horizons]))
    most = F.greatest(*[F.col(f"c{h}") for h in horizons]) if len(horizons) > 1 else F.col(f"c{horizons[0]}")
    return rows.agg(*counts).select(most.alias("directional_calls"), got.alias("horizons"), (F.size(got) > 0).alias("ready"))


def warned(**tests: Column) -> Column:
    """Array of the names of the tests that are true."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in tests.items()]))


def run_status(failed: Column, warnings: Column) -> Column:
    return F.when(failed > 0, "failed").when(warnings > 0, "success_with_warnings").otherwise("success")
