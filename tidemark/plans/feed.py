"""Items, their classifications and what is drawn from them, over the delivered news, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import classify, items
from tidemark.operators.asof import forward_returns
from tidemark.operators.quality import nearest_rank
from tidemark.plans.macro import loose, prices, rounded
from tidemark.session import table

LONG_THEMES = ["ai_compute", "energy_transition"]
GROUP_RULES = [
    {"group": "policy", "title": ["central bank", "minister"], "body": ["legislation"]}, {"group": "energy", "source": ["energy"], "title": ["oil", "gas"]}, {"group": "markets", "title": ["bond", "index"]},
]
GROUPS = ["policy", "energy", "markets"]
REPLAY_DAYS = ["2025-03-05", "2025-03-06", "2025-09-20"]
EDGES = [0.0, 0.3, 0.6, 0.8, 1.0]
PROXIES = {"energy": "Brand#11", "real_estate": "Brand#12"}


def nine(df: DataFrame) -> DataFrame:
    return rounded(df, 9)


def news(spark: SparkSession, d: str) -> DataFrame:
    """Delivered records; one in thirteen has no time."""
    n = table(spark, d, "sample_news_items")
    at = F.col("ingested_at").cast("timestamp")
    return n.select(F.col("item_id").alias("news_id"), "source", "source_url", "title", "body", "provider", "source_group", at.alias("ingested_at"), F.when(F.col("item_id") % 13 != 0, at).alias("published_at"))


def classes(spark: SparkSession, d: str) -> DataFrame:
    """One classification, of every tenth item two, of six items in seven, by the rules; some failed."""
    n = news(spark, d).where("news_id % 7 <> 3").select("news_id", "ingested_at", classify.rule_class(F.concat_ws(" ", "title", "body")).alias("c"))
    n = n.withColumn("v", F.explode(F.when(F.col("news_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    i, v = F.col("news_id"), F.col("v")
    failed = (i + v) % 17 == 0
    long = F.when(i % 5 == 0, LONG_THEMES[0]).when(i % 5 == 1, LONG_THEMES[1]).when(i % 5 == 2, "unlisted")
    blob = F.concat(F.lit('{"retry_count": '), F.when(i % 4 == 0, 1).otherwise(0), F.lit(', "was_repaired": '), F.when(i % 6 == 0, "true").otherwise("false"), F.lit(', "response": {"_provider_usage": {"completion_tokens": '), i % 100, F.lit(', "finish_reason": "'), F.when(i % 9 == 0, "length").otherwise("stop"), F.lit('"}}}'))
    return n.select(
        (i * 2 + v).alias("classification_id"), i, F.expr("ingested_at + make_interval(0, 0, 0, 0, v + 1)").alias("classified_at"), F.when(i % 3 == 0, "mock").otherwise("live").alias("ai_provider"), F.lit("m1").alias("ai_model"),
        F.when(failed, "error").otherwise("success").alias("classification_status"), F.when(failed, F.when(i % 2 == 0, "timeout after 30s\ntrace").otherwise("schema: bad severity")).alias("error_message"),
        (F.col("c.severity") / (v + 1)).alias("severity"), F.col("c.confidence").alias("confidence"), long.alias("secular_theme"), F.when(i % 11 == 0, "not json").otherwise(blob).alias("raw_json"), "c", "v",
    )


def themes(spark: SparkSession, d: str) -> DataFrame:
    return classes(spark, d).where("v = 0").select("news_id", F.col("c.theme").alias("theme_id"), F.col("c.direction").alias("direction"), F.col("c.severity").alias("severity"), F.when(F.col("news_id") % 19 != 0, F.col("c.confidence")).alias("confidence"))


def impacts(spark: SparkSession, d: str) -> DataFrame:
    """Impacts of the rules that have one."""
    return classes(spark, d).where("v = 0 and c.sector is not null").select("news_id", F.col("c.sector").alias("sector_id"), F.col("c.impact").alias("impact_direction"), F.col("c.score").alias("impact_score"), F.col("c.impact_confidence").alias("confidence"))


ITEM = "it AS (SELECT item_id AS news_id, source, source_url, title, body, provider, source_group, ingested_at, CASE WHEN item_id % 13 <> 0 THEN ingested_at END AS published_at FROM sample_news_items)"
CLASS = f"""{ITEM}, ru AS (SELECT *, CASE WHEN contains(t, 'oil') OR contains(t, 'energy') THEN 1 WHEN contains(t, 'fed') OR contains(t, 'rate') OR contains(t, 'central bank') THEN 2 ELSE 3 END AS k FROM (SELECT *, lower(concat_ws(' ', title, body)) AS t FROM it WHERE news_id % 7 <> 3)),
vs AS (SELECT *, unnest(CASE WHEN news_id % 10 = 0 THEN [0, 1] ELSE [0] END) AS v FROM ru),
cl AS (SELECT news_id * 2 + v AS classification_id, news_id, ingested_at + to_hours(v + 1) AS classified_at, CASE WHEN news_id % 3 = 0 THEN 'mock' ELSE 'live' END AS ai_provider, 'm1' AS ai_model, CASE WHEN (news_id + v) % 17 = 0 THEN 'error' ELSE 'success' END AS classification_status,
 CASE WHEN (news_id + v) % 17 = 0 THEN CASE WHEN news_id % 2 = 0 THEN 'timeout after 30s' ELSE 'schema: bad severity' END END AS mode, CASE k WHEN 1 THEN 0.6 WHEN 2 THEN 0.5 ELSE 0.2 END::DOUBLE AS sev0, (CASE k WHEN 1 THEN 0.6 WHEN 2 THEN 0.5 ELSE 0.2 END / (v + 1))::DOUBLE AS severity,
 CASE k WHEN 1 THEN 0.8 WHEN 2 THEN 0.7 ELSE 0.35 END::DOUBLE AS confidence, CASE news_id % 5 WHEN 0 THEN 'ai_compute' WHEN 1 THEN 'energy_transition' WHEN 2 THEN 'unlisted' END AS secular_theme, k, v, news_id % 11 = 0 AS garbage,
 CASE k WHEN 1 THEN 'commodity_pressure' WHEN 2 THEN 'monetary_tightening' ELSE 'growth_slowdown' END AS theme_id, CASE k WHEN 3 THEN 'unclear' ELSE 'positive' END AS direction FROM vs),
th AS (SELECT news_id, theme_id, direction, sev0 AS severity, CASE WHEN news_id % 19 <> 0 THEN confidence END AS confidence FROM cl WHERE v = 0),
im AS (SELECT news_id, CASE k WHEN 1 THEN 'energy' ELSE 'real_estate' END AS sector_id, CASE k WHEN 1 THEN 'tailwind' ELSE 'headwind' END AS impact_direction, CASE k WHEN 1 THEN 0.5 ELSE -0.4 END::DOUBLE AS impact_score, CASE k WHEN 1 THEN 0.75 ELSE 0.7 END::DOUBLE AS confidence FROM cl WHERE v = 0 AND k < 3),
la AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY classified_at DESC, classification_id DESC) = 1)"""
SQL: dict[str, str] = {}
QUERIES = {}


def query(sql: str | None = None):
    """Registers a query with the SQL it is compared with."""

    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


@query(f"WITH {CLASS} SELECT classification_id, news_id, theme_id, direction, round(severity, 9) AS severity, confidence, classification_status, secular_theme FROM cl")
def classified(spark: SparkSession, d: str) -> DataFrame:
    """The rule classifications with their real constants, the unclear branch included."""
    return nine(classes(spark, d).select("classification_id", "news_id", F.col("c.theme").alias("theme_id"), F.col("c.direction").alias("direction"), "severity", "confidence", "classification_status", "secular_theme"))


@query(f"WITH {CLASS} SELECT th.news_id, theme_id, direction, severity, coalesce(confidence, 0) AS confidence, source, published_at::DATE AS day FROM th LEFT JOIN it USING (news_id) WHERE news_id IN (SELECT news_id FROM cl WHERE classification_status = 'success')")
def theme_items(spark: SparkSession, d: str) -> DataFrame:
    t = items.theme_base(themes(spark, d), news(spark, d), classes(spark, d))
    return t.select("news_id", "theme_id", "direction", "severity", "confidence", "source", F.to_date("published_at").alias("day"))


@query(f"WITH {CLASS}, s AS (SELECT DISTINCT news_id, severity FROM cl WHERE classification_status = 'success') SELECT im.news_id, sector_id, impact_score, im.confidence, source, round(s.severity, 9) AS severity FROM im LEFT JOIN it USING (news_id) JOIN s ON s.news_id = im.news_id")
def sector_items(spark: SparkSession, d: str) -> DataFrame:
    """Two successful classifications of an item with different severities give two rows."""
    return nine(items.sector_base(impacts(spark, d), news(spark, d), classes(spark, d)).select("news_id", "sector_id", "impact_score", "confidence", "source", "severity"))


@query(f"WITH {CLASS}, x AS (SELECT cl.*, title FROM cl LEFT JOIN it USING (news_id)) SELECT 'high_severity' AS kind, classification_id, title FROM x WHERE coalesce(severity, 0) >= 0.6 UNION ALL SELECT 'low_confidence', classification_id, title FROM x WHERE coalesce(confidence, 0) <= 0.4")
def class_report_rows(spark: SparkSession, d: str) -> DataFrame:
    c = classes(spark, d).join(news(spark, d).select("news_id", "title"), "news_id", "left")
    kinds = F.array_compact(F.array(F.when(items.high_severity(F.col("severity")), "high_severity"), F.when(items.low_confidence(F.col("confidence")), "low_confidence")))
    return c.select(F.explode(kinds).alias("kind"), "classification_id", "title")


@query(f"WITH {CLASS} SELECT classification_id, secular_theme, coalesce(published_at, classified_at)::DATE AS day, round(severity, 9) AS severity FROM cl LEFT JOIN it USING (news_id) WHERE classification_status = 'success' AND secular_theme IN ('ai_compute', 'energy_transition')")
def dated_events(spark: SparkSession, d: str) -> DataFrame:
    e = items.dated_events(classes(spark, d), news(spark, d), LONG_THEMES)
    return nine(e.select("classification_id", "secular_theme", F.to_date("event_at").alias("day"), "severity"))


LEDGER = "lg AS (SELECT la.classification_id, im.news_id, {when}::DATE AS prediction_date, sector_id, im.impact_score, im.confidence, CASE impact_direction WHEN 'tailwind' THEN 1.0 WHEN 'headwind' THEN -1.0 END AS expected_sign FROM im LEFT JOIN la USING (news_id) LEFT JOIN it USING (news_id))"


@query(f"WITH {CLASS}, {LEDGER.format(when='la.classified_at')} SELECT * FROM lg")
def ledger_rows(spark: SparkSession, d: str) -> DataFrame:
    return items.ledger(impacts(spark, d), classes(spark, d)).drop("impact_direction")


@query(f"WITH {CLASS}, {LEDGER.format(when='it.published_at')} SELECT * FROM lg WHERE news_id NOT IN (SELECT news_id FROM it WHERE provider = 'gdelt')")
def ledger_live(spark: SparkSession, d: str) -> DataFrame:
    """Dated by publication, without what one provider filled in afterwards."""
    n = news(spark, d)
    return items.without_provider(items.ledger(impacts(spark, d), classes(spark, d), n).drop("impact_direction"), n, "gdelt")


@query(f"WITH {CLASS}, p AS (SELECT it.news_id, secular_theme, la.confidence, published_at FROM it LEFT JOIN la USING (news_id)) SELECT news_id, secular_theme FROM p WHERE secular_theme IS NULL OR coalesce(confidence, 0) <= 0.35 ORDER BY published_at DESC NULLS LAST, news_id DESC LIMIT 200")
def discovery_pool(spark: SparkSession, d: str) -> DataFrame:
    """The two hundred newest."""
    return items.newest(items.discovery_pool(news(spark, d), classes(spark, d), 0.35), "published_at", 200).select("news_id", "secular_theme")


@query(f"WITH {CLASS} SELECT news_id FROM it WHERE news_id NOT IN (SELECT news_id FROM cl) ORDER BY published_at DESC NULLS FIRST, news_id DESC LIMIT 120")
def classification_queue(spark: SparkSession, d: str) -> DataFrame:
    """The newest 120 without any classification, those of unknown time first."""
    return items.newest(items.unclassified(news(spark, d), classes(spark, d)), "published_at", 120, unknown_new=True).select("news_id")


@query(f"WITH {CLASS}, p AS (SELECT it.*, la.confidence FROM it LEFT JOIN la USING (news_id) WHERE secular_theme IS NULL OR coalesce(la.confidence, 0) <= 0.35), s AS (SELECT source_group AS candidate, count(DISTINCT news_id) AS distinct_articles, count(DISTINCT published_at::DATE) AS days_observed, count(DISTINCT source) AS source_diversity FROM p WHERE source_group IS NOT NULL GROUP BY 1) SELECT *, CASE WHEN distinct_articles < 8 THEN 'articles' WHEN days_observed < 5 THEN 'days' WHEN source_diversity < 3 THEN 'sources' END AS failing, distinct_articles >= 8 AND days_observed >= 5 AND source_diversity >= 3 AS promote FROM s".replace("SELECT it.*, la.confidence", "SELECT it.*, la.confidence, la.secular_theme"))
def theme_support(spark: SparkSession, d: str) -> DataFrame:
    pool = items.discovery_pool(news(spark, d), classes(spark, d), 0.35).where("source_group is not null").withColumnRenamed("source_group", "candidate")
    return items.promoted(items.support(pool, "candidate"))


REPLAYED = f"{ITEM}, dy AS (SELECT unnest([{', '.join(f'DATE {chr(39)}{x}{chr(39)}' for x in REPLAY_DAYS)}]) AS replay_day), rp AS (SELECT replay_day, news_id, source_group, published_at FROM it JOIN dy ON published_at::DATE BETWEEN replay_day - 10 AND replay_day QUALIFY row_number() OVER (PARTITION BY replay_day ORDER BY published_at DESC, news_id DESC) <= 10)"


def replayed(spark: SparkSession, d: str) -> DataFrame:
    return items.replay(news(spark, d), REPLAY_DAYS, 10, 10)


@query(f"WITH {REPLAYED} SELECT replay_day, news_id FROM rp")
def replay_items(spark: SparkSession, d: str) -> DataFrame:
    return replayed(spark, d).select("replay_day", "news_id")


@query(f"WITH {REPLAYED} SELECT count(*) FILTER (published_at::DATE > replay_day) AS leaked FROM rp")
def replay_leaks(spark: SparkSession, d: str) -> DataFrame:
    return items.leaks(replayed(spark, d))


@query(f"WITH {ITEM}, i AS (SELECT published_at::DATE AS day, coalesce(source_group, 'unmapped') AS grp FROM it WHERE published_at IS NOT NULL), s AS (SELECT unnest(generate_series((SELECT min(day) FROM i), (SELECT max(day) FROM i), INTERVAL 1 DAY))::DATE AS day), n AS (SELECT day, grp, count(*) AS n FROM i GROUP BY 1, 2) SELECT s.day, coalesce(grp, '(none)') AS grp, coalesce(n, 0) AS n, n IS NULL AS gap FROM s LEFT JOIN n USING (day)")
def replay_summary(spark: SparkSession, d: str) -> DataFrame:
    """Items by day and group; days without any are gaps."""
    n = news(spark, d).where("published_at is not null").select(F.to_date("published_at").alias("day"), F.coalesce("source_group", F.lit("unmapped")).alias("grp"))
    g = n.groupBy("day", "grp").agg(F.count(F.lit(1)).alias("n"))
    span = n.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return span.join(g, "day", "left").select("day", F.coalesce("grp", F.lit("(none)")).alias("grp"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("gap"))


@query(f"WITH {CLASS} SELECT theme_id, count(*) AS n, round(avg(severity), 9) AS average_severity, round(avg(confidence), 9) AS average_confidence FROM th GROUP BY 1 ORDER BY round(avg(severity), 9) DESC, 2 DESC, 1 LIMIT 10")
def report_themes(spark: SparkSession, d: str) -> DataFrame:
    return nine(items.ranked_groups(themes(spark, d), "theme_id", "average_severity", average_severity=F.avg("severity"), average_confidence=F.avg("confidence")))


@query(f"WITH {CLASS} SELECT sector_id, count(*) AS n, round(avg(impact_score), 9) AS average_impact_score, round(avg(abs(impact_score)), 9) AS average_absolute_impact, round(avg(confidence), 9) AS average_confidence FROM im GROUP BY 1 ORDER BY round(avg(abs(impact_score)), 9) DESC, 2 DESC, 1 LIMIT 10")
def report_sectors(spark: SparkSession, d: str) -> DataFrame:
    i = impacts(spark, d)
    return nine(items.ranked_groups(i, "sector_id", "average_absolute_impact", average_impact_score=F.avg("impact_score"), average_absolute_impact=F.avg(F.abs("impact_score")), average_confidence=F.avg("confidence")))


@query(f"WITH {CLASS} SELECT ai_provider AS value, count(*) AS n FROM cl GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def provider_counts(spark: SparkSession, d: str) -> DataFrame:
    return items.value_counts(classes(spark, d), "ai_provider").withColumnRenamed("ai_provider", "value")


def blob(c: DataFrame) -> DataFrame:
    """Facts out of the stored answer; what is no JSON has none."""
    get = lambda p: F.get_json_object("raw_json", p)
    return c.select("*", F.coalesce(get("$.retry_count").try_cast("int"), F.lit(0)).alias("retries"), (get("$.was_repaired") == "true").alias("repaired"), get("$.response._provider_usage.finish_reason").alias("finish"), get("$.response._provider_usage.completion_tokens").try_cast("long").alias("tokens"))


QA = f"WITH {CLASS}, b AS (SELECT *, NOT garbage AND news_id % 4 = 0 AS r, NOT garbage AND news_id % 6 = 0 AS p, NOT garbage AND news_id % 9 = 0 AS t, CASE WHEN NOT garbage THEN news_id % 100 END AS tok FROM cl)"


@query(f"{QA}, q AS (SELECT count(*) AS total, count(*) FILTER (classification_status = 'success') AS success, count(*) FILTER (r) AS retries, count(*) FILTER (p) AS repaired, count(*) FILTER (t) AS truncated FROM b) SELECT total, success, total - success AS failure, retries, repaired, truncated, round(success / total, 9) AS success_rate, round(truncated / total, 9) AS truncation_rate, array_to_string(list_filter([CASE WHEN (total - success) / total > 0.05 THEN 'failures' END, CASE WHEN retries / total > 0.2 THEN 'retries' END, CASE WHEN repaired / total > 0.2 THEN 'repairs' END, CASE WHEN truncated / total > 0.1 THEN 'truncations' END], lambda x: x IS NOT NULL), ',') AS warnings FROM q")
def classification_qa(spark: SparkSession, d: str) -> DataFrame:
    """Rates of success, retries, repairs and cut answers, and which exceed their limits."""
    q = blob(classes(spark, d)).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("classification_status") == "success").alias("success"), F.sum("retries").cast("long").alias("retries"), F.count_if("repaired").alias("repaired"), F.count_if(F.col("finish") == "length").alias("truncated"))
    share = lambda c: F.try_divide(F.col(c), F.col("total"))
    q = q.withColumn("failure", F.col("total") - F.col("success"))
    w = items.warned(failures=share("failure") > 0.05, retries=share("retries") > 0.2, repairs=share("repaired") > 0.2, truncations=share("truncated") > 0.1)
    return nine(q.select("total", "success", "failure", "retries", "repaired", "truncated", share("success").alias("success_rate"), share("truncated").alias("truncation_rate"), F.array_join(w, ",").alias("warnings")))


@query(f"WITH {CLASS} SELECT mode AS failure_mode, count(*) AS n FROM cl WHERE mode IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def failure_modes(spark: SparkSession, d: str) -> DataFrame:
    c = classes(spark, d).where("error_message is not null").groupBy(items.failure_mode(F.col("error_message")).alias("failure_mode")).agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.col("n").desc(), "failure_mode").limit(5)


@query(f"{QA} SELECT ai_provider, ai_model, count(*) AS n, count(tok) AS with_usage, coalesce(sum(tok), 0)::BIGINT AS tokens, max(tok)::DOUBLE AS most, quantile_disc(tok, 0.95)::DOUBLE AS p95, round(coalesce(count(*) FILTER (t) / nullif(count(tok), 0), 0), 4) AS truncation_rate FROM b GROUP BY 1, 2")
def usage_report(spark: SparkSession, d: str) -> DataFrame:
    u = blob(classes(spark, d)).groupBy("ai_provider", "ai_model").agg(
        F.count(F.lit(1)).alias("n"), F.count("tokens").alias("with_usage"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_"), F.max("tokens").alias("most"), nearest_rank("tokens", 0.95).alias("p95"), F.count_if(F.col("finish") == "length").alias("cut"),
    )
    rate = F.round(F.coalesce(F.try_divide(F.col("cut"), F.col("with_usage")), F.lit(0.0)), 4)
    return loose(u.select("ai_provider", "ai_model", "n", "with_usage", F.col("tokens_").alias("tokens"), "most", "p95", rate.alias("truncation_rate")), "most", "p95")


@query(f"WITH {CLASS}, r AS (SELECT ingested_at::DATE AS run_date, count(*) AS n, count(DISTINCT title) AS uniq, count(DISTINCT source) AS sources, count(DISTINCT source_group) AS groups FROM it GROUP BY 1), c AS (SELECT i.ingested_at::DATE AS run_date, count(*) FILTER (classification_status = 'success') AS ok, count(*) AS tried FROM cl JOIN it i USING (news_id) GROUP BY 1) SELECT run_date, n, uniq AS unique_items, n - uniq AS duplicates, sources, groups, coalesce(ok, 0) AS classified, round(coalesce(ok / tried, 0), 9) AS success_rate, CASE WHEN n < 5 OR sources < 3 OR coalesce(ok / tried, 0) < 0.9 THEN 'warning' ELSE 'ok' END AS status FROM r LEFT JOIN c USING (run_date)")
def accumulation_days(spark: SparkSession, d: str) -> DataFrame:
    n = news(spark, d).withColumn("run_date", F.to_date("ingested_at"))
    r = n.groupBy("run_date").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("title").alias("unique_items"), F.countDistinct("source").alias("sources"), F.countDistinct("source_group").alias("groups"))
    c = classes(spark, d).select("news_id", "classification_status").join(n.select("news_id", "run_date"), "news_id").groupBy("run_date").agg(F.count_if(F.col("classification_status") == "success").alias("ok"), F.count(F.lit(1)).alias("tried"))
    rate = F.coalesce(F.try_divide("ok", "tried"), F.lit(0.0))
    status = F.when(F.size(items.warned(items=F.col("n") < 5, sources=F.col("sources") < 3, success=rate < 0.9)) > 0, "warning").otherwise("ok")
    return nine(r.join(c, "run_date", "left").select("run_date", "n", "unique_items", (F.col("n") - F.col("unique_items")).alias("duplicates"), "sources", "groups", F.coalesce("ok", F.lit(0)).alias("classified"), rate.alias("success_rate"), status.alias("status")))


@query(f"WITH {CLASS}, s AS (SELECT count(DISTINCT ingested_at::DATE) AS days, count(DISTINCT source) AS sources FROM it), c AS (SELECT count(*) AS ok FROM cl WHERE classification_status = 'success') SELECT days, ok AS classified, sources, CASE WHEN days < 5 OR ok < 100 THEN 'insufficient_history' WHEN days < 20 THEN 'early_history' WHEN days < 60 OR sources < 3 THEN 'monitor_ready' ELSE 'validation_candidate' END AS label FROM s, c")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    s = news(spark, d).agg(F.countDistinct(F.to_date("ingested_at")).alias("days"), F.countDistinct("source").alias("sources"))
    c = items.successful(classes(spark, d)).agg(F.count(F.lit(1)).alias("classified"))
    return s.crossJoin(c).select("days", "classified", "sources", items.readiness(F.col("days"), F.col("classified"), F.col("sources")).alias("label"))


@query(f"WITH {ITEM}, a AS (SELECT coalesce(source_group, 'unmapped') AS grp, count(*) AS n FROM it GROUP BY 1), t AS (SELECT sum(n) AS n, max(n) FILTER (grp <> 'unmapped') AS most, coalesce(max(n) FILTER (grp = 'unmapped'), 0) AS unmapped, count(*) FILTER (grp <> 'unmapped') AS groups FROM a), u AS (SELECT (count(*) - count(DISTINCT title))::BIGINT AS repeated, count(DISTINCT source) AS sources, count(*) FILTER (published_at IS NULL) AS undated FROM it) SELECT t.n::BIGINT AS n, sources, groups, repeated, round(unmapped / t.n, 9) AS unmapped_pct, array_to_string(list_filter([CASE WHEN sources < 3 THEN 'sources' END, CASE WHEN groups < 4 THEN 'groups' END, CASE WHEN most / t.n > 0.4 THEN 'concentration' END, CASE WHEN unmapped / t.n > 0.1 THEN 'unmapped' END], lambda x: x IS NOT NULL), ',') AS warnings, CASE WHEN undated > t.n / 2 THEN 'blocked' WHEN sources < 3 OR groups < 4 OR most / t.n > 0.4 OR unmapped / t.n > 0.1 THEN 'warning' ELSE 'ok' END AS status FROM t, u")
def input_quality_status(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds over the input's make-up: what exceeds them, and the status."""
    n = news(spark, d)
    a = n.groupBy(F.coalesce("source_group", F.lit("unmapped")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    un = F.col("grp") == "unmapped"
    t = a.agg(F.sum("n").alias("n"), F.max(F.when(~un, F.col("n"))).alias("most"), F.coalesce(F.max(F.when(un, F.col("n"))), F.lit(0)).alias("unmapped"), F.count_if(~un).alias("groups"))
    u = n.agg((F.count(F.lit(1)) - F.countDistinct("title")).alias("repeated"), F.countDistinct("source").alias("sources"), F.count_if(F.col("published_at").isNull()).alias("undated"))
    share = lambda c: F.try_divide(F.col(c), F.col("n"))
    w = items.warned(sources=F.col("sources") < 3, groups=F.col("groups") < 4, concentration=share("most") > 0.4, unmapped=share("unmapped") > 0.1)
    status = F.when(F.col("undated") > F.col("n") / 2, "blocked").when(F.size(w) > 0, "warning").otherwise("ok")
    return nine(t.crossJoin(u).select("n", "sources", "groups", "repeated", share("unmapped").alias("unmapped_pct"), F.array_join(w, ",").alias("warnings"), status.alias("status")))


@query(f"""WITH {ITEM}, i AS (SELECT coalesce(source_group, 'unmapped') AS grp, published_at::DATE AS day FROM it), l AS (SELECT max(day) AS last FROM i), g AS (SELECT grp, count(*) AS n, max(day) AS latest, count(*) FILTER (day = last) AS last_n, count(*) FILTER (date_diff('day', day, DATE '2027-01-01') > 365) AS old FROM i, l GROUP BY 1)
SELECT grp, n, latest, last_n, old, date_diff('day', latest, DATE '2027-01-01') > 200 AS stale, coalesce(last_n / sum(last_n) OVER () > 0.3, false) AS over FROM g""")
def coverage_groups(spark: SparkSession, d: str) -> DataFrame:
    """Per group: count, latest day, count on the last day of all, old items, and whether it is stale or over-represented on that day."""
    i = news(spark, d).select(F.coalesce("source_group", F.lit("unmapped")).alias("grp"), F.to_date("published_at").alias("day"))
    last = i.agg(F.max("day").alias("last"))
    at = F.to_date(F.lit("2027-01-01"))
    g = i.crossJoin(F.broadcast(last)).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("latest"), F.count_if(F.col("day") == F.col("last")).alias("last_n"), F.count_if(F.datediff(at, "day") > 365).alias("old"))
    # one row per group
    share = F.try_divide("last_n", F.sum("last_n").over(W.partitionBy()))
    return g.select("grp", "n", "latest", "last_n", "old", (F.datediff(at, "latest") > 200).alias("stale"), F.coalesce(share > 0.3, F.lit(False)).alias("over"))


RULED = " ".join(
    "WHEN " + " OR ".join(f"contains(lower(coalesce({f}, '')), '{k}')" for f in ("source", "title", "body") for k in r.get(f, [])) + f" THEN '{r['group']}'" for r in GROUP_RULES
)


@query(f"SELECT item_id, CASE WHEN item_id % 3 = 0 AND nullif(trim(source_group), '') IS NOT NULL THEN trim(source_group) WHEN item_id % 5 = 0 THEN 'policy' {RULED} END AS source_group, CASE WHEN item_id % 3 = 0 AND nullif(trim(source_group), '') IS NOT NULL THEN 'explicit_source_group' WHEN item_id % 5 = 0 THEN 'query_group' WHEN (CASE {RULED} END) IS NOT NULL THEN 'configured_rule' END AS method FROM sample_news_items")
def group_rules(spark: SparkSession, d: str) -> DataFrame:
    """Stated group, else the query's, else the first rule that matches."""
    n = table(spark, d, "sample_news_items")
    stated, asked = F.when(F.col("item_id") % 3 == 0, F.col("source_group")), F.when(F.col("item_id") % 5 == 0, "policy").otherwise("other")
    return n.select("item_id", items.mapped_group(stated, asked, F.col("source"), F.col("title"), F.col("body"), GROUP_RULES, GROUPS).alias("m")).select("item_id", "m.*")


TERMS = sorted(set(items.FORBIDDEN + items.FORBIDDEN_MORE), key=lambda t: (-len(t), t))
REPLACED = "coalesce(body, '')"
for _t in sorted(items.FORBIDDEN, key=len, reverse=True):
    REPLACED = f"regexp_replace({REPLACED}, '{_t}', '{items.REPLACEMENT}', 'gi')"


@query(f"SELECT item_id, array_to_string(list_filter([{', '.join(f'CASE WHEN contains(lower(coalesce(body, {chr(39) * 2})), {chr(39)}{t}{chr(39)}) THEN {chr(39)}{t}{chr(39)} END' for t in TERMS)}], lambda x: x IS NOT NULL), '|') AS terms, md5({REPLACED}) AS safe FROM sample_news_items")
def report_guard(spark: SparkSession, d: str) -> DataFrame:
    """Terms that a report must not hold, as substrings, and the text without them."""
    n = table(spark, d, "sample_news_items")
    return n.select("item_id", F.array_join(items.forbidden_terms(F.col("body")), "|").alias("terms"), F.md5(items.safe_text(F.col("body"))).alias("safe"))


@query(f"WITH {CLASS} SELECT classification_id, 'classification_' || substr(sha256(news_id || '|' || ai_provider || '|' || strftime(classified_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(classified_at) % 1000000 = 0 THEN '' ELSE strftime(classified_at, '.%f') END || '+00:00'), 1, 16) AS id FROM cl")
def classification_ids(spark: SparkSession, d: str) -> DataFrame:
    return classes(spark, d).select("classification_id", items.classification_id(F.col("news_id"), F.col("ai_provider"), F.col("classified_at")).alias("id"))


@query(r"SELECT item_id, md5(CASE WHEN length(body) > 200 THEN regexp_replace(substr(body, 1, 200), '[\s\x{85}\p{Z}]+$', '') || chr(10) || chr(10) || '[truncated_to_200_chars]' ELSE body END) AS cut, sha256(coalesce(body, '')) AS notes_hash FROM sample_news_items")
def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "sample_news_items")
    return n.select("item_id", F.md5(items.truncated(F.col("body"), 200)).alias("cut"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("notes_hash"))


@query("SELECT source_id, regexp_matches(replace(lower(source), ' ', '_'), '^[a-z][a-z0-9_]{2,39}$') AS snake, CASE WHEN contains(lower(trim(domain)), '.') THEN lower(trim(domain)) ELSE lower(trim(domain)) || '.us' END AS with_dot, lower(trim(replace(source, '.', ''))) || '.us' AS symbol FROM news_sources")
def symbols(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "news_sources")
    return s.select("source_id", items.snake_id(F.replace(F.lower("source"), F.lit(" "), F.lit("_"))).alias("snake"), items.stooq_symbol(F.col("domain")).alias("with_dot"), items.stooq_symbol(F.replace("source", F.lit("."), F.lit(""))).alias("symbol"))


@query("SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'unclear' WHEN 1 THEN 'positive' WHEN 2 THEN 'negative' WHEN 3 THEN 'mixed' ELSE NULL END AS theme, CASE item_id % 6 WHEN 0 THEN 'unclear' WHEN 1 THEN 'tailwind' WHEN 2 THEN 'headwind' WHEN 3 THEN 'mixed' WHEN 4 THEN 'tailwind' END AS impact, CASE item_id % 6 WHEN 0 THEN 'short_term' WHEN 1 THEN 'medium_term' WHEN 2 THEN 'long_term' WHEN 3 THEN 'unclear' ELSE NULL END AS horizon, CASE item_id % 6 WHEN 0 THEN 'central_bank' WHEN 1 THEN 'country' WHEN 2 THEN 'region' WHEN 3 THEN 'person' ELSE NULL END AS entity FROM sample_news_items")
def repaired_values(spark: SparkSession, d: str) -> DataFrame:
    """Stated values through the four alias tables; what is no value in the end gives null."""
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("item_id") % 6 + 1).cast("int"))
    return table(spark, d, "sample_news_items").select(
        "item_id", classify.repaired(pick(" Uncertain ", "positive_for_macro", "Negative_for_macro", "MIXED", "sideways", "none at all"), "theme_direction").alias("theme"),
        classify.repaired(pick("unknown", "Positive", " negative", "mixed", "positive_for_sector", "up"), "impact_direction").alias("impact"),
        classify.repaired(pick("near_term", "Medium-Term", "long-term", "UNKNOWN", "soon", ""), "time_horizon").alias("horizon"),
        classify.repaired(pick("Central Bank", "government", "geography", "individual", "robot", "x"), "entity_type").alias("entity"),
    )


def returns(spark: SparkSession, d: str) -> DataFrame:
    """Ledger rows with the relative returns of the sectors' proxies after the prediction, moved into the years that have prices."""
    rows = items.ledger(impacts(spark, d), classes(spark, d)).where("prediction_date is not null")
    day = F.add_months("prediction_date", -27 * 12)
    s = rows.select(F.col("sector_id").alias("entity_id"), day.alias("score_date")).distinct().withColumn("ticker", F.when(F.col("entity_id") == "energy", PROXIES["energy"]).otherwise(PROXIES["real_estate"])).withColumn("score", F.lit(0.0))
    got = forward_returns(s, prices(spark, d).where(F.col("ticker").isin("ALL", *PROXIES.values())), "ALL").select("entity_id", "score_date", "relative_forward_1m_return", "relative_forward_3m_return")
    return rows.join(got, (rows.sector_id == got.entity_id) & (day == got.score_date), "left").drop("entity_id", "score_date")


PRICED = f"""{CLASS}, {LEDGER.format(when='la.classified_at')}, lp AS (SELECT l_shipdate::DATE AS d, p_brand AS b, l_extendedprice AS x FROM lineitem JOIN part ON p_partkey = l_partkey),
pr AS (SELECT b AS t, d, avg(x) AS c FROM lp WHERE b IN ('Brand#11', 'Brand#12') GROUP BY 1, 2 UNION ALL SELECT 'ALL', l_shipdate::DATE, avg(l_extendedprice) FROM lineitem GROUP BY 2),
q AS (SELECT *, (prediction_date - INTERVAL 324 MONTH)::DATE AS s, CASE sector_id WHEN 'energy' THEN 'Brand#11' ELSE 'Brand#12' END AS t FROM lg WHERE prediction_date IS NOT NULL),
pb AS (SELECT DISTINCT t, a FROM (SELECT t, unnest([s, (s + INTERVAL 1 MONTH)::DATE, (s + INTERVAL 3 MONTH)::DATE]) AS a FROM q UNION ALL SELECT 'ALL', unnest([s, (s + INTERVAL 1 MONTH)::DATE, (s + INTERVAL 3 MONTH)::DATE]) FROM q)),
px AS (SELECT pb.t, a, CASE WHEN date_diff('day', a, pr.d) <= 7 THEN c END AS c FROM pb ASOF LEFT JOIN pr ON pb.t = pr.t AND pb.a <= pr.d),
rt AS (SELECT q.*, p1.c / p0.c - b1.c / b0.c AS r1, p3.c / p0.c - b3.c / b0.c AS r3 FROM q LEFT JOIN px p0 ON p0.t = q.t AND p0.a = s LEFT JOIN px p1 ON p1.t = q.t AND p1.a = (s + INTERVAL 1 MONTH)::DATE LEFT JOIN px p3 ON p3.t = q.t AND p3.a = (s + INTERVAL 3 MONTH)::DATE LEFT JOIN px b0 ON b0.t = 'ALL' AND b0.a = s LEFT JOIN px b1 ON b1.t = 'ALL' AND b1.a = (s + INTERVAL 1 MONTH)::DATE LEFT JOIN px b3 ON b3.t = 'ALL' AND b3.a = (s + INTERVAL 3 MONTH)::DATE)"""
BUCKET = "CASE WHEN c <= 0.3 THEN '0.0-0.3' WHEN c <= 0.6 THEN '0.3-0.6' WHEN c <= 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END"


@query(f"WITH {PRICED}, g AS (SELECT {BUCKET} AS bucket, count(*) AS n, avg((expected_sign * r1 > 0)::INT) AS h, avg(expected_sign * r1) AS s, avg(r1) AS w FROM (SELECT *, confidence AS c FROM rt) WHERE expected_sign IS NOT NULL AND r1 IS NOT NULL GROUP BY 1) SELECT v.bucket, coalesce(n, 0) AS n, round(h, 6) AS hit_rate, round(s, 6) AS avg_signed, round(w, 6) AS avg_raw FROM (VALUES ('0.0-0.3'), ('0.3-0.6'), ('0.6-0.8'), ('0.8-1.0')) v(bucket) LEFT JOIN g USING (bucket)")
def confidence_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Right-closed buckets with the least value in the first; empty ones are kept."""
    return rounded(items.confidence_buckets(returns(spark, d), "relative_forward_1m_return", EDGES))


@query(f"WITH {PRICED}, c AS (SELECT count(*) FILTER (r1 IS NOT NULL) AS a, count(*) FILTER (r3 IS NOT NULL) AS b FROM rt WHERE expected_sign IS NOT NULL) SELECT greatest(a, b) AS directional_calls, array_to_string(list_filter([CASE WHEN a >= 200 THEN '1m' END, CASE WHEN b >= 200 THEN '3m' END], lambda x: x IS NOT NULL), ',') AS horizons, a >= 200 OR b >= 200 AS ready FROM c")
def calibration_readiness(spark: SparkSession, d: str) -> DataFrame:
    a = items.calibration_artifact(returns(spark, d), [1, 3])
    return a.withColumn("horizons", F.array_join("horizons", ","))


@query("WITH c AS (SELECT report_row_id AS i, avg_confidence AS c FROM news_score_report WHERE avg_confidence IS NOT NULL AND NOT isnan(avg_confidence)), r AS (SELECT *, CASE WHEN i % 7 = 0 THEN 'disabled' WHEN i % 7 = 1 THEN 'artifact_missing' WHEN i % 7 = 2 THEN 'schema_version_unsupported' WHEN i % 7 = 3 THEN 'insufficient_sample' WHEN i % 7 = 4 THEN 'horizon_unsupported' ELSE 'applied' END AS reason FROM c) SELECT i AS report_row_id, greatest(0, least(1, c)) AS calibrated, reason = 'applied' AS applied, reason FROM r")
def calibration_valve(spark: SparkSession, d: str) -> DataFrame:
    """Each gate of the valve in turn."""
    i = F.col("report_row_id") % 7
    r = table(spark, d, "news_score_report").where("avg_confidence is not null and not isnan(avg_confidence)")
    v = items.valve(F.col("avg_confidence"), i != 0, F.when(i == 2, "0.1").when(i != 1, "1.0"), F.when(i == 3, 10).otherwise(500), F.array(F.lit("1m"), F.lit("3m")), F.when(i != 4, "3m").otherwise("9m"))
    return r.select("report_row_id", v.alias("v")).select("report_row_id", "v.*")


@query(f"""WITH {PRICED}, g AS (SELECT {BUCKET} AS bucket, avg((expected_sign * r1 > 0)::INT) AS h FROM (SELECT *, confidence AS c FROM rt) WHERE expected_sign IS NOT NULL AND r1 IS NOT NULL GROUP BY 1),
x AS (SELECT sector_id, avg(impact_score * c) AS raw, avg(impact_score * coalesce(round(h, 6), 0.5)) AS cal FROM (SELECT *, confidence AS c FROM lg) LEFT JOIN g ON g.bucket = {BUCKET} GROUP BY 1),
a AS (SELECT sector_id, raw FROM x), b AS (SELECT sector_id, cal FROM x WHERE sector_id <> 'energy' UNION ALL SELECT 'utilities', 0.0)
SELECT sector_id, round(raw, 6) AS raw, round(cal, 6) AS calibrated, rank() OVER (ORDER BY round(raw, 6) DESC NULLS LAST) AS raw_rank, rank() OVER (ORDER BY round(cal, 6) DESC NULLS LAST) AS calibrated_rank FROM a FULL JOIN b USING (sector_id)""")
def calibration_impact(spark: SparkSession, d: str) -> DataFrame:
    """Scores as they are against scores by the hit rate of their confidence's bucket (0.5 where none is known), full outer: either may lack a sector."""
    rows = returns(spark, d)
    rates = rounded(items.confidence_buckets(rows, "relative_forward_1m_return", EDGES)).select("bucket", "hit_rate")
    x = rows.withColumn("bucket", items.bucket_of(F.col("confidence"), EDGES)).join(F.broadcast(rates), "bucket", "left")
    s = x.groupBy("sector_id").agg(F.avg(F.col("impact_score") * F.col("confidence")).alias("raw"), F.avg(F.col("impact_score") * F.coalesce("hit_rate", F.lit(0.5))).alias("calibrated"))
    other = s.where("sector_id <> 'energy'").select("sector_id", "calibrated").unionByName(spark.createDataFrame([("utilities", 0.0)], "sector_id string, calibrated double"))
    j = rounded(s.select("sector_id", "raw").join(other, "sector_id", "full"))
    rank = lambda c: F.rank().over(W.orderBy(F.col(c).desc_nulls_last()))  # noqa: E731  one row per sector
    return loose(j.select("sector_id", "raw", "calibrated", rank("raw").cast("long").alias("raw_rank"), rank("calibrated").cast("long").alias("calibrated_rank")))
