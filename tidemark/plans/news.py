"""Event scores, text selection and quality roll-ups over the test tables, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import classify, events, quality, ranking, text
from tidemark.plans.macro import loose, rounded
from tidemark.session import table
from tidemark.sources import landing, tables

HALF_LIFE, MAX_AGE, ITEM_CAP, SOURCE_CAP, EVENT_CAP = 7.0, 6, 0.2, 0.3, 0.5
LEXICON = ["inflation", "rate", "tariff", "oil", "jobs", "wage"]
MARKERS = ["subscribe", "enable javascript"]
AS_OF = "2024-01-31"


def nine(df: DataFrame) -> DataFrame:
    """Products of two-place numbers end within nine places, so that no tie is rounded either way."""
    return rounded(df, 9)


def feed(spark: SparkSession, d: str) -> DataFrame:
    """(news_id, key, event_id, source, day, raw, severity, confidence, direction) from the event stream."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    turn = F.pmod("user_id", F.lit(3))
    severity = F.least(F.col("value") / 200, F.lit(1.0))
    direction = F.when(turn == 0, "positive").when(turn == 1, "negative").otherwise("neutral")
    x = e.select(F.col("event_id").alias("news_id"), F.pmod("user_id", F.lit(11)).cast("int").alias("key"), F.floor(F.col("event_id") / 4).cast("long").alias("event_id"), F.col("event_type").alias("source"), F.to_date("ts").alias("day"), severity.alias("severity"), (F.pmod(k, F.lit(100)) / 100.0).alias("confidence"), direction.alias("direction"))
    return x.withColumn("raw", events.sign(F.col("direction")) * F.col("severity"))


FEED = """nf AS (SELECT event_id AS i, (user_id % 11)::INT AS key, event_id // 4 AS ev, event_type AS src, ts::DATE AS d, least(value / 200, 1.0) AS sev, ((props->>'$.k')::INT % 100) / 100.0::DOUBLE AS conf, CASE user_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END AS sg FROM events),
nw AS (SELECT *, sg * sev AS raw FROM nf)"""
LIVE = f"""{FEED}, sp AS (SELECT unnest(generate_series((SELECT min(d) FROM nw), (SELECT max(d) FROM nw), INTERVAL 1 DAY))::DATE AS sd),
cp AS (SELECT nw.*, sd, greatest(-0.2, least(0.2, raw * conf * pow(0.5, date_diff('day', d, sd) / 7.0))) AS a FROM nw JOIN sp ON sd BETWEEN d AND d + 6 WHERE conf >= 0.1)"""
DAY = f"""{LIVE}, dn AS (SELECT sd, key, sum(raw) AS raw_score, count(DISTINCT i) AS item_count, count(*) FILTER (a > 0.03) AS pos, count(*) FILTER (a < -0.03) AS neg, count(*) FILTER (abs(a) <= 0.03) AS neu, avg(conf) AS ac, avg(sev) AS asv FROM cp GROUP BY 1, 2),
c1 AS (SELECT sd, key, ev, greatest(-0.3, least(0.3, sum(a))) AS s FROM cp GROUP BY sd, key, ev, src), c2 AS (SELECT sd, key, greatest(-0.5, least(0.5, sum(s))) AS s FROM c1 GROUP BY sd, key, ev), c3 AS (SELECT sd, key, sum(s) AS adj FROM c2 GROUP BY 1, 2),
dd AS (SELECT * FROM dn JOIN c3 USING (sd, key))"""
CELLS = "round(raw_score, 9) AS raw_score, round(adj, 9) AS adjusted_score"


def comps(spark: SparkSession, d: str) -> DataFrame:
    return events.components(feed(spark, d), HALF_LIFE, MAX_AGE, ITEM_CAP, min_confidence=0.1)


def days(spark: SparkSession, d: str) -> DataFrame:
    return events.daily(comps(spark, d), SOURCE_CAP, EVENT_CAP)


def news_components(spark: SparkSession, d: str) -> DataFrame:
    return nine(comps(spark, d).select("news_id", "key", "score_date", "raw", "freshness", "adjusted"))


def daily_theme_scores(spark: SparkSession, d: str) -> DataFrame:
    return nine(events.daily(comps(spark, d), SOURCE_CAP).select("score_date", "key", "raw_score", "adjusted_score", "item_count", "avg_confidence", "avg_severity"))


def daily_sector_scores(spark: SparkSession, d: str) -> DataFrame:
    return nine(days(spark, d).select("score_date", "key", "raw_score", "adjusted_score", "positive_count", "negative_count", "neutral_count", "avg_confidence"))


def weekly_scores(spark: SparkSession, d: str) -> DataFrame:
    return nine(events.weekly(days(spark, d)).select("week_start", "key", "raw_score", "adjusted_score", "item_count", "positive_count"))


def top_ids(spark: SparkSession, d: str) -> DataFrame:
    c = comps(spark, d).withColumn("adjusted", F.round("adjusted", 9))
    return events.daily_top(c).select("score_date", "key", F.array_join("top_ids", ",").alias("top_ids"))


def weekly_top_ids(spark: SparkSession, d: str) -> DataFrame:
    c = comps(spark, d).withColumn("adjusted", F.round("adjusted", 9))
    return events.weekly_top(events.daily_top(c)).select("week_start", "key", F.array_join("top_ids", ",").alias("top_ids"))


def secular_scores(spark: SparkSession, d: str) -> DataFrame:
    return nine(events.secular(feed(spark, d), AS_OF, 45.0, 180, ITEM_CAP, 3.0, 10).select("key", "score", "raw_score", "trend", "item_count", "avg_confidence"))


def secular_periods(spark: SparkSession, d: str) -> DataFrame:
    return nine(events.period_scores(feed(spark, d), "quarter", AS_OF, 45.0, 180, ITEM_CAP, 3.0))


def macro_cross(spark: SparkSession, d: str) -> DataFrame:
    """A cross-section on three dates: customers' balances by key."""
    c = table(spark, d, "customer").groupBy(F.pmod("c_custkey", F.lit(11)).cast("int").alias("key"), F.pmod("c_nationkey", F.lit(3)).alias("m")).agg(F.avg("c_acctbal").alias("score"))
    return c.select("key", F.date_add(F.to_date(F.lit("2023-12-28")), (F.col("m") * 12).cast("int")).alias("date"), "score")


def combined_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return nine(events.combined(macro_cross(spark, d), days(spark, d), max_age=2))


def rank_changes(spark: SparkSession, d: str) -> DataFrame:
    """Rank by the combined score against rank by the macro score."""
    c = events.combined(macro_cross(spark, d), days(spark, d), max_age=2)
    m = F.row_number().over(W.partitionBy("diagnostic_date").orderBy(F.round("macro_score", 12).desc(), "key"))
    return c.select("diagnostic_date", "key", (m - F.col("rank")).cast("int").alias("change"))


MACRO = "mc AS (SELECT (c_custkey % 11)::INT AS key, DATE '2023-12-28' + ((c_nationkey % 3) * 12)::INT AS md, avg(c_acctbal) AS score FROM customer GROUP BY 1, 2), mz AS (SELECT key, md, (score - avg(score) OVER (PARTITION BY md)) / nullif(stddev_pop(score) OVER (PARTITION BY md), 0) AS z FROM mc)"
COMB = f"""{DAY}, {MACRO}, ds AS (SELECT DISTINCT sd FROM dd), am AS (SELECT sd, (SELECT max(md) FROM mc WHERE md <= sd) AS md FROM ds),
b AS (SELECT am.sd, mz.key, coalesce(z, 0) AS ms FROM am JOIN mz USING (md)),
n AS (SELECT b.sd, b.key, b.ms, x.sd AS nd, x.adj, x.item_count AS ic, x.ac FROM b ASOF LEFT JOIN dd x ON b.key = x.key AND b.sd >= x.sd),
u AS (SELECT sd, key, ms, CASE WHEN date_diff('day', nd, sd) <= 2 THEN greatest(-1, least(1, adj)) ELSE 0 END AS ns, coalesce(CASE WHEN date_diff('day', nd, sd) <= 2 THEN ic END, 0) AS ic, coalesce(CASE WHEN date_diff('day', nd, sd) <= 2 THEN ac END, 0) AS ac FROM n),
w AS (SELECT *, CASE WHEN ic >= 1 THEN 0.75 ELSE 1 END AS mw, CASE WHEN ic >= 1 THEN 0.25 ELSE 0 END AS nwt FROM u),
cb AS (SELECT *, mw * ms + nwt * ns - CASE WHEN ic >= 1 THEN 0.05 * greatest(0, 1 - ac) ELSE 0 END AS sc FROM w),
ck AS (SELECT *, (row_number() OVER (PARTITION BY sd ORDER BY round(sc, 12) DESC, key))::INT AS rk, row_number() OVER (PARTITION BY sd ORDER BY round(ms, 12) DESC, key) AS mk FROM cb)"""


def words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.tokens(F.concat_ws(" ", "title", "text")).alias("toks"))


def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between classes of equal token sets, each stood for by its least id."""
    return nine(text.similar_classes(words(spark, d), 0.6)[0])


def near_dup_classes(spark: SparkSession, d: str) -> DataFrame:
    """(id, rep, n_links): every document with its class and the links of the class."""
    links, members = text.similar_classes(words(spark, d), 0.6)
    n = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(n, "rep", "left").select("id", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def event_clusters(spark: SparkSession, d: str) -> DataFrame:
    return text.leaders(*text.similar_classes(words(spark, d), 0.6))


def priority_events(spark: SparkSession, d: str) -> DataFrame:
    """Documents by authority, keywords and freshness (age in fractions of a day), near-copies of better ones in their event at a penalty."""
    docs = table(spark, d, "documents")
    t = F.concat_ws(" ", "title", "text")
    now = F.lit("2026-12-31 00:00:00").cast("timestamp")
    age = F.greatest(F.lit(0.0), F.coalesce((F.unix_micros(now) - F.unix_micros(F.col("published_at").cast("timestamp"))) / 86_400_000_000.0, F.lit(4000.0)))
    base = F.round(text.priority(F.when(F.col("lang") == "en", 1.2).otherwise(1.0), text.keyword_hits(t, LEXICON), 6, events.decay(age, 400.0, 4000.0)), 6)
    pool = docs.select(F.col("doc_id").alias("id"), base.alias("base"), (~text.passes_gate(t, F.col("text"), MARKERS, 40)).alias("bad"), text.tokens(t).alias("toks"))
    return nine(text.prioritised(pool, 0.6, 0.4, 0.05))


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.word_count(F.col("text")).alias("words"), text.passes_gate(F.concat_ws(" ", "title", "text"), F.col("text"), MARKERS, 40).alias("passes"))


def keyword_salience(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.keyword_hits(F.concat_ws(" ", "title", "text"), LEXICON).alias("hits"))


def pool(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    t = F.concat_ws(" ", "title", "text")
    age = F.greatest(F.lit(0.0), F.coalesce(F.datediff(F.to_date(F.lit("2026-12-31")), F.to_date("published_at")).cast("double"), F.lit(4000.0)))
    fresh = events.decay(age, 400.0, 4000.0)
    score = text.priority(F.when(F.col("lang") == "en", 1.2).otherwise(1.0), text.keyword_hits(t, LEXICON), 3, fresh)
    return docs.select("doc_id", F.coalesce("source", F.lit("unmapped")).alias("grp"), F.round(F.when(text.passes_gate(t, F.col("text"), MARKERS, 40), score).otherwise(0.0), 9).alias("score"))


def selection_priority(spark: SparkSession, d: str) -> DataFrame:
    return nine(pool(spark, d))


def quota_topk(spark: SparkSession, d: str) -> DataFrame:
    """Fifty documents: each source's quota of its best, then the best of the rest."""
    p = pool(spark, d).where("score > 0")
    return nine(ranking.within_budget(p, "grp", [F.col("score").desc(), F.col("doc_id")], {"tifaris_wire": 3.0, "pehin_archive": 2.0}, 50).select("doc_id", "grp", "score"))


def rule_classify(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "sample_news_items")
    return n.select("item_id", classify.rule_class(F.concat_ws(" ", "title", "body")).alias("c")).select("item_id", "c.theme", "c.direction", "c.severity", "c.horizon", "c.sector", "c.impact", "c.score")


def theme_explode(spark: SparkSession, d: str) -> DataFrame:
    """Nested annotations to child rows, counted per theme and direction."""
    n = table(spark, d, "sample_news_items").select("item_id", classify.rule_class(F.concat_ws(" ", "title", "body")).alias("c"))
    nested = n.select("item_id", F.array(F.struct("c.theme", "c.direction"), F.struct(F.lit("all").alias("theme"), F.lit("neutral").alias("direction"))).alias("themes"))
    return nested.select("item_id", F.inline("themes")).groupBy("theme", "direction").agg(F.count(F.lit(1)).alias("n"))


def guardrail_anomalies(spark: SparkSession, d: str) -> DataFrame:
    f = feed(spark, d)
    impacts = f.select("news_id", F.col("key").alias("sector_id"), F.when(F.pmod("news_id", F.lit(4)) == 0, "headwind").when(F.pmod("news_id", F.lit(4)) == 1, "tailwind").otherwise("neutral").alias("impact_direction"), "confidence")
    themes = f.select("news_id", F.col("source").alias("theme_id"), "direction")
    want = spark.createDataFrame([("view", 1, 1), ("view", 2, -1), ("click", 3, 1), ("error", 4, -1)], "theme_id string, sector_id int, sign int")
    return nine(classify.guardrail_anomalies(impacts, themes, want, 0.6))


def json_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return loose(table(spark, d, "events").select("event_id", k.alias("k"), F.coalesce(F.get_json_object("props", "$.source_group"), F.lit("unmapped")).alias("source_group")), "k")


def usage_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sums, greatest and nearest-rank 95th value per type."""
    return nine(table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"), quality.nearest_rank("value", 0.95).alias("p95")))


def input_quality_rollup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "sample_news_items").withColumn("day", F.to_date("ingested_at"))
    return quality.rollup(n, ["provider", "source_group", "day"], F.count(F.lit(1)).alias("n"), F.count("title").alias("titled"), quality.duplicates(F.col("title")).alias("repeated"))


def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "sample_news_items").select(F.col("source_group").alias("grp"), F.to_date("ingested_at").alias("day")).where("grp is not null")
    groups = table(spark, d, "news_sources").where("source_group is not null").select(F.col("source_group").alias("grp")).distinct()
    return nine(quality.coverage(items, groups, "2026-06-30", 30))


def concentration(spark: SparkSession, d: str) -> DataFrame:
    return nine(table(spark, d, "news_score_report").where("score is not null and not isnan(score)").groupBy("section").agg(quality.concentration(F.col("score")).alias("share")))


def classification_quality(spark: SparkSession, d: str) -> DataFrame:
    """Success and failure rates of report rows per section, by validity of their confidence."""
    c = F.col("avg_confidence")
    ok = F.coalesce(c.between(0, 1) & ~F.isnan(c), F.lit(False))
    return nine(table(spark, d, "news_score_report").groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("good"), F.count_if(c.isNull()).alias("absent"), F.avg(ok.cast("double")).alias("rate")))


def accumulation_run(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "sample_news_items")
    return n.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("title").alias("titles"), F.countDistinct("source").alias("sources"), F.countDistinct("batch_no").alias("loads"), F.min(F.to_date("ingested_at")).alias("first"), F.max(F.to_date("ingested_at")).alias("last"))


def recurring_ids(spark: SparkSession, d: str) -> DataFrame:
    """The five ids that occur most in the days' top lists."""
    c = events.daily_top(comps(spark, d).withColumn("adjusted", F.round("adjusted", 9))).select(F.to_json(F.transform("top_ids", lambda x: x.cast("string"))).alias("j"))
    return quality.recurring(c, "j", 5)


def replay_days(spark: SparkSession, d: str) -> DataFrame:
    """What each load day would have seen: items so far, and none from later."""
    n = table(spark, d, "sample_news_items").groupBy(F.to_date("ingested_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("day", "n", F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)).alias("so_far"))


def confidence_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Ledger merge: of each item and section the row generated last."""
    w = W.partitionBy("top_news_id", "section").orderBy(F.col("generated_at").desc(), F.col("report_row_id").desc())
    r = table(spark, d, "news_score_report").where("top_news_id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return r.select("report_row_id", "top_news_id", "section")


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_totalprice > 300000").select("o_orderkey", F.lit("X").alias("o_orderstatus"), "o_totalprice")
    return tables.upsert(o, new, ["o_orderkey"])


def upsert_or_key(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "sample_news_items").select("item_id", "title", "provider")
    old, new = n.where("provider <> 'rss'"), n.where("provider = 'rss'")
    return tables.upsert_any(old, new, ["item_id", "title"]).select("item_id", "provider")


def retention_null(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "sample_news_items").select("item_id", "body", F.col("ingested_at").cast("timestamp").alias("ingested_at"))
    return tables.retained(n, "body", "ingested_at", "2025-01-01 00:00:00").select("item_id", F.length("body").cast("double").alias("kept"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "sample_news_items").select("item_id", "source", "title", "body", F.when(F.col("item_id") % 5 != 0, F.col("ingested_at").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, 0, (item_id % 3) * 0.25)")).alias("published_at"))
    return n.select("item_id", landing.content_hash().alias("content_hash"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts set into a page with their marks as entities come out of it again."""
    esc = F.coalesce("text", F.lit(""))
    for k, v in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        esc = F.replace(esc, F.lit(k), F.lit(v))
    page = F.concat(F.lit("<html><head><style>p{}</style></head><body><p>"), F.coalesce("title", F.lit("")), F.lit("</p><script>x()</script><p>"), esc, F.lit("</p></body></html>"))
    return table(spark, d, "documents").where("not coalesce(title, '') like '%<%' and not coalesce(title, '') like '%&%'").select("doc_id", F.md5(landing.plain_text(page)).alias("text"))


NAMES = [
    "news_components", "daily_theme_scores", "daily_sector_scores", "weekly_scores", "top_ids", "weekly_top_ids", "secular_scores", "secular_periods", "combined_diagnostics", "rank_changes", "near_dup_pairs",
    "near_dup_classes", "event_clusters", "priority_events", "quality_gate", "keyword_salience", "selection_priority", "quota_topk", "rule_classify", "theme_explode", "guardrail_anomalies", "json_extract", "usage_stats",
    "input_quality_rollup", "source_coverage", "concentration", "classification_quality", "accumulation_run", "recurring_ids", "replay_days", "confidence_ledger", "upsert_latest",
    "upsert_or_key", "retention_null", "content_hash", "html_text",
]
QUERIES = {n: globals()[n] for n in NAMES}

TXT = "concat_ws(' ', title, text)"
TOKS = f"list_distinct(list_filter(regexp_split_to_array(lower({TXT}), '[\\s\\x{{85}}\\p{{Z}}]+'), lambda t: length(t) > 1))"
WORDS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x{85}\\p{Z}]+'), lambda t: t <> ''))"
GATE = f"NOT ({' OR '.join(f'contains(lower({TXT}), {chr(39)}{m}{chr(39)})' for m in MARKERS)} OR {WORDS} < 40)"
HITS = " + ".join(f"contains(lower({TXT}), '{k}')::INT" for k in LEXICON)
POOL = f"pool AS (SELECT doc_id, coalesce(source, 'unmapped') AS grp, round(CASE WHEN {GATE} THEN (CASE WHEN lang = 'en' THEN 1.2 ELSE 1.0 END)::DOUBLE * (1 + least({HITS}, 3)) * pow(0.5, greatest(0, coalesce(date_diff('day', published_at::DATE, DATE '2026-12-31'), 4000)) / 400.0) ELSE 0 END, 9) AS score FROM documents)"
SIMILAR = f"""d AS (SELECT doc_id AS id, {TOKS} AS tk FROM documents), c AS (SELECT list_sort(tk) AS tk, min(id) AS rep FROM d WHERE len(tk) > 0 GROUP BY 1), x AS (SELECT rep, len(tk) AS n, unnest(tk) AS t FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.t = b.t AND a.rep < b.rep GROUP BY 1, 2), l AS (SELECT a, b, k / (na + nb - k) AS s FROM p WHERE k / (na + nb - k) >= 0.6 - 1e-12),
mem AS (SELECT d.id, coalesce(c.rep, d.id) AS rep FROM d LEFT JOIN c ON list_sort(d.tk) = c.tk)"""
TOPS = "tp AS (SELECT sd, key, i, row_number() OVER (PARTITION BY sd, key ORDER BY abs(round(a, 9)) DESC, i) AS r FROM cp)"
RULE = "CASE WHEN contains(t, 'oil') OR contains(t, 'energy') THEN 1 WHEN contains(t, 'fed') OR contains(t, 'rate') OR contains(t, 'central bank') THEN 2 ELSE 3 END"
RULED = f"r AS (SELECT item_id, {RULE} AS k FROM (SELECT item_id, lower(concat_ws(' ', title, body)) AS t FROM sample_news_items))"
SEC = "sl AS (SELECT *, greatest(-0.2, least(0.2, raw * conf * pow(0.5, date_diff('day', d, DATE '2024-01-31') / 45.0))) AS a, date_diff('day', d, DATE '2024-01-31') AS age FROM nw WHERE date_diff('day', d, DATE '2024-01-31') BETWEEN 0 AND 180)"
# greedy leaders over an order of items (o: k, id, tk): each step joins the earliest leader it is linked to, else leads
LEAD = """x AS (SELECT k, len(tk) AS n, unnest(tk) AS t FROM o), pr AS MATERIALIZED (SELECT a.k AS a, b.k AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.k < b.k GROUP BY 1, 2),
nb AS MATERIALIZED (SELECT b, list(a) AS before FROM pr WHERE c / (na + nb - c) >= 0.6 - 1e-12 GROUP BY 1),
step AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS ls, 0::BIGINT AS lead UNION ALL
 SELECT k + 1, CASE WHEN m IS NULL THEN list_append(ls, k + 1) ELSE ls END, coalesce(m, k + 1) FROM (SELECT step.k, ls, list_min(list_filter(coalesce(before, []), lambda y: list_contains(ls, y))) AS m FROM step LEFT JOIN nb ON nb.b = step.k + 1 WHERE step.k < (SELECT count(*) FROM o))),
ev AS (SELECT o.id, l.id AS event_id FROM step JOIN o ON o.k = step.k JOIN o l ON l.k = step.lead)"""
SQL = {
    "event_clusters": f"WITH RECURSIVE o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id AS id, {TOKS} AS tk FROM documents), {LEAD} SELECT id, event_id FROM ev",
    "priority_events": f"""WITH RECURSIVE b AS (SELECT doc_id AS id, {TOKS} AS tk, NOT ({GATE}) AS bad, round((CASE WHEN lang = 'en' THEN 1.2 ELSE 1.0 END)::DOUBLE * (1 + least({HITS}, 6)) * pow(0.5, greatest(0, coalesce((epoch_us(TIMESTAMP '2026-12-31') - epoch_us(published_at)) / 86400000000.0, 4000)) / 400.0), 6) AS base FROM documents),
        o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY base DESC, id) AS k, id, tk, base FROM b WHERE NOT bad), {LEAD}
        SELECT b.id, coalesce(event_id, b.id) AS event_id, CASE WHEN event_id <> b.id THEN 0.4 ELSE 1.0 END::DOUBLE AS novelty, round(CASE WHEN bad THEN 0 WHEN event_id <> b.id THEN base * 0.4 ELSE base END, 9)::DOUBLE AS score, NOT bad AND base * CASE WHEN event_id <> b.id THEN 0.4 ELSE 1.0 END >= 0.05 AS eligible FROM b LEFT JOIN ev USING (id)""",
    "news_components": f"WITH {LIVE} SELECT i AS news_id, key, sd AS score_date, round(raw, 9) AS raw, round(pow(0.5, date_diff('day', d, sd) / 7.0), 9) AS freshness, round(a, 9) AS adjusted FROM cp",
    "daily_theme_scores": f"WITH {DAY}, k1 AS (SELECT sd, key, greatest(-0.3, least(0.3, sum(a))) AS s FROM cp GROUP BY sd, key, src), k2 AS (SELECT sd, key, sum(s) AS t FROM k1 GROUP BY 1, 2) SELECT sd AS score_date, key, round(raw_score, 9) AS raw_score, round(t, 9) AS adjusted_score, item_count, round(ac, 9) AS avg_confidence, round(asv, 9) AS avg_severity FROM dn JOIN k2 USING (sd, key)",
    "daily_sector_scores": f"WITH {DAY} SELECT sd AS score_date, key, {CELLS}, pos AS positive_count, neg AS negative_count, neu AS neutral_count, round(ac, 9) AS avg_confidence FROM dd",
    "weekly_scores": f"WITH {DAY} SELECT date_trunc('week', sd)::DATE AS week_start, key, round(avg(raw_score), 9) AS raw_score, round(avg(adj), 9) AS adjusted_score, sum(item_count)::BIGINT AS item_count, sum(pos)::BIGINT AS positive_count FROM dd GROUP BY 1, 2",
    "top_ids": f"WITH {LIVE}, {TOPS} SELECT sd AS score_date, key, string_agg(i::VARCHAR, ',' ORDER BY r) AS top_ids FROM tp WHERE r <= 5 GROUP BY 1, 2",
    "weekly_top_ids": f"WITH {LIVE}, {TOPS}, f AS (SELECT date_trunc('week', sd)::DATE AS w, key, i, min(row(sd, r)) AS o FROM tp WHERE r <= 5 GROUP BY 1, 2, 3), g AS (SELECT *, row_number() OVER (PARTITION BY w, key ORDER BY o) AS k FROM f) SELECT w AS week_start, key, string_agg(i::VARCHAR, ',' ORDER BY k) AS top_ids FROM g WHERE k <= 5 GROUP BY 1, 2",
    "secular_scores": f"WITH {FEED}, {SEC}, k1 AS (SELECT key, greatest(-3, least(3, sum(a))) AS s FROM sl GROUP BY key, date_trunc('month', d), src), k2 AS (SELECT key, sum(s) AS score FROM k1 GROUP BY 1) SELECT key, round(any_value(score), 9) AS score, round(sum(raw), 9) AS raw_score, round(coalesce(sum(a) FILTER (age < 10), 0) - coalesce(sum(a) FILTER (age BETWEEN 10 AND 19), 0), 9) AS trend, count(DISTINCT i) AS item_count, round(avg(conf), 9) AS avg_confidence FROM sl JOIN k2 USING (key) GROUP BY key",
    "secular_periods": f"WITH {FEED}, {SEC}, k1 AS (SELECT key, date_trunc('quarter', d)::DATE AS q, greatest(-3, least(3, sum(a))) AS s FROM sl GROUP BY key, q, date_trunc('month', d), src), k2 AS (SELECT key, q, sum(s) AS s FROM k1 GROUP BY 1, 2) SELECT k2.key, q AS period_start, round(s, 9) AS score, (SELECT count(DISTINCT i) FROM sl WHERE sl.key = k2.key AND date_trunc('quarter', d)::DATE = q) AS item_count FROM k2",
    "combined_diagnostics": f"WITH {COMB} SELECT sd AS diagnostic_date, key, round(ms, 9) AS macro_score, round(ns, 9) AS news_score, mw::DOUBLE AS macro_weight, nwt::DOUBLE AS news_weight, ic AS news_item_count, round(ac, 9) AS news_confidence, round(sc, 9) AS combined_score, rk AS rank FROM ck",
    "rank_changes": f"WITH {COMB} SELECT sd AS diagnostic_date, key, (mk - rk)::INT AS change FROM ck",
    "near_dup_pairs": f"WITH {SIMILAR} SELECT a, b, round(s, 9) AS similarity FROM l",
    "near_dup_classes": f"WITH {SIMILAR}, n AS (SELECT r, count(*) AS k FROM (SELECT a AS r FROM l UNION ALL SELECT b FROM l) GROUP BY 1) SELECT id, rep, coalesce(k, 0) AS n_links FROM mem LEFT JOIN n ON r = rep",
    "quality_gate": f"SELECT doc_id, {WORDS}::INT AS words, {GATE} AS passes FROM documents",
    "keyword_salience": f"SELECT doc_id, ({HITS})::INT AS hits FROM documents",
    "selection_priority": f"WITH {POOL} SELECT doc_id, grp, round(score, 9) AS score FROM pool",
    "quota_topk": f"""WITH {POOL}, e AS (SELECT * FROM pool WHERE score > 0), g AS (SELECT grp, CASE grp WHEN 'tifaris_wire' THEN 3.0 WHEN 'pehin_archive' THEN 2.0 ELSE 1.0 END AS w FROM (SELECT DISTINCT grp FROM e)), q AS (SELECT grp, floor(50 * w / sum(w) OVER ()) AS q FROM g),
        r AS (SELECT e.*, row_number() OVER (PARTITION BY grp ORDER BY score DESC, doc_id) <= q AS head FROM e JOIN q USING (grp)), k AS (SELECT *, row_number() OVER (ORDER BY head DESC, score DESC, doc_id) AS k FROM r) SELECT doc_id, grp, round(score, 9) AS score FROM k WHERE k <= 50""",
    "rule_classify": f"WITH {RULED} SELECT item_id, CASE k WHEN 1 THEN 'commodity_pressure' WHEN 2 THEN 'monetary_tightening' ELSE 'growth_slowdown' END AS theme, CASE k WHEN 3 THEN 'unclear' ELSE 'positive' END AS direction, CASE k WHEN 1 THEN 0.6 WHEN 2 THEN 0.5 ELSE 0.2 END::DOUBLE AS severity, CASE k WHEN 3 THEN 'unclear' ELSE 'short_term' END AS horizon, CASE k WHEN 1 THEN 'energy' WHEN 2 THEN 'real_estate' END AS sector, CASE k WHEN 1 THEN 'tailwind' WHEN 2 THEN 'headwind' END AS impact, CASE k WHEN 1 THEN 0.5 WHEN 2 THEN -0.4 END::DOUBLE AS score FROM r",
    "theme_explode": f"WITH {RULED} SELECT CASE k WHEN 1 THEN 'commodity_pressure' WHEN 2 THEN 'monetary_tightening' ELSE 'growth_slowdown' END AS theme, CASE k WHEN 3 THEN 'unclear' ELSE 'positive' END AS direction, count(*) AS n FROM r GROUP BY 1, 2 UNION ALL SELECT 'all', 'neutral', count(*) FROM r",
    "guardrail_anomalies": f"WITH {FEED}, x(t, s, g) AS (VALUES ('view', 1, 1), ('view', 2, -1), ('click', 3, 1), ('error', 4, -1)), j AS (SELECT i, src, key, conf, sg * g AS want, CASE i % 4 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS got FROM nw JOIN x ON src = t AND key = s) SELECT i AS news_id, src AS theme_id, key AS sector_id, CASE WHEN want > 0 THEN 'tailwind' ELSE 'headwind' END AS expected, CASE WHEN got > 0 THEN 'tailwind' ELSE 'headwind' END AS observed, round(conf, 9) AS confidence FROM j WHERE want <> 0 AND got <> 0 AND want <> got AND conf >= 0.6",
    "json_extract": "SELECT event_id, (props->>'$.k')::DOUBLE AS k, coalesce(props->>'$.source_group', 'unmapped') AS source_group FROM events",
    "usage_stats": "SELECT event_type, count(*) AS n, round(sum(value), 9) AS total, round(max(value), 9) AS most, round(quantile_disc(value, 0.95), 9) AS p95 FROM events GROUP BY 1",
    "input_quality_rollup": "WITH n AS (SELECT *, ingested_at::DATE AS day FROM sample_news_items), g AS (SELECT provider, source_group, day, grouping(provider, source_group, day) AS g, count(*) AS n, count(title) AS titled, count(title) - count(DISTINCT title) AS repeated FROM n GROUP BY GROUPING SETS ((provider), (source_group), (day), ())) SELECT CASE g WHEN 3 THEN 'provider' WHEN 5 THEN 'source_group' WHEN 6 THEN 'day' ELSE 'total' END AS dimension, CASE g WHEN 3 THEN provider WHEN 5 THEN source_group WHEN 6 THEN day::VARCHAR END AS value, n, titled, repeated FROM g",
    "source_coverage": "WITH i AS (SELECT source_group AS grp, count(*) AS n, max(ingested_at::DATE) AS latest FROM sample_news_items WHERE source_group IS NOT NULL GROUP BY 1), g AS (SELECT DISTINCT source_group AS grp FROM news_sources WHERE source_group IS NOT NULL) SELECT grp, coalesce(n, 0) AS n, round(coalesce(n / (SELECT sum(n) FROM i), 0), 9) AS share, latest, coalesce(date_diff('day', latest, DATE '2026-06-30') > 30, true) AS stale, n IS NULL AS missing FROM g LEFT JOIN i USING (grp)",
    "concentration": "SELECT section, round(max(abs(score)) / sum(abs(score)), 9) AS share FROM news_score_report WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1",
    "classification_quality": "WITH r AS (SELECT section, avg_confidence AS c, coalesce(avg_confidence BETWEEN 0 AND 1 AND NOT isnan(avg_confidence), false) AS ok FROM news_score_report) SELECT section, count(*) AS n, count(*) FILTER (ok) AS good, count(*) FILTER (c IS NULL) AS absent, round(avg(ok::INT), 9) AS rate FROM r GROUP BY 1",
    "accumulation_run": "SELECT count(*) AS n, count(DISTINCT title) AS titles, count(DISTINCT source) AS sources, count(DISTINCT batch_no) AS loads, min(ingested_at::DATE) AS first, max(ingested_at::DATE) AS last FROM sample_news_items",
    "recurring_ids": f"WITH {LIVE}, {TOPS} SELECT i::VARCHAR AS id, count(*) AS n FROM tp WHERE r <= 5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "replay_days": "WITH n AS (SELECT ingested_at::DATE AS day, count(*) AS n FROM sample_news_items GROUP BY 1) SELECT day, n, (sum(n) OVER (ORDER BY day))::BIGINT AS so_far FROM n",
    "confidence_ledger": "SELECT report_row_id, top_news_id, section FROM news_score_report WHERE top_news_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY top_news_id, section ORDER BY generated_at DESC, report_row_id DESC) = 1",
    "upsert_latest": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders",
    "upsert_or_key": "WITH n AS (SELECT * FROM sample_news_items WHERE provider = 'rss') SELECT item_id, provider FROM n UNION ALL SELECT item_id, provider FROM sample_news_items o WHERE provider <> 'rss' AND NOT EXISTS (SELECT 1 FROM n WHERE n.item_id = o.item_id) AND NOT EXISTS (SELECT 1 FROM n WHERE n.title = o.title)",
    "retention_null": "SELECT item_id, CASE WHEN ingested_at < TIMESTAMP '2025-01-01' THEN NULL ELSE length(body)::DOUBLE END AS kept FROM sample_news_items",
    "content_hash": "WITH n AS (SELECT *, CASE WHEN item_id % 5 <> 0 THEN ingested_at + to_milliseconds((item_id % 3) * 250) END AS t FROM sample_news_items) SELECT item_id, sha256(lower(trim(coalesce(source, ''))) || chr(10) || coalesce(strftime(t, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(t) % 1000000 = 0 THEN '' ELSE strftime(t, '.%f') END || '+00:00', '') || chr(10) || trim(coalesce(title, '')) || chr(10) || trim(coalesce(body, ''))) AS content_hash FROM n",
}
