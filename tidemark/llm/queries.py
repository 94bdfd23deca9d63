"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import residue
from tidemark.llm.capping import CapState, latest_quality, load_caps
from tidemark.llm.encoding import encode_documents, token_counts
from tidemark.llm.history import History
from tidemark.llm.mixture import mix
from tidemark.llm.neardup import Groups, Plan, classes, expanded, grouped, near_duplicates
from tidemark.operators.outlets import with_outlet
from tidemark.session import durable, release, table

#: Rows of a load per record that an outlet may keep.
CAP_SHARE = 25
#: Providers that deliver first; a load's other records come with a second delivery.
FIRST_PROVIDERS = ["gdelt", "finnhub"]


def capped(spark: SparkSession, sf_dir: str) -> CapState:
    news = table(spark, sf_dir, "sample_news_items").select("item_id", "batch_no", "source", "source_url", "provider")
    caps = durable(load_caps(news, "batch_no", CAP_SHARE), "caps")
    rated = with_outlet(news, table(spark, sf_dir, "news_sources")).join(latest_quality(table(spark, sf_dir, "news_score_report")).withColumnRenamed("record_id", "item_id"), "item_id", "left")
    feed = durable(rated.where("_outlet is not null").select(F.col("batch_no").alias("load"), F.col("_outlet").alias("contributor"), F.col("item_id").alias("record_id"), "quality", F.coalesce(F.col("provider").isin(FIRST_PROVIDERS), F.lit(False)).alias("first")), "feed")
    state = CapState(spark)
    for part in ("first", "not first"):
        state.merge(feed.where(part).drop("first"), caps)
    release(feed, caps)
    return state


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id): records to drop, from the log of displaced and rejected ones."""
    return capped(spark, sf_dir).log().select(F.col("record_id").alias("item_id"))


def p1_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(load, contributor, kept_n, cut_q, cut_id): the state's cutoffs after all loads."""
    return capped(spark, sf_dir).cutoffs()


#: Shares of the loads after which a delivery ends: the first makes the history, the others are checked against it.
P3_DELIVERIES = [0.5, 0.75]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id): records that bring an article already held, found load after load by one state."""
    news = table(spark, sf_dir, "sample_news_items").select(F.col("item_id").alias("id"), F.col("batch_no").cast("long").alias("batch"), F.col("source_url").alias("url"), "title")
    ends = news.agg(F.percentile_approx("batch", P3_DELIVERIES)).first()[0] or [0] * len(P3_DELIVERIES)
    history, b, found = History(spark), F.coalesce("batch", F.lit(ends[0])), []
    for low, high in zip([None, *ends], [*ends, None]):
        part = news if low is None else news.where(b > low)
        found.append(history.probe_and_append(part if high is None else part.where(b <= high)))
    return reduce(DataFrame.unionByName, found).select(F.col("id").alias("item_id"))


#: Three words, half in common, fifty words at least; finds a pair at the threshold with probability 0.990, at 0.55 with 0.999.
P5_PLAN = Plan(words=3, similarity=0.5, least_words=50, bands=72, rows=4)


def news_groups(spark: SparkSession, sf_dir: str) -> Groups:
    news = table(spark, sf_dir, "sample_news_items")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    return near_duplicates(news.select(F.col("item_id").alias("id"), text.alias("text")), P5_PLAN)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id_a, item_id_b): pairs of records that share at least half of their three-word runs."""
    return expanded(news_groups(spark, sf_dir)).select(F.col("a").alias("item_id_a"), F.col("b").alias("item_id_b"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, rep, n_links): one row per record of 50 words or more."""
    return classes(news_groups(spark, sf_dir)).select(F.col("id").alias("item_id"), "rep", "n_links")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, group_id, n): the records that belong together, directly or through others."""
    return grouped(news_groups(spark, sf_dir)).withColumnRenamed("id", "item_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encode_documents(table(spark, sf_dir, "documents"))


def mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = durable(token_counts(table(spark, sf_dir, "documents"), "source"), "sized")
    return mix(sized, table(spark, sf_dir, "mixture_targets"))


def p9_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): the drawn documents."""
    return mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached, per listed source."""
    return mixture(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): documents to keep out."""
    docs = table(spark, sf_dir, "documents")
    return residue.residue(docs, residue.fit(docs)[0]).select("doc_id")


def p10_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(measure, value): agreement with the weak labels on sources left out of the fit, and what is found of families of fields it never saw."""
    report = residue.fit(table(spark, sf_dir, "documents"), unseen=residue.UNSEEN)[1]
    return spark.createDataFrame(sorted(report.items()), "measure string, value double")


P5_SQL = r"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '[\p{L}\p{N}]+') AS ws FROM sample_news_items),
s AS (SELECT DISTINCT item_id, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) AS sh FROM w WHERE len(ws) >= 50),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT a AS item_id_a, b AS item_id_b FROM p JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b WHERE 2 * k >= x.n + y.n - k
"""

P1_SQL = r"""
WITH keys AS (
  SELECT regexp_replace(lower(k), '[^a-z0-9]', '', 'g') AS key, min(source_id) AS sid
  FROM (SELECT source_id, unnest(list_concat([source, domain], coalesce(aliases, []))) AS k FROM news_sources) GROUP BY 1),
n AS (
  SELECT item_id, batch_no, regexp_replace(CASE WHEN source IS NOT NULL AND regexp_replace(source, '[^A-Za-z0-9]', '', 'g') <> '' THEN regexp_replace(lower(trim(source)), '^(www|m|amp)\.', '')
    ELSE regexp_replace(regexp_extract(lower(trim(source_url)), '^https?://([^/:?#]+)', 1), '^(www|m|amp)\.', '') END, '[^a-z0-9]', '', 'g') AS key
  FROM sample_news_items),
q AS (SELECT top_news_id, avg_confidence FROM news_score_report WHERE avg_confidence BETWEEN 0 AND 1 AND NOT isnan(avg_confidence)
      QUALIFY row_number() OVER (PARTITION BY top_news_id ORDER BY generated_at DESC, report_row_id DESC) = 1),
caps AS (SELECT batch_no, greatest(count(*) // 25, 1) AS cap FROM sample_news_items GROUP BY 1),
r AS (SELECT n.item_id, cap, row_number() OVER (PARTITION BY n.batch_no, sid ORDER BY avg_confidence DESC NULLS LAST, n.item_id) AS k
      FROM n JOIN keys USING (key) JOIN caps USING (batch_no) LEFT JOIN q ON q.top_news_id = n.item_id)
SELECT item_id FROM r WHERE k > cap
"""

P1_STATE_SQL = P1_SQL[: P1_SQL.index("SELECT item_id FROM r")].replace("SELECT n.item_id, cap,", "SELECT n.item_id, n.batch_no, sid, avg_confidence, cap,") + """
SELECT batch_no AS load, sid::BIGINT AS contributor, count(*) AS kept_n, first(avg_confidence ORDER BY k DESC) AS cut_q, first(item_id ORDER BY k DESC) AS cut_id FROM r WHERE k <= cap GROUP BY 1, 2
"""

# pairs of copies and near-copies, then the least record each can reach
P5_GROUPS_SQL = P5_SQL.replace("WITH w AS", "WITH RECURSIVE w AS").replace("SELECT a AS item_id_a, b AS item_id_b", ", l AS (SELECT a, b") + """),
e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l), reach AS (SELECT DISTINCT x, x AS y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
g AS (SELECT x AS item_id, min(y) AS group_id FROM reach GROUP BY 1)
SELECT item_id, group_id, count(*) OVER (PARTITION BY group_id) AS n FROM g
"""

QUERIES = {"p1_found": p1_found, "p1_state": p1_state, "p3_found": p3_found, "p5_found": p5_found, "p5_classes": p5_classes, "p5_groups": p5_groups, "p8_ids": p8_ids, "p9_draws": p9_draws, "p9_shares": p9_shares, "p10_found": p10_found, "p10_validation": p10_validation}
SQL = {"p1_found": P1_SQL, "p1_state": P1_STATE_SQL, "p5_found": P5_SQL, "p5_groups": P5_GROUPS_SQL}
