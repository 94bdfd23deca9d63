"""Series to ranked states over the test tables, with the SQL each is compared with."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import asof, ranking, scoring, series, state
from tidemark.params import POLARITIES, Feature, Source, Weighted, check
from tidemark.session import durable, shared, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SOURCES = [Source(p, "monthly", publication_lag_days=20) for p in PRIORITIES]
FEATURES = [Feature(f"f{k}", p, "yoy_pct_change" if k % 2 else "diff_3m", "rolling_z_3y", 12) for k, p in enumerate(PRIORITIES, 1)]
DIMENSIONS = [
    Weighted("growth", "f1", 0.5, "positive", 2, 0.6, 1), Weighted("growth", "f2", 0.3, "positive", 2, 0.6, 2), Weighted("growth", "f3", 0.2, "negative", 2, 0.6, 3),
    Weighted("pressure", "f3", 0.4, "positive", 2, 0.6, 1), Weighted("pressure", "f4", 0.35, "negative", 2, 0.6, 2), Weighted("pressure", "f5", 0.25, "positive", 2, 0.6, 3),
]
REGIMES = [
    Weighted("boom", "growth", 0.7, "positive", 1, 0.3, 1), Weighted("boom", "pressure", 0.3, "penalize_positive_only", 1, 0.3, 2), Weighted("heat", "growth", 0.4, "positive_only", 1, 0.3, 1),
    Weighted("heat", "pressure", 0.6, "positive", 1, 0.3, 2), Weighted("slump", "growth", 0.8, "negative", 1, 0.3, 1), Weighted("slump", "pressure", 0.2, "reward_near_zero", 1, 0.3, 2),
]
ORDER = {"boom": 1, "heat": 2, "slump": 3}
START, END, MAX_LAG = "1995-06-15", "2001-08-20", {"monthly": 75}
THETA, MONTHS, BELOW = 0.02, 2, 0.15
ENTITIES = [("alpha", 0.6, 0.4, -0.2, 0.5), ("beta", -0.3, 0.2, 0.7, -0.4), ("gamma", 0.1, -0.5, 0.3, 0.9)]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places: sums of other order may differ in the last."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def loose(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that may be null as doubles, which both sides of a comparison show alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def obs_monthly(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.trunc("o_orderdate", "month").alias("date")).agg(F.sum("o_totalprice").alias("value"))
    return o.withColumn("fetched_at", F.lit(None).cast("timestamp"))


def obs_daily(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")
    j = o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("series_id")), "o_custkey")
    return j.groupBy("series_id", "date").agg(F.sum("o_totalprice").alias("value")).withColumn("fetched_at", F.lit(None).cast("timestamp"))


@dataclass(frozen=True)
class Chain:
    features: DataFrame
    seen: DataFrame
    dim_contrib: DataFrame
    dims: DataFrame
    reg_contrib: DataFrame
    regimes: DataFrame
    health: DataFrame


@shared
def chain(spark: SparkSession, d: str) -> Chain:
    check(SOURCES, FEATURES, DIMENSIONS)
    # what several consumers read is written once; each is bounded by the calendar and the configuration
    f = durable(series.features(obs_monthly(spark, d), SOURCES, FEATURES), "features")
    seen = durable(asof.asof_features(asof.month_spine(spark, START, END), f, FEATURES, SOURCES, MAX_LAG), "seen")
    dc = scoring.contributions(seen.select(F.col("feature_id").alias("input_id"), F.col("evaluation_date").alias("date"), F.col("normalized_value").alias("value"), "valid", "reason"), DIMENSIONS, "missing_feature")
    dims = durable(scoring.rolled(dc, "features"), "dimensions")
    rc = scoring.contributions(dims.select(F.col("output_id").alias("input_id"), "date", F.col("score").alias("value"), "valid", "reason"), REGIMES, "missing_dimension")
    reg = durable(scoring.probabilities(scoring.rolled(rc, "dimensions"), ORDER), "states")
    return Chain(f, seen, dc, dims, rc, reg, durable(scoring.state_health(reg), "health"))


def latest_states(spark: SparkSession, d: str) -> DataFrame:
    """Ranked states of the last date that has any: the whole way from orders to probabilities."""
    r = chain(spark, d).regimes.where("probability is not null")
    last = r.withColumn("_d", F.max("date").over(W.partitionBy())).where("date = _d")
    return rounded(last.select("date", "output_id", "score", "probability", "rank"))


def scan_projection(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49))
    return li.select("l_orderkey", "l_linenumber", "l_extendedprice")


def vintage_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return series.latest_vintage(table(spark, d, "raw_observations").select("series_id", "date", "value", "fetched_at")).select("series_id", "date", series.clean(F.col("value")).alias("value"))


def feature_diff_yoy(spark: SparkSession, d: str) -> DataFrame:
    f = [Feature(f"{t}|{p}", p, t) for p in PRIORITIES for t in ("level", "diff_3m", "diff_6m", "diff_12m", "yoy_pct_change")]
    return rounded(series.features(obs_monthly(spark, d), SOURCES, f).select("feature_id", "date", "transformed_value", "reason"))


def rolling_zscore(spark: SparkSession, d: str) -> DataFrame:
    f = [Feature(p, p, "level", "rolling_z_3y", 24) for p in PRIORITIES]
    return rounded(series.features(obs_monthly(spark, d), SOURCES, f).select("feature_id", "date", "normalized_value", "window_start", "valid"))


def expanding_zscore(spark: SparkSession, d: str) -> DataFrame:
    seg = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    f = [Feature(p, p, "level", "expanding_z", 30) for p in seg]
    return rounded(series.features(obs_daily(spark, d), [Source(p, "daily") for p in seg], f).select("feature_id", "date", "normalized_value", "reason"))


def feature_health(spark: SparkSession, d: str) -> DataFrame:
    f = [Feature(p, p, "yoy_pct_change", "rolling_z_3y", 24) for p in PRIORITIES] + [Feature("off", PRIORITIES[0], enabled=False), Feature("none", "absent")]
    return series.feature_health(series.features(obs_monthly(spark, d), [*SOURCES, Source("absent", "monthly")], f))


def source_health(spark: SparkSession, d: str) -> DataFrame:
    s = [Source(p, "monthly", stale_after_days=20) for p in PRIORITIES] + [Source("absent", "monthly"), Source("off", "monthly", enabled=False, reason_disabled="retired")]
    return loose(series.source_health(obs_monthly(spark, d), s, "2001-09-01"), "days_since")


def month_spine(spark: SparkSession, d: str) -> DataFrame:
    return asof.month_spine(spark, START, END).withColumn("at", F.lit("start")).unionByName(asof.month_spine(spark, START, END, "ME").withColumn("at", F.lit("end")))


def asof_reasons(spark: SparkSession, d: str) -> DataFrame:
    return loose(rounded(chain(spark, d).seen.select("evaluation_date", "feature_id", "source_observation_date", "normalized_value", "lag_days", "reason")), "lag_days")


def dimension_contributions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(chain(spark, d).dim_contrib.select("output_id", "input_id", "date", "normalized_weight", "signed_value", "contribution", "valid"))


def dimension_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(chain(spark, d).dims.select("output_id", "date", "score", "valid_count", "coverage_ratio", "reason"))


def dimension_health(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rollup_health(chain(spark, d).dim_contrib)


def regime_scores(spark: SparkSession, d: str) -> DataFrame:
    return loose(rounded(chain(spark, d).regimes.select("output_id", "date", "score", "probability", "rank", "valid")), "rank")


def regime_health(spark: SparkSession, d: str) -> DataFrame:
    return rounded(chain(spark, d).health)


def top2_gap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.top2_gap(chain(spark, d).regimes))


def polarity_matrix(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"))
    return rounded(x.select("c_custkey", *[scoring.polarity(F.lit(p), F.col("x")).alias(p) for p in POLARITIES]))


@shared
def timeline(spark: SparkSession, d: str) -> DataFrame:
    c = chain(spark, d)
    held = state.held_states(state.leaders(c.regimes, c.health), THETA, MONTHS, BELOW)
    prob = c.regimes.select("date", F.col("output_id").alias("reported_state"), F.col("probability").alias("reported_probability"))
    return durable(held.join(prob, ["date", "reported_state"], "left"), "timeline")


def regime_timeline_top2(spark: SparkSession, d: str) -> DataFrame:
    c = chain(spark, d)
    return rounded(state.leaders(c.regimes, c.health))


def transition_filter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(timeline(spark, d).select("date", "raw_state", "reported_state", "filter_reason", "reported_probability"))


def regime_transitions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(state.transitions(timeline(spark, d)))


def regime_runlength(spark: SparkSession, d: str) -> DataFrame:
    return state.runs(timeline(spark, d).where("valid").withColumn("k", F.lit("all")), ["k"], "date", "reported_state").drop("k")


def regime_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(state.summary(timeline(spark, d)).drop("distribution"))


def stacked_bands(spark: SparkSession, d: str) -> DataFrame:
    """Running total of the probabilities of a date in the order of configuration."""
    o = reduce(lambda a, kv: F.when(F.col("output_id") == kv[0], kv[1]).otherwise(a), ORDER.items(), F.lit(99))
    w = W.partitionBy("date").orderBy(o).rowsBetween(W.unboundedPreceding, 0)
    return rounded(chain(spark, d).regimes.where("probability is not null").select("date", "output_id", F.sum("probability").over(w).alias("upper")))


@shared
def sectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = chain(spark, d)
    m = [(e, "regime_prior", r, w) for e, b, h, _, _ in ENTITIES for r, w in (("boom", b), ("heat", h))] + [(e, "dimension_exposure", x, w) for e, _, _, g, p in ENTITIES for x, w in (("growth", g), ("pressure", p))]
    matrix = spark.createDataFrame(m, "entity_id string, component_type string, component_id string, weight double")
    v = c.regimes.where("probability is not null").select("date", F.lit("regime_prior").alias("component_type"), F.col("output_id").alias("component_id"), F.col("probability").alias("input_value"))
    v = v.unionByName(c.dims.where("valid").select("date", F.lit("dimension_exposure").alias("component_type"), F.col("output_id").alias("component_id"), F.col("score").alias("input_value")))
    comps = scoring.sector_components(c.health.select("date"), matrix, v)
    comps = durable(comps, "components")
    return comps, durable(scoring.sector_scores(comps, c.health.select("date", F.col("confidence").alias("macro_confidence"))), "sectors")


def sector_components(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sectors(spark, d)[0])


def sector_scores(spark: SparkSession, d: str) -> DataFrame:
    return loose(rounded(sectors(spark, d)[1].select("entity_id", "date", "raw_score", "adjusted_score", "rank", "missing", "valid")), "rank")


@shared
def prices(spark: SparkSession, d: str) -> DataFrame:
    """(ticker, date, close): average price of each brand and of all, both from one scan. One row per ticker and day."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.to_date("l_shipdate").alias("date"), "l_extendedprice")
    j = li.join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("ticker")), "p_partkey", "left")
    both = j.groupingSets([["ticker", "date"], ["date"]], "ticker", "date").agg(F.avg("l_extendedprice").alias("close"), F.grouping("ticker").alias("_all"))
    return durable(both.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("ticker")).alias("ticker"), "date", "close").where("ticker is not null"), "prices")


@shared
def returns(spark: SparkSession, d: str) -> DataFrame:
    p = prices(spark, d)
    brands = p.where("ticker <> 'ALL'").select(F.col("ticker").alias("entity_id")).distinct().withColumn("ticker", F.col("entity_id"))
    dates = asof.month_spine(spark, "1996-01-01", "2001-12-01").select(F.col("evaluation_date").alias("score_date"))
    # a score of each brand and date that both sides can compute alike
    s = brands.crossJoin(F.broadcast(dates)).withColumn("score", ((F.length("entity_id") * 7 + F.ascii(F.substring("entity_id", -1, 1)) * 13 + F.ascii(F.substring("entity_id", -2, 1)) * 5 + F.month("score_date") * 11) % 17).cast("double"))
    return durable(asof.forward_returns(s, p, "ALL"), "returns")


def forward_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(returns(spark, d).select("entity_id", "score_date", "forward_1m_return", "relative_forward_1m_return", "forward_3m_return", "relative_forward_3m_return", "reason"))


def spearman_ic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.spearman(returns(spark, d).withColumn("rel", F.round("relative_forward_1m_return", 9)), ["score_date"], "score", "rel"))


def quintile_spread(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.quintiles(returns(spark, d).where("relative_forward_1m_return is not null"), ["score_date"], "score", "relative_forward_1m_return", "entity_id"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.round(F.col("o_totalprice") / 1000, 0).alias("score"), (F.col("o_orderstatus") == "F").alias("label"))


def auroc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.auroc(labelled(spark, d), "score", "label"))


def threshold_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.threshold_rates(labelled(spark, d), "score", "label", [50.0, 150.0, 300.0]))


def lead_lag(spark: SparkSession, d: str) -> DataFrame:
    m = chain(spark, d).regimes.where("output_id = 'slump'").select(F.col("date").alias("month"), "probability")
    w = spark.createDataFrame([("1997-03-01", "1997-08-01"), ("1999-06-01", "1999-09-01"), ("2030-01-01", "2030-03-01")], "start string, end string").select(F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    return loose(ranking.lead_lag(m, w, 0.45, 6), "lead_lag_months")


def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    r = chain(spark, d).regimes.where("score is not null").select("date", "output_id", "score")
    p = r.select("date", F.col("output_id").alias("a"), F.col("score").alias("x")).join(r.select("date", F.col("output_id").alias("b"), F.col("score").alias("y")), "date").where("a < b")
    return rounded(p.groupBy("a", "b").agg(ranking.correlation(F.col("x"), F.col("y")).alias("corr")))


def confidence_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = chain(spark, d).health.where("confidence is not null").agg(F.percentile("confidence", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return rounded(q.select(F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75")))


def rank_stability(spark: SparkSession, d: str) -> DataFrame:
    s = sectors(spark, d)[1].where("valid")
    dense = F.dense_rank().over(W.orderBy("date"))
    dates = s.select("date").distinct().withColumn("_n", dense)
    w = W.partitionBy("entity_id").orderBy("_n")
    j = s.join(F.broadcast(dates), "date").withColumn("_d", F.when(F.lag("_n").over(w) == F.col("_n") - 1, F.abs(F.col("rank") - F.lag("rank").over(w))))
    return rounded(j.agg(F.avg("_d").alias("mean_abs_change")))


def component_dominance(spark: SparkSession, d: str) -> DataFrame:
    a = F.abs("contribution")
    share = F.try_divide(a, F.sum(a).over(W.partitionBy("entity_id", "date")))
    c = sectors(spark, d)[0].withColumn("share", share).withColumn("a", a)
    return rounded(c.groupBy("component_type", "component_id").agg(F.avg("a").alias("mean_abs"), F.max("share").alias("max_share")))


def score_dispersion(spark: SparkSession, d: str) -> DataFrame:
    s = sectors(spark, d)[1].where("valid").groupBy("date").agg(F.stddev_samp("adjusted_score").alias("s"), F.max(F.abs("adjusted_score")).alias("m"))
    return rounded(s.agg(F.avg("s").alias("mean_std"), F.max("m").alias("max_abs")))


def variants(spark: SparkSession, d: str) -> DataFrame:
    """Softmax temperatures as a column: all variants in one plan."""
    r = chain(spark, d).regimes.where("score is not null").select("output_id", "date", "score")
    t = spark.createDataFrame([(0.6,), (1.0,), (2.0,)], "temperature double")
    w = W.partitionBy("temperature", "date")
    e = F.exp((F.col("score") - F.max("score").over(w)) / F.col("temperature"))
    p = r.crossJoin(F.broadcast(t)).withColumn("p", e / F.sum(e).over(w))
    h = p.groupBy("temperature", "date").agg(scoring.peakedness(scoring.entropy(F.col("p")), F.count(F.lit(1))).alias("c"))
    return rounded(h.groupBy("temperature").agg(F.avg("c").alias("avg_confidence")))


NAMES = [
    "latest_states", "scan_projection", "vintage_dedupe", "feature_diff_yoy", "rolling_zscore", "expanding_zscore", "feature_health", "source_health", "month_spine", "asof_reasons", "dimension_contributions",
    "dimension_scores", "dimension_health", "regime_scores", "regime_health", "top2_gap", "polarity_matrix", "regime_timeline_top2", "transition_filter", "regime_transitions", "regime_runlength", "regime_summary",
    "stacked_bands", "sector_components", "sector_scores", "forward_returns", "spearman_ic", "quintile_spread", "auroc", "threshold_metrics", "lead_lag", "corr_matrix", "confidence_quantiles", "rank_stability",
    "component_dominance", "score_dispersion", "variants",
]
QUERIES = {n: globals()[n] for n in NAMES}
