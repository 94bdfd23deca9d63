"""Rank statistics and selections by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ranks import running


def average_rank(value: Column, by: list[str]) -> Column:
    """Rank from 1, ties at their mean."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / 2.0


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation from sums; null, not an error, where a side is constant."""
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    top = n * F.sum(x * y) - sx * sy
    return F.try_divide(top, F.sqrt(F.greatest(n * F.sum(x * x) - sx * sx, F.lit(0.0)) * F.greatest(n * F.sum(y * y) - sy * sy, F.lit(0.0))))


def spearman(df: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """(by, n, ic): rank correlation of each group with at least two rows and two distinct values on each side."""
    ok = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    r = ok.withColumn("_l", average_rank(F.col(left), by)).withColumn("_r", average_rank(F.col(right), by))
    g = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("_l"), F.col("_r")).alias("_c"), F.min("_l").alias("a"), F.max("_l").alias("b"), F.min("_r").alias("c"), F.max("_r").alias("d"))
    return g.select(*by, "n", F.when((F.col("n") >= 2) & (F.col("a") < F.col("b")) & (F.col("c") < F.col("d")), F.col("_c")).alias("ic"))


def quintiles(df: DataFrame, by: list[str], score: str, value: str, tie: str) -> DataFrame:
    """One row: top_avg, bottom_avg, spread, hit_rate of the pooled first and last fifth of each group (at least one row each)."""
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    size = F.greatest(F.lit(1), F.bround(n * 0.2).cast("int"))
    top = F.row_number().over(W.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), tie))
    m = df.withColumn("_n", n).withColumn("_k", size).withColumn("_r", top).where("_n >= 2")
    first, last = F.col("_r") <= F.col("_k"), F.col("_r") > F.col("_n") - F.col("_k")
    v = F.col(value)
    return m.agg(F.avg(F.when(first, v)).alias("top_avg"), F.avg(F.when(last, v)).alias("bottom_avg"), (F.avg(F.when(first, v)) - F.avg(F.when(last, v))).alias("spread"), F.avg(F.when(first, (v > 0).cast("double"))).alias("hit_rate"))


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: positives, negatives, auroc (ties count half); null without both classes.

    Equal scores are counted first; the running count over distinct scores goes over many tasks.
    """
    g = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_x")).agg(F.count_if(label).alias("p"), F.count_if(~F.col(label)).alias("q"))
    u = running(g, [], [F.col("_x")], F.col("q")).withColumn("_u", F.col("p") * (F.col("_cum") - F.col("q") / 2.0))
    return u.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("q"), F.lit(0)).alias("negatives"), F.try_divide(F.sum("_u"), F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auroc"))


def threshold_rates(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """(threshold, hits, hit_rate, flags, flag_rate) of labelled and unlabelled rows at each threshold, in one pass."""
    n = df.agg(
        F.count_if(label).alias("p"), F.count_if(~F.col(label)).alias("q"),
        *[F.count_if(F.col(label) & (F.col(score) >= t)).alias(f"h{k}") for k, t in enumerate(thresholds)], *[F.count_if(~F.col(label) & (F.col(score) >= t)).alias(f"f{k}") for k, t in enumerate(thresholds)],
    )
    rows = n.select("p", "q", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"h{k}").alias("hits"), F.col(f"f{k}").alias("flags")) for k, t in enumerate(thresholds)])).alias("r"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return rows.select("r.threshold", "r.hits", rate("r.hits", "p").alias("hit_rate"), "r.flags", rate("r.flags", "q").alias("flag_rate"))


def lead_lag(monthly: DataFrame, windows: DataFrame, threshold: float, before: int) -> DataFrame:
    """(start, end, detected, lead_lag_months): first month at or over ``threshold`` from ``before`` months ahead of each window's start to its end."""
    hit = monthly.where(F.col("probability") >= threshold).select("month")
    # windows are a small parameter relation; their months make it an equi-join
    spans = windows.select("start", "end", F.explode(F.sequence(F.add_months("start", -before), F.col("end"), F.expr("interval 1 month"))).alias("month"))
    first = spans.join(hit, "month").groupBy("start", "end").agg(F.min("month").alias("detected"))
    diff = (F.year("detected") - F.year("start")) * 12 + F.month("detected") - F.month("start")
    return windows.join(first, ["start", "end"], "left").select("start", "end", "detected", diff.alias("lead_lag_months"))


def monthly_benchmark(scored: DataFrame, timeline: DataFrame, windows: DataFrame, states: list[str]) -> DataFrame:
    """(month, probability, raw_state, reported_state, inside): the summed probability of ``states`` in each valid month, and whether a window holds it.

    ``windows``: start, end, a small parameter relation; their months make the membership an equi-join.
    """
    month = F.trunc("date", "month")
    p = scored.where(F.col("output_id").isin(states) & F.col("probability").isNotNull()).groupBy(month.alias("month")).agg(F.sum("probability").alias("p"))
    inside = windows.select(F.explode(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))).alias("month")).distinct().withColumn("_in", F.lit(True))
    t = timeline.where("valid and date is not null").select(month.alias("month"), "raw_state", "reported_state")
    j = t.join(p, "month", "left").join(F.broadcast(inside), "month", "left")
    return j.select("month", F.coalesce("p", F.lit(0.0)).alias("probability"), "raw_state", "reported_state", F.coalesce("_in", F.lit(False)).alias("inside"))


def label_rates(df: DataFrame, by: list[str], flag: Column, inside: str) -> DataFrame:
    """(by, inside_months, hits, hit_rate, flags, flag_rate): how often a flag falls inside and outside."""
    i, f = F.col(inside), F.coalesce(flag, F.lit(False))
    g = df.groupBy(*by).agg(F.count_if(i).alias("inside_months"), F.count_if(i & f).alias("hits"), F.count_if(~i & f).alias("flags"), F.count_if(~i).alias("_out"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return g.select(*by, "inside_months", "hits", rate("hits", "inside_months").alias("hit_rate"), "flags", rate("flags", "_out").alias("flag_rate"))


def rank_distribution(scores: DataFrame, key: str, when: str, rank: int) -> DataFrame:
    """(key, firsts, always): how often each key had the rank, and whether on every date."""
    dates = scores.agg(F.countDistinct(when).alias("_d"))
    n = scores.where(F.col("rank") == rank).groupBy(key).agg(F.count(F.lit(1)).alias("firsts"))
    return n.crossJoin(F.broadcast(dates)).select(key, "firsts", (F.col("firsts") == F.col("_d")).alias("always"))


def validation_by(returns: DataFrame, key: str, horizons: list[int]) -> DataFrame:
    """(key, rows, average_score, average_relative_{h}m, hit_rate_{h}m) of rows with valid returns."""
    r = lambda h: F.col(f"relative_forward_{h}m_return")
    per = [x for h in horizons for x in (F.avg(r(h)).alias(f"average_relative_{h}m"), F.avg((r(h) > 0).cast("double")).alias(f"hit_rate_{h}m"))]
    return returns.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.avg("score").alias("average_score"), *per)


def variant_comparison(scores: DataFrame) -> DataFrame:
    """(variant_id, mean_score, spread, mean_rank_change) of (variant_id, entity_id, date, score, valid), the most spread first. A rank change counts between successive dates only."""
    w = W.partitionBy("variant_id", "date").orderBy(F.round("score", 9).desc(), "entity_id")
    n = F.dense_rank().over(W.partitionBy("variant_id").orderBy("date"))
    v = scores.where("valid").withColumn("_k", F.row_number().over(w)).withColumn("_n", n)
    o = W.partitionBy("variant_id", "entity_id").orderBy("date")
    v = v.withColumn("_c", F.when(F.lag("_n").over(o) == F.col("_n") - 1, F.abs(F.col("_k") - F.lag("_k").over(o))))
    g = v.groupBy("variant_id").agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("spread"), F.avg("_c").alias("mean_rank_change"))
    return g.orderBy(F.round("spread", 6).desc_nulls_last(), F.round("mean_rank_change", 6).desc_nulls_last(), "variant_id")


def within_budget(pool: DataFrame, group: str, score: list[Column], weights: dict[str, float], cap: int, default: float = 1.0) -> DataFrame:
    """At most ``cap`` rows: each present group's floor(cap * weight / sum of weights) best, then the best of the rest.

    ``pool``'s groups are few (a parameter of sources). The result's size is the operator's feature.
    """
    w = F.lit(default)
    for k, v in weights.items():
        w = F.when(F.col(group) == k, v).otherwise(w)
    present = pool.groupBy(group).agg(F.max(w).alias("_w"))
    quota = present.withColumn("_q", F.floor(cap * F.col("_w") / F.sum("_w").over(W.partitionBy())))
    head = pool.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*score))).where(F.col("_r") <= cap)
    marked = head.join(F.broadcast(quota), group).withColumn("_head", F.col("_r") <= F.col("_q"))
    # no group can place more than cap rows, so this order holds at most groups * cap rows
    rest = marked.withColumn("_k", F.row_number().over(W.orderBy(F.col("_head").desc(), *score)))
    return rest.where(F.col("_k") <= cap).drop("_r", "_w", "_q", "_head", "_k")
