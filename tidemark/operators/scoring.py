"""Weighted roll-ups with coverage gates, state probabilities, cross-sectional scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.params import Weighted, relation


def polarity(kind: Column, x: Column) -> Column:
    """Input value as its polarity counts it; null stays null."""
    up, down = F.greatest(x, F.lit(0.0)), F.greatest(-x, F.lit(0.0))
    signed = (
        F.when(kind == "positive", x).when(kind == "negative", -x).when(kind == "positive_only", up).when(kind == "negative_only", down)
        .when(kind == "penalize_positive_only", -up).when(kind == "penalize_negative_only", -down).when(kind == "reward_near_zero", -F.abs(x))
    )
    return F.when(x.isNotNull(), signed)


def contributions(values: DataFrame, inputs: list[Weighted], filler: str) -> DataFrame:
    """Every (output, date, configured input): value, weight, normalized_weight, signed_value, contribution, valid, reason.

    ``values``: input_id, date, value, valid, reason. An output's dates are those on which any of its inputs has a row;
    an input without a row there is invalid with ``filler``. Weights are renormalised over the valid inputs.
    """
    cfg = F.broadcast(relation(values.sparkSession, inputs))
    v = values.where("date is not null").select("input_id", "date", "value", F.col("valid").alias("_v"), F.col("reason").alias("_r"))
    # the configured inputs of an output are few and known: dates cross them, values are joined by key
    dates = v.join(cfg.select("output_id", "input_id"), "input_id").select("output_id", "date").distinct()
    full = dates.join(cfg, "output_id").join(v, ["input_id", "date"], "left")
    ok = F.coalesce(F.col("_v") & F.col("value").isNotNull(), F.lit(False))
    w = W.partitionBy("output_id", "date")
    full = full.withColumn("valid", ok).withColumn("signed_value", F.when(F.col("valid"), polarity(F.col("polarity"), F.col("value"))))
    full = full.withColumn("normalized_weight", F.when(F.col("valid"), F.try_divide(F.col("weight"), F.sum(F.when(F.col("valid"), F.col("weight"))).over(w))).otherwise(F.lit(0.0)))
    reason = F.when(F.col("valid"), "ok").when(F.col("_r").isNull(), filler).otherwise(F.col("_r"))
    contribution = F.when(F.col("valid"), F.col("signed_value") * F.col("normalized_weight")).otherwise(F.lit(0.0))
    return full.select("output_id", "input_id", "date", "value", "weight", "normalized_weight", "polarity", "signed_value", contribution.alias("contribution"), "valid", reason.alias("reason"), "min_valid", "min_coverage", "ordinal")


def rolled(contrib: DataFrame, what: str) -> DataFrame:
    """(output_id, date, score, valid_count, configured_count, total_weight, used_weight, coverage_ratio, valid, reason); the count gate goes before the coverage gate."""
    g = contrib.groupBy("output_id", "date").agg(
        F.sum("contribution").alias("_s"), F.count_if("valid").alias("valid_count"), F.count(F.lit(1)).alias("configured_count"), F.sum("weight").alias("total_weight"),
        F.sum(F.when(F.col("valid"), F.col("weight")).otherwise(0.0)).alias("used_weight"), F.max("min_valid").alias("_mv"), F.max("min_coverage").alias("_mc"),
    ).withColumn("coverage_ratio", F.try_divide(F.col("used_weight"), F.col("total_weight")))
    # weights are decimal fractions: their sums may fall short of the gate by rounding only
    reason = F.when(F.col("valid_count") < F.col("_mv"), f"below_min_valid_{what}").when((F.col("coverage_ratio") < F.col("_mc") - 1e-9) | (F.col("used_weight") <= 0), "below_min_coverage_ratio").otherwise("ok")
    out = g.withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok")
    return out.select("output_id", "date", F.when(F.col("valid"), F.col("_s")).alias("score"), "valid_count", "configured_count", "total_weight", "used_weight", "coverage_ratio", "valid", "reason")


def rollup_health(contrib: DataFrame) -> DataFrame:
    """(output_id, date, valid_count, missing, invalid): ids of inputs without a row and of invalid ones, in order of configuration."""
    pick = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ordinal", "input_id")))), lambda s: s.input_id), ",")
    gone = F.col("reason").startswith("missing_")
    return contrib.groupBy("output_id", "date").agg(F.count_if("valid").alias("valid_count"), pick(gone).alias("missing"), pick(~F.col("valid") & ~gone).alias("invalid"))


def probabilities(scores: DataFrame, order: dict[str, int], temperature: float = 1.0) -> DataFrame:
    """``scores`` (output_id, date, score, valid, ...) with softmax probability and rank among the valid ones of a date; ties keep the order of configuration."""
    w = W.partitionBy("date")
    s = F.when(F.col("valid"), F.col("score"))
    e = F.exp((s - F.max(s).over(w)) / temperature)
    rank = F.lit(len(order))
    for k, v in order.items():
        rank = F.when(F.col("output_id") == k, v).otherwise(rank)
    out = scores.withColumn("probability", F.try_divide(e, F.sum(e).over(w))).withColumn("_o", rank)
    n = F.row_number().over(w.orderBy(F.col("probability").desc_nulls_last(), "_o", "output_id"))
    return out.withColumn("rank", F.when(F.col("probability").isNotNull(), n).cast("int")).drop("_o")


def entropy(p: Column) -> Column:
    """Aggregate: -sum p ln p over positive p."""
    return -F.sum(F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0)))


def peakedness(h: Column, n: Column) -> Column:
    """1 - entropy / ln n, within 0..1; 1 for a single state."""
    return F.when(n <= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(h, F.ln(n)))))


def state_health(scored: DataFrame) -> DataFrame:
    """(date, valid, dominant, dominant_probability, confidence, entropy, valid_count, reason): confidence is peakedness times mean coverage."""
    ok = F.col("valid") & F.col("probability").isNotNull()
    p = F.when(ok, F.col("probability"))
    g = scored.groupBy("date").agg(
        F.count_if(ok).alias("valid_count"), F.min_by("output_id", F.when(ok, F.col("rank"))).alias("dominant"), F.max(p).alias("dominant_probability"),
        entropy(p).alias("_h"), F.avg(F.when(ok, F.col("coverage_ratio"))).alias("_c"),
    )
    any_ok = F.col("valid_count") > 0
    return g.select(
        "date", any_ok.alias("valid"), F.when(any_ok, F.col("dominant")).alias("dominant"), "dominant_probability", F.when(any_ok, peakedness(F.col("_h"), F.col("valid_count")) * F.col("_c")).alias("confidence"),
        F.when(any_ok, F.col("_h")).alias("entropy"), "valid_count", F.when(any_ok, "ok").otherwise("no_valid_regimes").alias("reason"),
    )


def top2_gap(scored: DataFrame) -> DataFrame:
    """(date, gap): probability of the first less that of the second."""
    return scored.groupBy("date").agg((F.max(F.when(F.col("rank") == 1, F.col("probability"))) - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("probability"))), F.lit(0.0))).alias("gap"))


def sector_components(dates: DataFrame, matrix: DataFrame, values: DataFrame) -> DataFrame:
    """(entity_id, date, component_type, component_id, input_value, weight, contribution, valid, reason).

    ``matrix``: entity_id, component_type, component_id, weight (a small parameter relation). ``values``: date,
    component_type, component_id, input_value. A missing value makes its component invalid.
    """
    full = dates.select("date").distinct().crossJoin(F.broadcast(matrix)).join(values, ["date", "component_type", "component_id"], "left")
    ok = F.col("input_value").isNotNull()
    why = F.when(ok, "ok").when(F.col("component_type") == "regime_prior", "missing_regime_probability").otherwise("missing_dimension_score")
    return full.select("entity_id", "date", "component_type", "component_id", "input_value", "weight", F.coalesce(F.col("input_value") * F.col("weight"), F.lit(0.0)).alias("contribution"), ok.alias("valid"), why.alias("reason"))


def confidence_multiplier(c: Column, low: float, high: float) -> Column:
    return F.lit(low) + (high - low) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def sector_scores(components: DataFrame, macro: DataFrame, low: float = 0.4, high: float = 1.0) -> DataFrame:
    """(entity_id, date, raw_score, adjusted_score, rank, macro_confidence, missing, valid, reason): one missing component nulls the score.

    ``macro``: date, macro_confidence. Rank by adjusted score among valid ones, ties by id.
    """
    missing = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("valid"), F.concat_ws(":", "component_type", "component_id")))), ",")
    g = components.groupBy("entity_id", "date").agg(F.sum("contribution").alias("_s"), F.bool_and("valid").alias("valid"), missing.alias("missing"), F.count(F.lit(1)).alias("component_count"))
    g = g.join(macro.select("date", "macro_confidence"), "date", "left").withColumn("raw_score", F.when(F.col("valid"), F.col("_s"))).withColumn("adjusted_score", F.col("raw_score") * confidence_multiplier(F.col("macro_confidence"), low, high))
    n = F.row_number().over(W.partitionBy("date").orderBy(F.col("adjusted_score").desc_nulls_last(), "entity_id"))
    return g.select("entity_id", "date", "raw_score", "adjusted_score", F.when(F.col("valid"), n).cast("int").alias("rank"), "macro_confidence", "component_count", "missing", "valid", F.when(F.col("valid"), "ok").otherwise("missing_macro_components").alias("reason"))


def cross_zscore(x: Column, w: W) -> Column:
    """z-score in a cross-section by population deviation; 0 without spread."""
    return F.coalesce(F.try_divide(x - F.avg(x).over(w), F.nullif(F.stddev_pop(x).over(w), F.lit(0.0))), F.lit(0.0))


def interaction(scores: DataFrame, parts: list[tuple[str, str]]) -> DataFrame:
    """(date, value): the least of several outputs as their polarities count them; no row where any of them is missing or invalid."""
    cfg = scores.sparkSession.createDataFrame(parts, "output_id string, polarity string")
    j = scores.where("valid and score is not null").join(F.broadcast(cfg), "output_id").select("date", polarity(F.col("polarity"), F.col("score")).alias("v"))
    return j.groupBy("date").agg(F.count("v").alias("_n"), F.min("v").alias("value")).where(F.col("_n") == len(parts)).drop("_n")


def blended(scores: DataFrame, inter: DataFrame, output: str, weight: float, inter_weight: float) -> DataFrame:
    """``scores`` with one output's valid scores mixed with the interaction's values by their weights."""
    whole = weight + inter_weight
    mixed = F.col("score") * (weight / whole) + F.col("value") * (inter_weight / whole)
    use = (F.col("output_id") == output) & F.col("valid") & F.col("value").isNotNull()
    return scores.join(inter, "date", "left").withColumn("score", F.when(use, mixed).otherwise(F.col("score"))).drop("value")


def varied(components: DataFrame, variants: DataFrame) -> DataFrame:
    """(variant_id, entity_id, date, score, valid) for every variant's weights of the component types, in one plan. ``variants``: variant_id, prior_weight, dimension_weight, parameters."""
    w = F.when(F.col("component_type") == "regime_prior", F.col("prior_weight")).otherwise(F.col("dimension_weight"))
    return components.crossJoin(F.broadcast(variants)).groupBy("variant_id", "entity_id", "date").agg(F.sum(F.col("contribution") * w).alias("score"), F.bool_and("valid").alias("valid"))
