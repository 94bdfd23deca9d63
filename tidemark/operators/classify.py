"""Rule classification of texts, repair of nested annotations, guardrail checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import running
from tidemark.session import durable

# Keyword rules of the deterministic classifier, in order, with theme, direction, severity, confidence, horizon, and sector, impact, score, confidence of the impact; the last has no keywords and no impact.
RULES = [
    (("oil", "energy"), ("commodity_pressure", "positive", 0.6, 0.8, "short_term"), ("energy", "tailwind", 0.5, 0.75)),
    (("fed", "rate", "central bank"), ("monetary_tightening", "positive", 0.5, 0.7, "short_term"), ("real_estate", "headwind", -0.4, 0.7)),
    ((), ("growth_slowdown", "unclear", 0.2, 0.35, "unclear"), None),
]
# Other spellings of stated values.
ALIASES = {
    "theme_direction": {"uncertainty": "unclear", "uncertain": "unclear", "unknown": "unclear", "positive_for_macro": "positive", "negative_for_macro": "negative"},
    "impact_direction": {"uncertainty": "unclear", "uncertain": "unclear", "unknown": "unclear", "positive": "tailwind", "negative": "headwind", "positive_for_sector": "tailwind", "negative_for_sector": "headwind"},
    "time_horizon": {"near_term": "short_term", "short-term": "short_term", "medium-term": "medium_term", "long-term": "long_term", "unknown": "unclear", "uncertain": "unclear"},
    "entity_type": {"central bank": "central_bank", "government": "country", "geography": "region", "geographic_region": "region", "individual": "person"},
}
# What each field may state.
ALLOWED = {
    "theme_direction": ["positive", "negative", "mixed", "neutral", "unclear"], "impact_direction": ["tailwind", "headwind", "mixed", "neutral", "unclear"], "time_horizon": ["immediate", "short_term", "medium_term", "long_term", "unclear"],
    "entity_type": ["company", "country", "person", "central_bank", "commodity", "sector", "region", "other"],
}
PAYLOAD = (
    "summary string, macro_themes array<struct<theme_id: string, direction: string, severity: double, confidence: double, time_horizon: string>>, "
    "sector_impacts array<struct<sector_id: string, impact_direction: string, impact_score: double, confidence: double>>, entities array<struct<name: string, entity_type: string>>, "
    "overall_severity double, overall_confidence double, time_horizon string"
)


def rule_class(text: Column) -> Column:
    """Struct(theme, direction, severity, confidence, horizon, sector, impact, score, impact_confidence) of the first rule one of whose keywords the text holds. Substrings count; without an impact its fields are null."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for words, theme, impact in reversed(RULES):
        values = [*theme, *(impact or (None, None, None, None))]
        kinds = ["string", "string", "double", "double", "string", "string", "string", "double", "double"]
        names = ["theme", "direction", "severity", "confidence", "horizon", "sector", "impact", "score", "impact_confidence"]
        s = F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(values, kinds, names)])
        out = s if not words else F.when(reduce(lambda a, b: a | b, [t.contains(w) for w in words]), s).otherwise(out)
    return out


def repaired(value: Column, field: str) -> Column:
    """Stated value in its proper form, through the field's aliases; null if it is none."""
    v = F.lower(F.trim(value))
    out = reduce(lambda c, kw: F.when(v == kw[0], kw[1]).otherwise(c), ALIASES[field].items(), v)
    return F.when(out.isin(ALLOWED[field]), out)


def repaired_payload(answer: Column, themes: list[str], sectors: list[str]) -> Column:
    """struct(payload, errors): a JSON answer with its values repaired and clamped, and what is still wrong with it.

    errors: not_json, missing_summary, no_themes, unknown_theme, unknown_sector, bad_direction, bad_horizon. An answer
    without errors is valid.
    """
    p = F.from_json(answer, PAYLOAD)
    unit = lambda c: clamped(c, 0.0, 1.0)
    fixed = F.struct(
        F.trim(p.summary).alias("summary"),
        F.transform(p.macro_themes, lambda x: F.struct(x.theme_id.alias("theme_id"), repaired(x.direction, "theme_direction").alias("direction"), unit(x.severity).alias("severity"), unit(x.confidence).alias("confidence"), repaired(x.time_horizon, "time_horizon").alias("time_horizon"))).alias("macro_themes"),
        F.transform(p.sector_impacts, lambda x: F.struct(x.sector_id.alias("sector_id"), repaired(x.impact_direction, "impact_direction").alias("impact_direction"), clamped(x.impact_score, -1.0, 1.0).alias("impact_score"), unit(x.confidence).alias("confidence"))).alias("sector_impacts"),
        F.transform(p.entities, lambda x: F.struct(x["name"].alias("name"), repaired(x.entity_type, "entity_type").alias("entity_type"))).alias("entities"),
        unit(p.overall_severity).alias("overall_severity"), unit(p.overall_confidence).alias("overall_confidence"), repaired(p.time_horizon, "time_horizon").alias("time_horizon"),
    )
    none = lambda x: F.coalesce(x, F.lit(False))
    th, im = fixed.macro_themes, fixed.sector_impacts
    checks = {
        "not_json": F.get_json_object(answer, "$").isNull() | (~none(F.trim(answer).startswith("{"))), "missing_summary": F.coalesce(F.length(fixed.summary), F.lit(0)) == 0, "no_themes": F.coalesce(F.size(th), F.lit(0)) < 1,
        "unknown_theme": none(F.exists(th, lambda x: ~F.coalesce(x.theme_id.isin(themes), F.lit(False)))), "unknown_sector": none(F.exists(im, lambda x: ~F.coalesce(x.sector_id.isin(sectors), F.lit(False)))),
        "bad_direction": none(F.exists(th, lambda x: x.direction.isNull())) | none(F.exists(im, lambda x: x.impact_direction.isNull())), "bad_horizon": fixed.time_horizon.isNull(),
    }
    errors = F.when(checks["not_json"], F.array(F.lit("not_json"))).otherwise(F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items() if n != "not_json"])))
    return F.struct(fixed.alias("payload"), errors.alias("errors"))


def ask(items: DataFrame, answer: Callable[[str, list[str]], str], check: Callable[[str], list[str]], tries: int = 3) -> DataFrame:
    """(news_id, raw_json, retry_count, errors): a classifier's answer to each item's text, asked again with what was wrong.

    ``answer`` takes the text and the errors of the answer before; what it raises counts as an error. Runs in the tasks, so
    it must be picklable; any service, local model or stand-in can be put in.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["news_id"], b["text"]):
                raw, errors, k = None, [], 0
                for k in range(tries):
                    try:
                        raw = answer(text, errors)
                        errors = check(raw)
                    except Exception as e:
                        errors = [f"{type(e).__name__}: {e}"]
                    if not errors:
                        break
                rows.append((i, raw, k, errors))
            yield pd.DataFrame(rows, columns=["news_id", "raw_json", "retry_count", "errors"])

    return items.select("news_id", "text").mapInPandas(run, "news_id bigint, raw_json string, retry_count int, errors array<string>")


def stopped_at(attempts: DataFrame, order: str, most: float, after: int = 10) -> DataFrame:
    """``attempts`` (order, failed) up to where more than ``most`` of the attempts so far failed, looked at from the ``after``-th on; the row that stops it is in. Ranks are taken over many tasks."""
    seen = running(attempts, [], [F.col(order)], F.col("failed").cast("double"))
    seen = durable(seen, "attempts")
    stop = seen.where((F.col("_rank") >= after) & (F.col("_cum") / F.col("_rank") > most)).agg(F.min("_rank").alias("stop"))
    # one row
    return seen.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("_rank") <= F.col("stop"))).drop("_cum", "stop")


def clamped(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def guardrail_anomalies(impacts: DataFrame, themes: DataFrame, expected: DataFrame, min_confidence: float) -> DataFrame:
    """(news_id, theme_id, sector_id, expected, observed, confidence): impacts against what their theme lets expect.

    ``expected``: theme_id, sector_id, sign (a small parameter relation). A negative theme turns the expectation.
    Neutral impacts and themes, and low confidence, are no anomalies.
    """
    sg = lambda c: F.when(F.lower(c).isin("positive", "tailwind"), 1).when(F.lower(c).isin("negative", "headwind"), -1).otherwise(0)
    j = impacts.join(themes, "news_id").join(F.broadcast(expected), ["theme_id", "sector_id"])
    want, got = sg(F.col("direction")) * F.col("sign"), sg(F.col("impact_direction"))
    bad = j.where((want != 0) & (got != 0) & (want != got) & (F.col("confidence") >= min_confidence))
    return bad.select("news_id", "theme_id", "sector_id", F.when(want > 0, "tailwind").otherwise("headwind").alias("expected"), F.col("impact_direction").alias("observed"), "confidence")
