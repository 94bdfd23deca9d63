"""Small frames that reports are made of: latest slices, top lists by sign, nested maps, status rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Run states that need no alert.
CALM = ["ok", "passed", "success"]


def latest(df: DataFrame, when: str) -> DataFrame:
    """Rows of the last date: an aggregate of one row is met, so nothing is ordered."""
    last = df.agg(F.max(when).alias(when))
    return df.join(F.broadcast(last), when, "left_semi")


def top(df: DataFrame, score: str, ident: str, n: int, positive: bool | None = None) -> DataFrame:
    """The ``n`` rows of greatest score, ties by id; with ``positive`` only scores above 0, or the least of those below it."""
    s = F.round(score, 9)
    if positive is None:
        return df.orderBy(s.desc(), ident).limit(n)
    return df.where(F.col(score) > 0).orderBy(s.desc(), ident).limit(n) if positive else df.where(F.col(score) < 0).orderBy(s, ident).limit(n)


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last ``n`` rows in order."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def inspect(df: DataFrame, **equals: object) -> DataFrame:
    """Rows with all the given values; a null parameter asks nothing."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), [(k, v) for k, v in equals.items() if v is not None], df)


def by_sign(comps: DataFrame, keys: list[str], value: str, ident: str, n: int) -> DataFrame:
    """(keys, side, place, ...): per key the ``n`` greatest supporting (above 0) and opposing (below 0) components."""
    side = F.when(F.col(value) > 0, "supporting").when(F.col(value) < 0, "opposing")
    w = W.partitionBy(*keys, "side").orderBy(F.round(F.abs(value), 9).desc(), ident)
    return comps.withColumn("side", side).where("side is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def as_map(df: DataFrame, keys: list[str], name: Column, value: Column) -> DataFrame:
    """(keys, values map): names in order."""
    pairs = F.array_sort(F.collect_list(F.struct(name.alias("key"), value.alias("value"))))
    return df.groupBy(*keys).agg(F.map_from_entries(pairs).alias("values"))


def safe_json(*columns: str) -> Column:
    """JSON object of columns: NaN and infinite numbers become null, dates ISO text."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def phases(timeline: DataFrame, state: str) -> DataFrame:
    """(phase, state, start, end, length, faded): stretches over all rows; faded if any of them is invalid. A timeline is bounded by the calendar."""
    w = W.orderBy("date")
    new = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)) & F.lag("date").over(w).isNotNull(), 0).otherwise(1)
    m = timeline.withColumn("_n", new).withColumn("phase", F.sum("_n").over(w).cast("int"))
    return m.groupBy("phase").agg(F.first(state).alias("state"), F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("length"), F.bool_or(~F.col("valid")).alias("faded"))


def current_state(health: DataFrame, timeline: DataFrame) -> DataFrame:
    """One row: the last valid raw state and what is reported for it.

    ``health``: date, valid, dominant, dominant_probability, confidence. ``timeline``: date, valid, reported_state,
    reported_probability, filter_reason. The report of that date is taken, else that of the last valid one, else the raw
    state itself with no_timeline or no_valid_timeline.
    """
    raw = latest(health.where("valid"), "date")
    t = timeline.where("valid").withColumn("_same", F.lit(1))
    last = t.agg(F.max_by(F.struct("reported_state", "reported_probability", "filter_reason"), "date").alias("l"), F.count(F.lit(1)).alias("n"))
    any_ = timeline.agg(F.count(F.lit(1)).alias("rows"))
    own = raw.select("date").join(t, "date", "left").select("date", F.struct("reported_state", "reported_probability", "filter_reason").alias("o"), F.col("_same").isNotNull().alias("has"))
    j = raw.join(own, "date").crossJoin(F.broadcast(last)).crossJoin(F.broadcast(any_))
    pick = lambda f: F.when(F.col("has"), F.col(f"o.{f}")).when(F.col("n") > 0, F.col(f"l.{f}"))
    state, p = F.coalesce(pick("reported_state"), "dominant"), F.coalesce(pick("reported_probability"), "dominant_probability")
    reason = F.coalesce(pick("filter_reason"), F.when(F.col("rows") == 0, "no_timeline").otherwise("no_valid_timeline"))
    return j.select("date", F.col("dominant").alias("raw_state"), F.col("dominant_probability").alias("raw_probability"), "confidence", state.alias("reported_state"), p.alias("reported_probability"), reason.alias("filter_reason"))


def alerts(runs: DataFrame) -> DataFrame:
    """(run_id, alert): the last run's guardrail status if it isn't calm, and a change of regime from the run before. ``runs``: run_date, run_id, regime, guardrail."""
    two = tail(runs, 2, "run_date", "run_id")
    w = W.orderBy("run_date", "run_id")
    last = two.withColumn("_before", F.lag("regime").over(w)).withColumn("_r", F.row_number().over(W.orderBy(F.col("run_date").desc(), F.col("run_id").desc()))).where("_r = 1")
    guard = F.when(~F.coalesce(F.col("guardrail").isin(CALM), F.lit(False)), F.concat(F.lit("guardrail status = "), F.coalesce("guardrail", F.lit("missing"))))
    flip = F.when(F.col("_before") != F.col("regime"), F.concat(F.lit("regime change: "), "_before", F.lit(" -> "), "regime"))
    return last.select("run_id", F.concat_ws("; ", guard, flip).alias("alert"))


def history_index(runs: DataFrame) -> DataFrame:
    """Archived runs (``landing.run_summaries``), newest first, as rows."""
    return runs.select(
        "run_id", "run_date", "status", F.col("macro.reported_regime").alias("macro_regime"), F.col("macro.confidence").alias("macro_confidence"), F.transform("combined_top", lambda s: s.sector_id).alias("top_sectors"),
        F.coalesce("accumulation.readiness_label", F.lit("insufficient_history")).alias("readiness_label"), F.col("step_statuses.guardrail_status").alias("guardrail_status"), F.col("monitoring.success_rate").alias("success_rate"),
        F.col("monitoring.max_rank_change").alias("max_rank_change"), F.coalesce(F.size("warnings"), F.lit(0)).alias("warning_count"), F.coalesce(F.size("errors"), F.lit(0)).alias("error_count"),
    ).orderBy(F.col("run_date").desc(), F.col("run_id").desc())


def first_valid(*documents: DataFrame) -> DataFrame:
    """(regime, probability, confidence) of the first document that is valid; each has at most one row (valid, reported_state, raw_state, probability, confidence)."""
    named = [d.select(F.lit(k).alias("k"), "valid", F.coalesce("reported_state", "raw_state").alias("regime"), "probability", "confidence") for k, d in enumerate(documents)]
    return reduce(DataFrame.unionByName, named).where(F.coalesce("valid", F.lit(False))).orderBy("k").limit(1).drop("k", "valid")


def kpis(runs: DataFrame, n: int = 20) -> DataFrame:
    """(runs, mean_confidence, most_rank_change, last_success_rate) of the latest ``n`` runs (run_date, run_id, confidence, max_rank_change, success_rate)."""
    r = tail(runs, n, "run_date", "run_id")
    return r.agg(F.count(F.lit(1)).alias("runs"), F.avg("confidence").alias("mean_confidence"), F.max("max_rank_change").alias("most_rank_change"), F.max_by("success_rate", F.struct("run_date", "run_id")).alias("last_success_rate"))


def verdict(ics: DataFrame, limit: float = 0.1) -> DataFrame:
    """(most, verdict) of (ic) rows: signal if the greatest absolute rank correlation reaches the limit."""
    return ics.agg(F.max(F.abs("ic")).alias("most")).select("most", F.when(F.col("most").isNull(), "none").when(F.col("most") >= limit, "signal").otherwise("weak").alias("verdict"))


def conviction(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c >= 0.5, "high").when(c >= 0.25, "moderate").otherwise("low")


def environment(paths: dict[str, bool], store: bool, profile: bool, key: bool) -> str:
    """ok, warning (no key or profile) or blocked (a path or the store is missing)."""
    if not all(paths.values()) or not store:
        return "blocked"
    return "ok" if profile and key else "warning"
